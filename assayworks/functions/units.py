"""Unit strings: normal form, synonyms and conversion through a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAP_SCHEMA = "from_unit string, to_unit string, multiplier double, category string, confidence string, source string"
#: Tables up to this count are broadcast; larger ones join by shuffle.
MAX_BROADCAST_ROWS = 200_000

# Synonyms, first of equals wins.
SYNONYMS = (("mg/kg-bw/day", "mg/kg/d"), ("mg/kg-day", "mg/kg/d"), ("ug/kg-bw/day", "ug/kg/d"), ("ug/kg-day", "ug/kg/d"), ("hrs", "hr"), ("days", "day"), ("m", "min"))
# mg/L for one unit of amount concentration and a molecular weight of one.
MOLARITY = {"m": 1000.0, "mol/l": 1000.0, "mm": 1.0, "mmol/l": 1.0, "um": 1e-3, "umol/l": 1e-3, "nm": 1e-6, "nmol/l": 1e-6, "pm": 1e-9, "pmol/l": 1e-9}
# The smallest table that works, and hours for one unit of duration.
BASE_MAP = (("mg/L", "mg/L", 1.0), ("ug/L", "mg/L", 0.001), ("ppb", "mg/L", 0.001), ("ppm", "mg/L", 1.0))
DURATION_MAP = (("hr", "hr", 1.0), ("h", "hr", 1.0), ("hour", "hr", 1.0), ("d", "hr", 24.0), ("day", "hr", 24.0), ("wk", "hr", 168.0), ("week", "hr", 168.0), ("mo", "hr", 730.5), ("month", "hr", 730.5), ("yr", "hr", 8766.0), ("year", "hr", 8766.0), ("min", "hr", 1 / 60), ("minute", "hr", 1 / 60), ("s", "hr", 1 / 3600), ("sec", "hr", 1 / 3600))
# Activities of a volume in pCi/L, and activities in pCi.
RADIOACTIVITY_CONCENTRATION = (
    ("pCi/L", 1.0), ("pCi/l", 1.0), ("pCi per L", 1.0), ("pCi per liter", 1.0), ("pCi per litre", 1.0), ("picocurie/L", 1.0), ("picocuries/L", 1.0), ("picocurie/liter", 1.0), ("picocuries/liter", 1.0),
    ("picocurie per liter", 1.0), ("picocuries per liter", 1.0), ("picocurie per litre", 1.0), ("picocuries per litre", 1.0), ("nCi/L", 1e3), ("uCi/L", 1e6), ("µCi/L", 1e6), ("mCi/L", 1e9), ("Ci/L", 1e12),
    ("Bq/L", 27.027027027027), ("Bq/l", 27.027027027027), ("Bq per L", 27.027027027027), ("Bq per liter", 27.027027027027), ("Bq per litre", 27.027027027027),
    ("mBq/L", 0.027027027027027), ("mBq per L", 0.027027027027027), ("mBq per liter", 0.027027027027027), ("mBq per litre", 0.027027027027027),
    ("uBq/L", 0.000027027027027), ("uBq per L", 0.000027027027027), ("uBq per liter", 0.000027027027027), ("uBq per litre", 0.000027027027027),
    ("µBq/L", 0.000027027027027), ("µBq per L", 0.000027027027027), ("µBq per liter", 0.000027027027027), ("µBq per litre", 0.000027027027027),
    ("kBq/L", 27027.027027027), ("kBq per L", 27027.027027027), ("kBq per liter", 27027.027027027), ("kBq per litre", 27027.027027027),
)
RADIOACTIVITY = (
    ("pCi", 1.0), ("picocurie", 1.0), ("picocuries", 1.0), ("nCi", 1e3), ("uCi", 1e6), ("µCi", 1e6), ("mCi", 1e9), ("Ci", 1e12),
    ("Bq", 27.027027027027), ("mBq", 0.027027027027027), ("uBq", 0.000027027027027), ("µBq", 0.000027027027027), ("kBq", 27027.027027027),
)


def radiological_rows() -> list[tuple]:
    """Activities and activity concentrations, as rows of the unit table."""
    conc = [(u, "pCi/L", m, "radioactivity_concentration", "HIGH", "radiological") for u, m in RADIOACTIVITY_CONCENTRATION]
    return conc + [(u, "pCi", m, "radioactivity", "HIGH", "radiological") for u, m in RADIOACTIVITY]


def unit_map(spark: SparkSession, base: DataFrame | None = None, durations: bool = False) -> DataFrame:
    """The radiological rows, then those of base (or the smallest table) that they do not cover; ord is their order."""
    own = radiological_rows()
    covered = {r[0].lower() for r in own}
    rows = own + ([(f, t, m, "concentration", "HIGH", "fallback") for f, t, m in BASE_MAP] if base is None else [])
    rows += [(f, t, m, "duration", "HIGH", "fallback") for f, t, m in DURATION_MAP] if durations else []
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, " + MAP_SCHEMA)
    if base is None:
        return got
    base = base.filter(~F.lower("from_unit").isin(*covered) | F.col("from_unit").isNull())
    order = F.col("ord").cast("long") if "ord" in base.columns else F.monotonically_increasing_id()
    return got.unionByName(base.withColumn("ord", order + len(rows)).select("ord", "from_unit", "to_unit", "multiplier", "category", "confidence", "source"))


def normalized(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(c), "µμ", "uu"), r"\s*/\s*", "/")


def synonymous(c: Column, synonyms=SYNONYMS, patterns=()) -> Column:
    """Exact synonyms without regard to case, then ordered patterns."""
    first: dict[str, str] = {}
    for k, v in synonyms:
        first.setdefault(k.lower(), v)
    if first:
        table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
        c = F.coalesce(F.try_element_at(table, F.lower(c)), c)
    for k, v in patterns:
        c = F.regexp_replace(c, f"(?i){k}", v)
    return c


def is_molarity(c: Column) -> Column:
    """M by case, the others without regard to it."""
    return F.coalesce((c == "M") | F.lower(c).isin(*[k for k in MOLARITY if k != "m"]), F.lit(False))


def molarity_scale(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MOLARITY.items() for x in kv]), F.lower(c))


def media_target(unit: Column, media: Column) -> Column:
    part = F.lower(unit).isin("ppb", "ppm")
    return F.when(part & (media == "aqueous"), "mg/L").when(part & (media == "air"), "mg/m3").when(part & (media == "solid"), "mg/kg")


def ppx_factor(unit: Column) -> Column:
    return F.when(F.lower(unit) == "ppb", F.lit(0.001)).otherwise(F.lit(1.0))


def _first_by(table: DataFrame, key: Column, prefix: str) -> DataFrame:
    """The table's first row of each key."""
    best = table.groupBy(key.alias(f"{prefix}_key")).agg(F.min_by(F.struct("to_unit", "multiplier"), "ord").alias("m"))
    return best.select(f"{prefix}_key", F.col("m.to_unit").alias(f"{prefix}_unit"), F.col("m.multiplier").alias(f"{prefix}_by"))


OUTPUTS = ("orig_unit", "harmonized_value", "harmonized_unit", "conversion_factor", "unit_flag")


def _resolved(df: DataFrame, table: DataFrame, unit: Column, media: Column, weighed: Column, synonyms, patterns, hint) -> DataFrame:
    """df + _unit, _factor, _flag and _mol, by unit, medium and whether there is a weight; a weight's factor is for one."""
    df = df.withColumns({"_h_raw": unit, "_h_n": normalized(unit), "_h_m": media, "_h_weighed": weighed})
    df = df.withColumns({"_h_mol": is_molarity(F.col("_h_n")), "_h_u": synonymous(F.col("_h_n"), synonyms, patterns)})
    df = df.withColumns({"_h_key": F.when(F.lower("_h_u").isin("ppb", "ppm", "ppt", "ppq"), F.col("_h_n")).otherwise(F.col("_h_u")), "_h_target": media_target(F.col("_h_u"), F.col("_h_m"))})
    exact, folded = _first_by(table, F.col("from_unit"), "_e"), _first_by(table, F.lower("from_unit"), "_c")
    df = df.join(hint(exact), F.col("_h_key") == F.col("_e_key"), "left").join(hint(folded), F.lower("_h_key") == F.col("_c_key"), "left")
    raw, weighed, target = F.col("_h_raw"), F.col("_h_mol") & F.col("_h_weighed"), F.col("_h_target")
    unit_out = F.when(weighed, "mg/L").when(F.col("_h_mol"), raw).when(target.isNotNull(), target).when(F.col("_e_key").isNotNull(), F.col("_e_unit")).when(F.col("_c_key").isNotNull(), F.col("_c_unit")).otherwise(raw)
    factor = F.when(weighed, molarity_scale(F.col("_h_n"))).when(F.col("_h_mol"), 1.0).when(target.isNotNull(), ppx_factor(F.col("_h_u"))).when(F.col("_e_key").isNotNull(), F.col("_e_by")).when(F.col("_c_key").isNotNull(), F.col("_c_by")).otherwise(1.0)
    flag = F.when(weighed, "").when(F.col("_h_mol"), "needs_mw").when(target.isNotNull() | F.col("_e_key").isNotNull(), "").when(F.col("_c_key").isNotNull(), "case_fallback").otherwise("unmatched")
    flag = F.when(F.lower(F.trim(raw)).eqNullSafe("m") & ~F.col("_h_mol"), "ambiguous_unit").otherwise(flag)
    out = df.withColumns({"_h_unit": unit_out, "_h_factor": factor, "_h_flag": flag, "_h_by_weight": F.coalesce(weighed, F.lit(False))})
    return out.drop("_h_raw", "_h_n", "_h_m", "_h_weighed", "_h_mol", "_h_u", "_h_key", "_h_target", "_e_key", "_e_unit", "_e_by", "_c_key", "_c_unit", "_c_by")


def harmonized(df: DataFrame, table: DataFrame, value: str, unit: str, media: str | None = None, weight: str | None = None, category: str | None = None, synonyms=SYNONYMS, patterns=(), dedup: bool = True) -> DataFrame:
    """df + orig_unit, harmonized_value, harmonized_unit, conversion_factor, unit_flag.

    First of: amount concentration with a weight; without one (needs_mw); ppb and ppm by medium; the table, exact, then
    without regard to case (case_fallback); the unit itself (unmatched). A bare m is read as minutes and flagged.

    With dedup the distinct units, which a count shows to be few, are resolved and joined back; the rows themselves then only
    look up and multiply. Streams, and tables of too many units, are resolved row by row.
    """
    if category is not None:
        table = table.filter(F.col("category") == category)
    hint = F.broadcast if table.count() <= MAX_BROADCAST_ROWS else (lambda d: d)
    raw, none = F.col(unit).cast("string"), F.lit(None)
    m = F.col(media) if media else none.cast("string")
    w = F.col(weight).cast("double") if weight else none.cast("double")
    weighed = F.coalesce(w > 0, F.lit(False))
    if dedup and not df.isStreaming:
        keys = df.select(raw.alias("_h_ku"), m.alias("_h_km"), weighed.alias("_h_kw")).distinct()
        if keys.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
            found = _resolved(keys, table, F.col("_h_ku"), F.col("_h_km"), F.col("_h_kw"), synonyms, patterns, hint)
            df = df.withColumns({"orig_unit": raw, "_h_m": m, "_h_kw2": weighed, "_h_w": w})
            got = df.join(F.broadcast(found), F.col("orig_unit").eqNullSafe(F.col("_h_ku")) & F.col("_h_m").eqNullSafe(F.col("_h_km")) & (F.col("_h_kw2") == F.col("_h_kw")), "left").drop("_h_ku", "_h_km", "_h_kw", "_h_kw2", "_h_m")
        else:
            dedup = False
    if not dedup or df.isStreaming:
        got = _resolved(df.withColumns({"orig_unit": raw, "_h_w": w}), table, F.col("orig_unit"), m, weighed, synonyms, patterns, hint)
    factor = F.when(F.col("_h_by_weight"), F.col("_h_factor") * F.col("_h_w")).otherwise(F.col("_h_factor"))
    got = got.withColumn("conversion_factor", factor)
    return got.withColumns({"harmonized_value": F.col(value).cast("double") * F.col("conversion_factor"), "harmonized_unit": F.col("_h_unit"), "unit_flag": F.col("_h_flag")}).drop("_h_unit", "_h_factor", "_h_flag", "_h_by_weight", "_h_w")


def is_radiological(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike(r"(^|[^a-z])(pci|ci|bq)(/|$|[^a-z])"), F.lit(False))
