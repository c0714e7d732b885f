"""The unit table's making: raw unit rows rebased to targets, and how much of other vocabularies it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Targets of mass and volume and what they are rebased to.
REBASE = {"g/l": ("mg/L", 1000.0), "g/m3": ("mg/m3", 1000.0), "g/g": ("mg/kg", 1e6), "g/kg": ("mg/kg", 1000.0), "g/g/h": ("mg/kg/h", 1e6), "g": ("mg", 1000.0), "g/m2": ("mg/m2", 1000.0), "g/ml": ("mg/L", 1e6)}
MOLAR = ("mol/l", "m", "mol/kg", "mol")


def distinct_units(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("unit")).filter("unit is not null").distinct().orderBy("unit")


def transformed(raw: DataFrame) -> DataFrame:
    """from_unit, to_unit, multiplier, category: one row each, the first by ord. raw: orig, cur_target, ecotox_mult, domain, ord.

    Amounts of substance have no factor: they need a molecular weight (NEEDS_MW).
    """
    low = F.lower(F.trim("cur_target"))
    unit = F.create_map(*[F.lit(x) for k, (u, _) in REBASE.items() for x in (k, u)])
    by = F.create_map(*[F.lit(x) for k, (_, m) in REBASE.items() for x in (k, m)])
    molar = low.isin(*MOLAR)
    target = F.when(molar, "NEEDS_MW").otherwise(F.coalesce(F.try_element_at(unit, low), F.col("cur_target")))
    factor = F.when(~molar, F.col("ecotox_mult").cast("double") * F.coalesce(F.try_element_at(by, low), F.lit(1.0)))
    rows = raw.filter("orig is not null and cur_target is not null").select(F.col("orig").alias("from_unit"), target.alias("to_unit"), factor.alias("multiplier"), F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("concentration")).alias("category"), "ord")
    first = rows.groupBy("from_unit").agg(F.min_by(F.struct("to_unit", "multiplier", "category"), "ord").alias("r"))
    return first.select("from_unit", "r.*")


def validate_molar(table: DataFrame) -> None:
    if table.filter("to_unit = 'NEEDS_MW' and multiplier is not null").limit(1).count():
        raise ValueError("an amount of substance has a factor")


def coverage(units: DataFrame, targets: DataFrame) -> DataFrame:
    """n_targets, n_covered, percent, without regard to case."""
    have = units.select(F.lower("unit").alias("u")).distinct().withColumn("hit", F.lit(1))
    t = targets.select("unit").distinct().withColumn("u", F.lower("unit")).join(have, "u", "left")
    return t.agg(F.count("*").alias("n_targets"), F.count("hit").alias("n_covered"), F.round(100.0 * F.count("hit") / F.nullif(F.count("*"), F.lit(0)), 1).alias("percent"))


def uncovered(units: DataFrame, targets: DataFrame, n: int = 10) -> DataFrame:
    """The first n targets, by name, that no unit covers."""
    return targets.select("unit").distinct().join(units.select(F.lower("unit").alias("_u")).distinct(), F.lower("unit") == F.col("_u"), "left_anti").orderBy("unit").limit(n)


def passed_through(table: DataFrame, results: DataFrame) -> DataFrame:
    """The table with unmatched units of results mapped to themselves."""
    new = results.filter("unit_flag = 'unmatched' and orig_unit is not null").select(F.trim("orig_unit").alias("from_unit")).distinct().join(table.select("from_unit"), "from_unit", "left_anti")
    return table.unionByName(new.select("from_unit", F.col("from_unit").alias("to_unit"), F.lit(1.0).alias("multiplier"), F.lit("user").alias("category")), allowMissingColumns=True)


def upserted(table: DataFrame, rows: DataFrame, key: str = "from_unit") -> DataFrame:
    """The table with rows in place of those of equal keys."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def changed_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """from_unit values whose mapping is new or differs: only their rows need converting again."""
    cols = ["from_unit", "to_unit", "multiplier"]
    return new.select(*cols).exceptAll(old.select(*cols)).select("from_unit").distinct()


def reharmonized(results: DataFrame, changed: DataFrame, table: DataFrame, harmonize, unit: str = "orig_unit") -> DataFrame:
    """results with the rows converted again whose unit is among changed, or was unmatched; all others stay as they are.

    harmonize: rows of results without its own columns, and the table, to rows with them.
    """
    from ..functions.units import OUTPUTS

    stale = changed.select(F.lower(F.trim("from_unit")).alias("_u")).distinct().withColumn("_stale", F.lit(True))
    marked = results.withColumn("_u", F.lower(F.trim(unit))).join(F.broadcast(stale) if stale.limit(200_001).count() <= 200_000 else stale, "_u", "left")
    again = F.coalesce(F.col("_stale"), F.lit(False)) | (F.col("unit_flag") == "unmatched")
    fresh = marked.filter(again).drop("_u", "_stale").withColumn("_unit", F.col(unit)).drop(*OUTPUTS)
    return marked.filter(~again).select(*results.columns).unionByName(harmonize(fresh, table).select(*results.columns))
