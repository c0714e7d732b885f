"""Reference lists: terms with patterns and modes, defaults, and what users change in them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "term string, pattern string, match_mode string, source string, active boolean, notes string"
MODES = ("literal_exact", "literal_word", "regex")
# The default lists.
STOP_WORDS = ("test", "sample", "unknown", "blank", "standard", "control", "reference", "placeholder", "tbd", "tba", "na", "n/a", "none", "not available", "not applicable")
BLOCK_PATTERNS = (r"^\s*$", r"^-+$", r"^[.]+$", r"^proprietary", r"^confidential", r"^trade\s*secret", r"^not\s+disclosed")
STRIP_TERMS = ("pure", "purified", "technical", "grade", "chemical", "and its salts", r"and its \w+ salts", "unspecified")
TYPES = {"stop_words": STOP_WORDS, "block_patterns": BLOCK_PATTERNS, "strip_terms": STRIP_TERMS}
_REGEX = re.compile(r"[\\^$.|?*+()\[\]{}]")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def list_type(label: str) -> str:
    """stop word, Stop Words, stop_words ... to stop_words."""
    key = re.sub(r"[\s-]+", "_", label.strip().lower())
    for name in (*TYPES, "functional"):
        if key in (name, name.rstrip("s")):
            return name
    raise ValueError(f"no such list: {label}")


def default_mode(kind: str | None, term: str) -> str:
    if kind == "block_patterns" or (kind == "strip_terms" and _REGEX.search(term)):
        return "regex"
    return "literal_word"


def normalized(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Terms trimmed, blank ones gone, patterns and modes filled in; unknown modes are refused."""
    missing = {"term", "source", "active"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    get = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    token = F.col("term").rlike(_REGEX.pattern)
    mode = F.lit("regex") if kind == "block_patterns" else F.when(token, "regex").otherwise("literal_word") if kind == "strip_terms" else F.lit("literal_word")
    out = df.select(F.trim("term").alias("term"), get("pattern").alias("pattern"), get("match_mode").alias("match_mode"), "source", F.col("active").cast("boolean").alias("active"), get("notes").alias("notes")).filter("term <> ''")
    out = out.withColumns({"pattern": F.coalesce("pattern", "term"), "match_mode": F.coalesce("match_mode", mode)})
    if wrong := out.filter(~F.col("match_mode").isin(*MODES)).limit(1).collect():
        raise ValueError(f"no such mode: {wrong[0]['match_mode']}")
    return out


def default_list(spark: SparkSession, kind: str) -> DataFrame:
    rows = [(t, t, default_mode(kind, t), "app_default", True, None) for t in TYPES[kind]]
    return spark.createDataFrame(rows, SCHEMA)


def as_terms(df: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """(mode, pattern) of the active rows, for the flagging and stripping steps."""
    rows = df.filter("active").select("match_mode", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a list this long belongs in first_match()")
    return [tuple(r) for r in rows]


def as_rules(df: DataFrame, most: int = 10_000) -> list[tuple[str, str, str, str]]:
    """(mode, pattern, term, source) of the active rows, by term, for the flagging step, whose log names term and source."""
    rows = df.filter("active").select("match_mode", "pattern", "term", "source").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a list this long belongs in first_match()")
    return [tuple(r) for r in rows]


def problems(df: DataFrame, kind: str | None = None, most: int = 100_000) -> list[tuple[str, str, str]]:
    """(level, term, message): patterns that are empty or do not compile, and block patterns that match too much."""
    out = []
    rows = df.filter("match_mode = 'regex'").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    for r in rows:
        if r["match_mode"] != "regex":
            continue
        if not (r["pattern"] or "").strip():
            out.append(("error", r["term"], "empty pattern"))
            continue
        try:
            re.compile(r["pattern"])
        except re.error as e:
            out.append(("error", r["term"], f"invalid pattern: {e}"))
            continue
        if kind == "block_patterns" and not r["pattern"].startswith("^") and not _REGEX.search(r["pattern"]):
            out.append(("warning", r["term"], "not anchored"))
        if kind == "block_patterns" and len(r["pattern"]) < 4 and not r["pattern"].startswith("^"):
            out.append(("warning", r["term"], "short pattern"))
    return out


def _one_each(df: DataFrame, order: str | None = None) -> DataFrame:
    """A row of each term: the first by order, then by all its columns, so that runs agree."""
    rest = [c for c in COLUMNS if c != "term"]
    by = F.struct(*([order] if order else []), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])
    return df.groupBy("term").agg(F.min_by(F.struct(*rest), by).alias("r")).select("term", "r.*")


def merged(default: DataFrame, user: DataFrame) -> DataFrame:
    """Rows of both; the user's win by term."""
    return _one_each(default.withColumn("_o", F.lit(1)).unionByName(user.withColumn("_o", F.lit(0)), allowMissingColumns=True), "_o")


def imported(lists: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """The lists with rows of an import (type and a list's columns), which win by term and are marked as imported."""
    kinds = [r["type"] for r in rows.select("type").distinct().limit(100).collect()]
    out = dict(lists)
    for label in kinds:
        kind = list_type(label)
        new = normalized(rows.filter(F.col("type") == label).withColumn("source", F.lit("imported")), kind)
        out[kind] = merged(out[kind], new) if kind in out else new
    return out


def activated(df: DataFrame) -> DataFrame:
    return df.withColumn("active", F.lit(True))


def updated(df: DataFrame, spark: SparkSession, term: str, action: str = "add", active: bool = True, pattern: str | None = None, mode: str | None = None, notes: str | None = None, kind: str | None = None) -> DataFrame:
    """Adds, removes or toggles a term."""
    if action == "remove":
        return df.filter(F.col("term") != term)
    if action == "toggle":
        return df.withColumn("active", F.when(F.col("term") == term, ~F.col("active")).otherwise(F.col("active")))
    if action != "add":
        raise ValueError(f"no such action: {action}")
    row = spark.createDataFrame([(term.strip(), pattern or term.strip(), mode or default_mode(kind, term), "user", active, notes)], SCHEMA)
    if bad := [p for p in problems(row, kind) if p[0] == "error"]:
        raise ValueError(bad[0][2])
    return merged(df, row)


def snapshot_hash(df: DataFrame) -> str:
    """sha256 over the rows, whatever their order: row hashes are summed as two halves and hashed again."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in COLUMNS]), 256)
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    got = _one_each(df).agg(F.sha2(F.concat_ws("|", half(1), half(13), F.count("*").cast("string")), 256)).first()
    return got[0]


def overrides(df: DataFrame, default: DataFrame) -> DataFrame:
    """Rows that are new or differ from the defaults."""
    return df.select(*COLUMNS).exceptAll(default.select(*COLUMNS))


def reconstructed(default: DataFrame, changed: DataFrame, expected_hash: str | None = None) -> DataFrame:
    if expected_hash is not None and snapshot_hash(default) != expected_hash:
        raise ValueError("the defaults have changed since the snapshot")
    return merged(default, changed)


def functional_categories(df: DataFrame, column: str = "category") -> DataFrame:
    """term of each category without its agency mark; aliases in parentheses are terms of their own."""
    name = F.trim(F.regexp_replace(column, r"\s*\(EPA\)\s*", " "))
    inner = F.regexp_extract(name, r"\(([^)]*)\)", 1)
    parts = F.concat(F.array(F.trim(F.regexp_replace(name, r"\([^)]*\)", ""))), F.filter(F.transform(F.split(inner, "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(F.explode(parts).alias("term")).filter("term <> ''").distinct()


def save(df: DataFrame, path: str) -> None:
    """Writes what is not a default, one row of each term."""
    _one_each(df.filter("source <> 'app_default'")).write.mode("overwrite").parquet(path)


def user_list(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """What users changed in a list, from its table in a folder; nothing where there is none or it cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        return normalized(spark.read.parquet(f"{folder.rstrip('/')}/{kind}.parquet"), kind)
    except (AnalysisException, ValueError):
        return spark.createDataFrame([], SCHEMA)


def save_user_lists(lists: dict[str, DataFrame], folder: str) -> None:
    for kind, df in lists.items():
        save(df, f"{folder.rstrip('/')}/{kind}.parquet")


def all_lists(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    """Every list by name: the defaults, under what users changed."""
    out = {k: default_list(spark, k) for k in TYPES} | {"functional": spark.createDataFrame([], SCHEMA)}
    return {k: merged(v, user_list(spark, folder, k)) for k, v in out.items()} if folder else out


#: Synonyms of units where a folder has no table of them, and other spellings of elements' names.
UNIT_SYNONYMS = (("mg/kg bw/day", "mg/kg/d"), ("ug/kg bw/day", "ug/kg/d"))
ELEMENT_NAMES = {"cesium": "Caesium", "aluminum": "Aluminium", "sulfur": "Sulphur"}


def corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pattern string, replacement string")


def corrected_list(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """The corrections with one added, in place of one of the same pattern."""
    new = df.sparkSession.createDataFrame([(pattern, replacement)], df.schema)
    return df.filter(F.col("pattern") != pattern).unionByName(new)


def unit_synonyms(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """input_pattern, normalized_unit, is_regex, notes: a table's rows, or the smallest that works."""
    if table is not None:
        return table.select("input_pattern", "normalized_unit", F.col("is_regex").cast("boolean").alias("is_regex"), "notes")
    return spark.createDataFrame([(a, b, False, "body weight qualifier") for a, b in UNIT_SYNONYMS], "input_pattern string, normalized_unit string, is_regex boolean, notes string")


def isotope_lookup(isotopes: DataFrame) -> DataFrame:
    """symbol, mass, element_name, shortcode, canonical, dtxsid: one row of each shortcode, long symbols first.

    isotopes: element, Z, Name and, where known, DTXSID.
    """
    ids = F.col("DTXSID") if "DTXSID" in isotopes.columns else F.lit(None).cast("string")
    rows = isotopes.select(F.col("element").alias("symbol"), F.col("Z").cast("string").alias("mass"), F.col("Name").alias("element_name"), ids.alias("dtxsid"))
    rows = rows.groupBy(F.lower(F.concat("symbol", "mass")).alias("shortcode")).agg(F.min(F.struct("symbol", "mass", "element_name", "dtxsid")).alias("r"))
    got = rows.select("r.symbol", "r.mass", "r.element_name", "shortcode", F.concat_ws("-", "r.element_name", "r.mass").alias("canonical"), "r.dtxsid")
    return got.orderBy(F.length("symbol").desc(), "shortcode")


HELP = {"stop_words": "terms that are no names; an exact match or a whole word is flagged as a warning", "block_patterns": "regular expressions; what they match is kept from look-ups", "strip_terms": "words or regular expressions that are cut out of names", "functional": "categories of use; names that are one are flagged as a warning"}


def help_text(kind: str) -> str:
    return HELP[list_type(kind)]


def wqx_dictionary(canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, canonical_name, type: the names themselves and aliases of the three kinds in use."""
    kind = F.lower("alias_type")
    short = F.when(kind.contains("standard"), "standardize").when(kind.contains("synonym"), "synonym").when(kind.contains("retired"), "retired")
    own = canonical.select(F.col("name"), F.col("name").alias("canonical_name"), F.lit("canonical").alias("type"))
    return own.unionByName(aliases.select("name", "canonical_name", short.alias("type")).filter("type is not null"))
