"""Numbers as people write them: normal form, qualifiers, narrative values and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that say no number was found.
NARRATIVE = ("bdl", "nd", "non-detect", "nondetect", "trace", "not detected", "below detection", "below quantitation", "bql", "lod", "loq")
QUALIFIER = r"^\s*(<=|>=|<|>|~|=)\s*(.*)"
_NUMBER = r"-?\d+\.?\d*(?:[eE][+-]?\d+)?"
RANGE = rf"^({_NUMBER})\s*-\s*({_NUMBER})$"
FORTRAN = r"^[+-]?[0-9]+\.[0-9]+[+-][0-9]+$"
PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_number(c: Column) -> Column:
    """A double, or null; type suffixes that casts would take (1d, 1f) are no numbers."""
    return F.when(c.rlike(PLAIN), F.trim(c).try_cast("double"))


def _where(holds: Column, made: Column, c: Column) -> Column:
    """made where the cheap test holds: a pattern is run only on values that can match."""
    return F.when(holds, made).otherwise(c)


def spelled(c: Column) -> Column:
    """Signs, powers of ten, thousands commas and white space in one spelling."""
    c = F.replace(F.replace(c, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))
    c = F.regexp_replace(c, r"[xX]10\^|\s+|(?<=\d),(?=\d)", "\u0001$0")
    # what was found is marked, then named by its first character
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\u0001[xX]10\\^", "e"), "\u0001\\s+", " "), "\u0001,", "")
    return F.trim(c)


def _spelled(c: Column) -> Column:
    """spelled, at the cost of one search where there is nothing to change."""
    return _where(c.rlike(r"[≥≤\s,^]"), spelled(c), c)


def normalized(c: Column) -> Column:
    """As spelled, and with an exponent sign alone (4.56+02) made a full exponent."""
    alone = c.rlike(r"\d[+-]\d+$") & ~c.rlike(r"[eE]|[xX]10\^")
    return _spelled(_where(alone, F.regexp_replace(c, r"(\d)([+-])(\d+)$", "$1e$2$3"), c))


def qualifier(c: Column) -> Column:
    return F.regexp_extract(c, QUALIFIER, 1)


def remainder(c: Column) -> Column:
    return F.when(c.rlike(QUALIFIER), F.regexp_extract(c, QUALIFIER, 2)).otherwise(c)


def is_narrative(c: Column) -> Column:
    t = F.trim(c)
    return t.isNull() | (t == "") | F.lower(t).isin(*NARRATIVE)


def _range(s: Column) -> Column:
    """lo and hi of a spelled value, or null."""
    is_range = s.contains("-") & ~s.rlike(r"^\s*[<>~=]") & s.rlike(RANGE) & ~(~s.rlike("[eE]") & s.rlike(FORTRAN))
    return F.when(is_range, F.struct(as_number(F.regexp_extract(s, RANGE, 1)).alias("lo"), as_number(F.regexp_extract(s, RANGE, 2)).alias("hi")))


def range_of(c: Column) -> Column:
    """A struct of lo and hi for an unqualified range, else null; lo may exceed hi. Seen before exponent signs are completed."""
    return _range(_spelled(c))


def parsed(df: DataFrame, value: str) -> DataFrame:
    """df + orig_result, numeric_value, qualifier, range_bin, parse_flag: a row for each value, three for a range.

    Each step is a projection of its own, so every pattern is searched once for a value.
    """
    raw = F.col(value).cast("string")
    df = df.withColumns({"orig_result": raw, "_s": _spelled(raw), "_n": normalized(raw)})
    df = df.withColumns({"_range": _range(F.col("_s")), "_q": F.when(F.col("_n").rlike(r"^\s*[<>~=]"), qualifier(F.col("_n"))).otherwise("")})
    rest = F.when(F.col("_q") != "", F.ltrim(F.substring(F.ltrim("_n"), F.length("_q") + 1, F.length("_n")))).otherwise(F.col("_n"))
    df = df.withColumn("_rest", rest)
    df = df.withColumn("_narrative", is_narrative(F.col("_rest")))
    df = df.withColumns({"_number": F.when(~F.col("_narrative"), as_number(F.col("_rest"))), "_q": F.coalesce("_q", F.lit(""))})
    lo, hi = F.col("_range.lo"), F.col("_range.hi")
    bins = F.when(lo.isNotNull() & hi.isNotNull(), F.array(F.lit("low"), F.lit("mid"), F.lit("high"))).otherwise(F.array(F.lit("as_is")))
    # The generator's own filter on empty arrays would be pushed below all steps, with a copy of each for every use; the row
    # number keeps it here.
    df = df.withColumn("_bins", bins if df.isStreaming else F.when(F.monotonically_increasing_id() >= 0, bins))
    own = ("_s", "_n", "_range", "_q", "_rest", "_number", "_narrative", "_bins", "range_bin")
    kept = [c for c in df.columns if c not in own]
    df = df.select(*kept, "_range", "_q", "_number", "_narrative", F.explode("_bins").alias("range_bin"))
    bin_ = F.col("range_bin")
    value = F.when(bin_ == "as_is", F.col("_number")).when(bin_ == "low", lo).when(bin_ == "high", hi).otherwise((lo + hi) / 2)
    sign = F.when(bin_ == "as_is", F.col("_q")).when(bin_ == "low", ">=").when(bin_ == "high", "<=").otherwise("~")
    flag = F.when(bin_ != "as_is", "").when(F.col("_narrative"), "narrative").when(F.col("_number").isNull(), "unparseable").otherwise("")
    return df.select(*kept, value.alias("numeric_value"), sign.alias("qualifier"), "range_bin", flag.alias("parse_flag"))
