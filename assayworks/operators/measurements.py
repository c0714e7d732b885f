"""Measurement columns to numbers in common units: corrections, parsing, conversion, for results and their companions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, units

AUXILIARY = ("Numeric", "ReportingLimit", "Uncertainty")
COLUMNS = ("orig_row_id", "ord", "orig_result", "numeric_value", "qualifier", "range_bin", "parse_flag", "orig_unit", "harmonized_value", "harmonized_unit", "conversion_factor", "unit_flag")


def corrected(column, corrections: Iterable[tuple[str, str]]):
    """Ordered pattern replacements; a pattern that does not compile is left out. Column to column, and what was left out."""
    bad = []
    for pattern, to in corrections:
        try:
            re.compile(pattern)
        except re.error:
            bad.append(pattern)
            continue
        column = F.regexp_replace(column, pattern, to)
    return column, bad


def column(df: DataFrame, value: str, role: str, table: DataFrame, unit: str | None = None, media: str | None = None, weight: str | None = None, corrections: Iterable[tuple[str, str]] = (), row_id: str = "original_row_id") -> DataFrame:
    """One column's rows, three for a range: COLUMNS and measurement_role. ord keeps their order."""
    fixed, _ = corrected(F.col(value).cast("string"), corrections)
    rows = df.select(F.col(row_id).alias("orig_row_id"), fixed.alias("_v"), (F.col(unit) if unit else F.lit(None).cast("string")).alias("_unit"), (F.col(media) if media else F.lit(None).cast("string")).alias("_media"), (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("_weight"))
    got = numeric.parsed(rows, "_v").drop("_v")
    got = got.withColumn("ord", F.col("orig_row_id") * 10 + F.when(F.col("range_bin") == "low", 1).when(F.col("range_bin") == "mid", 2).when(F.col("range_bin") == "high", 3).otherwise(0))
    if unit:
        got = units.harmonized(got, table, "numeric_value", "_unit", "_media", "_weight")
    else:
        got = got.withColumns({"orig_unit": F.lit(None).cast("string"), "harmonized_value": F.col("numeric_value"), "harmonized_unit": F.lit(""), "conversion_factor": F.lit(1.0), "unit_flag": F.lit("")})
    return got.select(*COLUMNS).withColumn("measurement_role", F.lit(role))


def tagged(df: DataFrame, tags: dict[str, str], table: DataFrame, **options) -> tuple[DataFrame | None, DataFrame | None]:
    """The first Result column's rows, and all measurement columns' rows with their roles."""
    unit = next((c for c, t in tags.items() if t == "Unit"), None)
    primary = next((c for c, t in tags.items() if t == "Result"), None)
    parts = [column(df, c, t if c != primary else "Result", table, unit, **options) for c, t in tags.items() if c == primary or t in AUXILIARY]
    if not parts:
        return None, None
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return (every.filter("measurement_role = 'Result'") if primary else None), every


def identity(df: DataFrame, row_id: str = "original_row_id") -> DataFrame:
    """A row without a value for each source row, where there is no result."""
    none = F.lit(None)
    return df.select(F.col(row_id).alias("orig_row_id"), (F.col(row_id) * 10).alias("ord"), *[none.cast(t).alias(c) for c, t in (("orig_result", "string"), ("numeric_value", "double"), ("qualifier", "string"), ("range_bin", "string"))], F.lit("").alias("parse_flag"), none.cast("string").alias("orig_unit"), none.cast("double").alias("harmonized_value"), F.lit("").alias("harmonized_unit"), F.lit(1.0).alias("conversion_factor"), F.lit("").alias("unit_flag"))


def durations(df: DataFrame, value: str, unit: str, table: DataFrame) -> DataFrame:
    """df + value and unit in hours, as the unit table's duration rows have them."""
    parsed = df.withColumn("_d", numeric.as_number(numeric.normalized(F.col(value).cast("string"))))
    return units.harmonized(parsed, table, "_d", unit, category="duration").drop("_d")
