"""Results against reporting limits: one wide projection of conditions, and its collapse to source rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import is_radiological

ONE_SIGMA, TWO_SIGMA = ("one_sigma", "1_sigma", "1sigma", "k=1"), ("two_sigma", "2_sigma", "2sigma", "k=2")
RESERVED = "result_flag"
ANY_TRUE = ("result_flag", "detected_binary", "reportable_detect_binary", "detection_review_flag", "qualifier_followup_flag", "numeric_followup_flag")


def two_sigma(value: Column, coverage: Column) -> Column:
    v = F.when(value >= 0, value)
    return F.when(F.lower(F.trim(coverage)).isin(*ONE_SIGMA), v * 2).otherwise(v)


def combined(cols: list[Column]) -> Column:
    """Distinct non-blank values joined by `; `, or null."""
    if not cols:
        return F.lit(None).cast("string")
    kept = F.array_distinct(F.filter(F.array(*[F.trim(c.cast("string")) for c in cols]), lambda x: F.coalesce(x != "", F.lit(False))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def reasons(flags: dict[str, Column]) -> Column:
    got = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return F.when(F.size(got) > 0, F.array_join(got, "; "))


def classified(df: DataFrame, result: str = "result_value", limit: str = "reporting_limit_value", uncertainty: str = "uncertainty_value", qualifiers: tuple[str, ...] = ("qualifier", "result_qualifier"), measurement_type: str = "measurement_type", coverage: str = "uncertainty_coverage", unit: str = "result_unit", operator: str = ">") -> DataFrame:
    """df + bounds, flags, class, basis, conflict and follow-up reasons of every result."""
    if RESERVED in df.columns:
        raise ValueError(f"{RESERVED} is a reserved column")
    if operator not in (">", ">="):
        raise ValueError("the operator is > or >=")
    get = lambda name, kind: F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
    false = F.lit(False)
    sure = lambda c: F.coalesce(c, false)
    # Inputs in a projection of their own, then bounds, then conditions: each is evaluated once.
    rad_unit = is_radiological(get(unit, "string"))
    own = get(measurement_type, "string")
    kind = F.when(F.trim(own) != "", own).otherwise(F.when(rad_unit, "radiological_activity").otherwise("chemical_concentration"))
    cov = F.lower(F.trim(F.coalesce(get(coverage, "string"), F.lit(""))))
    x = df.withColumns({"_r": get(result, "double"), "_l": get(limit, "double"), "_raw": get(uncertainty, "double"), "_cov": cov, "detection_measurement_type": kind, "_radu": rad_unit})
    x = x.withColumns({"_u": two_sigma(F.col("_raw"), F.col("_cov")), "_rad": F.col("_radu") | F.col("detection_measurement_type").startswith("radiological"), "qualifier_followup_values": combined([F.col(q) for q in qualifiers if q in df.columns])})
    r, l, u, rad = F.col("_r"), F.col("_l"), F.col("_u"), F.col("_rad")
    x = x.withColumns({"lower_2sigma": r - u, "upper_2sigma": r + u})
    lo, hi = F.col("lower_2sigma"), F.col("upper_2sigma")
    positive, above = sure(r > 0), sure(r >= l if operator == ">=" else r > l)
    x = x.withColumns({
        "above_reporting_limit": above,
        "interval_above_reporting_limit": sure(lo >= l),
        "interval_crosses_reporting_limit": sure((lo < l) & (hi >= l)),
        "interval_above_zero": sure(lo > 0),
        "relative_uncertainty": F.when(r != 0, u / F.abs(r)),
        "signal_to_uncertainty_ratio": F.when(u > 0, r / (u / 2)),
        "result_flag": positive & (l.isNull() | above),
        "invalid_uncertainty_flag": sure(F.col("_raw") < 0),
        "missing_reporting_limit_flag": l.isNull(),
    })
    flag, bad, crosses = F.col("result_flag"), F.col("invalid_uncertainty_flag"), F.col("interval_crosses_reporting_limit")
    inside, over_zero, has = F.col("interval_above_reporting_limit"), F.col("interval_above_zero"), u.isNotNull()
    chain = lambda rows, other: reduce(lambda a, b: a.when(b[0], b[1]), rows[1:], F.when(*rows[0])).otherwise(other)
    event = chain([(r.isNull(), "indeterminate"), (rad & (r < 0), "negative_reported_non_detect"), (r < 0, "review_required"), (bad, "review_required"), (l.isNull() & positive, "review_required"), (flag & has & inside, "robust_reportable_detect"), (flag & has, "estimated_reportable_detect"), (flag, "robust_reportable_detect"), (positive & has & crosses, "threshold_ambiguous"), (positive & has & over_zero, "positive_below_reporting_limit")], "non_reportable")
    basis = chain([(r.isNull(), "missing_result"), (rad & (r < 0), "negative_background_subtracted_result"), (r < 0, "negative_non_radiological_result"), (bad, "invalid_negative_uncertainty"), (l.isNull() & positive, "positive_result_missing_reporting_limit"), (l.isNull(), "missing_reporting_limit"), (flag & has & inside, "positive_result_above_reporting_limit_interval_above_limit"), (flag & has, "positive_result_above_reporting_limit_interval_crosses_limit"), (flag, "positive_result_above_reporting_limit"), (positive & has & crosses, "result_below_reporting_limit_interval_overlaps_limit"), (positive & has & over_zero, "positive_result_below_reporting_limit"), (positive, "result_at_or_below_reporting_limit")], "non_positive_result")
    x = x.withColumns({"detection_event_class": event, "detection_basis": basis})
    name = F.col("detection_event_class")
    why = reasons({
        "missing_result": r.isNull(),
        "positive_result_missing_reporting_limit": l.isNull() & positive,
        "negative_non_radiological_result": ~rad & sure(r < 0),
        "invalid_negative_uncertainty": bad,
        "radiological_result_without_uncertainty": rad & positive & ~has,
        "unknown_uncertainty_coverage": rad & has & ~F.col("_cov").isin(*ONE_SIGMA, *TWO_SIGMA),
        "threshold_ambiguous": name == "threshold_ambiguous",
        "positive_below_reporting_limit": name == "positive_below_reporting_limit",
    })
    x = x.withColumns({"detection_conflict": F.when(~rad & sure(r < 0), "negative_non_radiological_result").when(bad, "invalid_negative_uncertainty"), "numeric_followup_reason": why, "qualifier_followup_flag": F.col("qualifier_followup_values").isNotNull(), "detected_binary": flag, "reportable_detect_binary": flag})
    x = x.withColumn("numeric_followup_flag", F.col("numeric_followup_reason").isNotNull())
    review = F.col("qualifier_followup_flag") | F.col("numeric_followup_flag") | name.isin("review_required", "threshold_ambiguous", "positive_below_reporting_limit", "indeterminate")
    return x.withColumn("detection_review_flag", review).drop("_r", "_l", "_raw", "_cov", "_radu", "_u", "_rad")


def role_values(audit: DataFrame, role: str) -> DataFrame:
    """orig_row_id, value (the first by ord) and whether several differ, of one measurement role."""
    rows = audit.filter((F.col("measurement_role") == role) & F.col("harmonized_value").isNotNull())
    return rows.groupBy("orig_row_id").agg(F.min_by("harmonized_value", "ord").alias("value"), (F.count_distinct("harmonized_value") > 1).alias("multiple"))


def collapsed(expanded: DataFrame, row_id: str = "orig_row_id", order: str = "ord") -> DataFrame:
    """One row for each source row: its first, with any-true flags; several classes mean review."""
    first = [c for c in ("detection_event_class", "detection_basis", "detection_conflict", "numeric_followup_reason", "qualifier_followup_values", "detection_measurement_type") if c in expanded.columns]
    got = expanded.groupBy(row_id).agg(F.min_by(F.struct(*first), order).alias("f"), *[F.bool_or(c).alias(c) for c in ANY_TRUE if c in expanded.columns], (F.count_distinct("detection_event_class") > 1).alias("_many"))
    many = F.col("_many")
    why = F.when(many, F.concat_ws("; ", F.nullif(F.col("f.numeric_followup_reason"), F.lit("")), F.lit("multiple_result_values"))).otherwise(F.col("f.numeric_followup_reason"))
    plain = [c for c in ANY_TRUE if c in expanded.columns and c not in ("numeric_followup_flag", "detection_review_flag")]
    return got.select(
        row_id, *plain, (F.col("numeric_followup_flag") | many).alias("numeric_followup_flag"), (F.col("detection_review_flag") | many).alias("detection_review_flag"),
        F.when(many, "review_required").otherwise(F.col("f.detection_event_class")).alias("detection_event_class"), F.when(many, "multiple_result_values").otherwise(F.col("f.detection_basis")).alias("detection_basis"), why.alias("numeric_followup_reason"),
        *[F.col(f"f.{c}").alias(c) for c in first if c not in ("detection_event_class", "detection_basis", "numeric_followup_reason")],
    )


def attached(df: DataFrame, rows: DataFrame, row_id: str = "original_row_id") -> DataFrame:
    """df with the collapsed columns in place of any of these names it has."""
    new = [c for c in rows.columns if c != "orig_row_id"]
    return df.drop(*new).join(rows.withColumnRenamed("orig_row_id", row_id), row_id, "left")


def undetermined(df: DataFrame, row_id: str = "original_row_id") -> DataFrame:
    """A row of the collapsed columns for each source row where there is no result."""
    text = {"detection_event_class": "indeterminate", "detection_basis": "missing_result", "detection_conflict": None, "numeric_followup_reason": "missing_result", "qualifier_followup_values": None, "detection_measurement_type": "chemical_concentration"}
    flags = {c: c in ("numeric_followup_flag", "detection_review_flag") for c in ANY_TRUE}
    return df.select(F.col(row_id).alias("orig_row_id"), *[F.lit(v).cast("string").alias(c) for c, v in text.items()], *[F.lit(v).alias(c) for c, v in flags.items()])
