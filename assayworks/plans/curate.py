"""A whole run: file to curated, harmonised and mapped tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, units
from ..operators import cleaning, consensus, detection, matching, measurements, media, review, shape, toxval
from ..operators import tags as tagging
from ..operators.audit import Step
from ..sources import files
from ..sources.shared import stored


@dataclass
class Curated:
    data: DataFrame
    audit: DataFrame
    tags: dict[str, str]
    harmonized: DataFrame | None = None
    toxval: DataFrame | None = None
    summary: DataFrame | None = None


def loaded(spark: SparkSession, path: str, header_row: int | None = None) -> tuple[DataFrame, shape.Start]:
    """Rows under clean names, with original_row_id; and where the data was found to start."""
    grid = files.read(spark, path)
    start = shape.detect_start(grid, header_row)
    df = shape.without_empty(shape.sliced(grid, start))
    df = shape.merged_cells_filled(df)
    names = shape.clean_names(shape.value_columns(df))
    df = df.toDF("_row", *names)
    return cleaning.with_row_ids(df.drop("_row")), start


def identified(df: DataFrame, tags: dict[str, str], catalog: DataFrame, dictionary: DataFrame | None = None, starts_with: bool = False, threshold: float = 0.85) -> DataFrame:
    """df with identities of its tagged columns, their consensus and quality tier. Blocked rows are not looked up."""
    skip = matching.blocked() if "cleaning_flag" in df.columns else None
    keys = matching.keyed(df, tags, skip=skip)
    values = lambda p: keys.filter(p).select(F.col("key").alias("search_value")).distinct()
    results = matching.tiered(values("tag <> 'CASRN'"), values("tag = 'CASRN'"), catalog, dictionary, starts_with, threshold)
    known = None
    if "isotope_dtxsid" in df.columns:
        name = next(c for c, t in tags.items() if t == "Name")
        known = df.filter("isotope_match and trim(isotope_dtxsid) <> ''").select("original_row_id", F.col("isotope_dtxsid").alias("dtxsid"), F.col(name).alias("name"))
    return consensus.with_state(consensus.classified(matching.mapped(df, tags, results, known)))


def harmonized(df: DataFrame, tags: dict[str, str], table: DataFrame, vocabulary: DataFrame | None = None, corrections=()) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """df with media, dates, durations and detection; the result's rows; all measurements' rows."""
    col = lambda kind: next((c for c, t in tags.items() if t == kind and c in df.columns), None)
    route = None
    if vocabulary is not None and col("Media"):
        df = media.harmonized(df, col("Media"), vocabulary)
        route = "media_category"
    if col("StudyDate"):
        df = dates.with_dates(df, col("StudyDate"))
    if col("Duration") and col("DurationUnit"):
        got = measurements.durations(df, col("Duration"), col("DurationUnit"), table)
        df = got.withColumnsRenamed({"harmonized_value": "duration_hours", "harmonized_unit": "duration_unit_out", "unit_flag": "duration_flag"}).drop("orig_unit", "conversion_factor")
    primary, every = measurements.tagged(df, tags, table, media=route, corrections=corrections)
    if primary is None:
        return df, measurements.identity(df), every
    joined = primary
    for role, name in (("ReportingLimit", "reporting_limit_value"), ("Uncertainty", "uncertainty_value")):
        if role in tags.values():
            joined = joined.join(detection.role_values(every, role).select("orig_row_id", F.col("value").alias(name)), "orig_row_id", "left")
    extra = df.select(F.col("original_row_id").alias("orig_row_id"), *([F.col(col("UncertaintyCoverage")).alias("uncertainty_coverage")] if col("UncertaintyCoverage") else []), *([detection.combined([F.col(c) for c, t in tags.items() if t == "Qualifier"]).alias("source_qualifier")] if col("Qualifier") else []))
    if len(extra.columns) > 1:
        joined = joined.join(extra, "orig_row_id", "left")
    events = detection.classified(joined.withColumn("result_unit", F.coalesce(F.nullif("harmonized_unit", F.lit("")), "orig_unit")), result="harmonized_value", qualifiers=("source_qualifier", "qualifier"))
    return detection.attached(df, detection.collapsed(events)), primary, every


def curate(spark: SparkSession, input_path: str, output_path: str | None = None, tags: dict[str, str] | None = None, header_row: int | None = None, references: dict | None = None, mask: dict[str, bool] | None = None, catalog: DataFrame | None = None, dictionary: DataFrame | None = None, unit_table: DataFrame | None = None, vocabulary: DataFrame | None = None, overrides=None, harmonize: bool = True, kind: str = "parquet", starts_with: bool = False, wqx_threshold: float = 0.85, source: str = "user_upload") -> Curated:
    """The headless run. Without tags they are taken from the headers."""
    df, _ = loaded(spark, input_path, header_row)
    tags = dict(tags) if tags else tagging.suggest([c for c in df.columns if c != "original_row_id"])
    # The cleaned table is kept once: its audit, the lookups and the measurements all read it.
    step = cleaning.run(stored(df, "loaded"), tags, references, mask)
    step = Step(stored(step.rows, "cleaned"), step.new_tags)
    tags = tags | step.new_tags
    # Synonyms share the row they were split from: the rows as they now are get ids of their own.
    data = cleaning.with_row_ids(step.data.withColumnRenamed("original_row_id", "source_row_id"))
    if catalog is not None:
        data = stored(identified(data, tags, catalog, dictionary, starts_with, wqx_threshold), "identified")
    data = review.replayed(data, overrides)
    out = Curated(data, step.audit, tags, summary=consensus.summary(data) if "consensus_status" in data.columns else None)
    if harmonize:
        table = unit_table if unit_table is not None else units.unit_map(spark, durations=True)
        out.data, out.harmonized, _ = harmonized(data, tags, table, vocabulary)
        out.toxval = toxval.mapped(out.data, out.harmonized, source, tags)
        toxval.assert_typed(out.toxval)
    if output_path and output_path.endswith(".xlsx"):
        state = files.session_state(out.data, out.summary, consensus.REVIEW) if out.summary is not None else None
        tables = {"Raw Data": df, "Cleaned Data": step.data, "Curated Data": out.data, "Summary": out.summary, "Cleaning Audit": out.audit, "Session State": state, "ToxVal Output": out.toxval, "Harmonization Audit": out.harmonized}
        files.write_export(files.export_sheets(spark, {k: v for k, v in tables.items() if v is not None}, tags, {"input_path": input_path, "source": source}), output_path)
    elif output_path:
        parts = {"curated": out.data, "audit": out.audit, "harmonized": out.harmonized, "toxval": out.toxval, "summary": out.summary}
        reduce(lambda _, p: files.write(p[1], f"{output_path}/{p[0]}", kind), [(k, v) for k, v in parts.items() if v is not None], None)
    return out
