"""The fixed output of 56 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The output's columns in order, and those that are numbers.
COLUMNS = (
    "dtxsid casrn name source sub_source toxval_type toxval_subtype toxval_type_supercategory qualifier toxval_numeric toxval_units risk_assessment_class study_type study_duration_class study_duration_value study_duration_units "
    "species_common strain latin_name species_supercategory sex generation lifestage exposure_route exposure_method exposure_form media toxicological_effect toxicological_effect_category experimental_record study_group year "
    "qc_category qc_status source_hash source_url subsource_url toxval_type_original toxval_subtype_original toxval_numeric_original toxval_units_original study_type_original study_duration_class_original "
    "study_duration_value_original study_duration_units_original species_original strain_original sex_original generation_original lifestage_original exposure_route_original exposure_method_original exposure_form_original "
    "media_original toxicological_effect_original original_year"
).split()
NUMBERS = ("toxval_numeric", "study_duration_value", "year", "toxval_numeric_original", "study_duration_value_original", "original_year")
FALLBACK = {"dtxsid": ("consensus_dtxsid", "dtxsid"), "casrn": ("casrn", "cas"), "name": ("name", "analyte", "chemical", "chemical_name"), "species_original": ("species_original", "species_common"), "original_year": ("original_year", "year")}
DEFAULTS = {"qc_category": "user_curated", "qc_status": "pass"}
SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in NUMBERS else T.StringType()) for c in COLUMNS])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def row_hash(cols: list[str]) -> Column:
    """sha256 of the values joined by |, nulls as NA."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols]), 256)


def mapped(curated: DataFrame, harmonized: DataFrame, source: str = "user_upload", tags: dict[str, str] | None = None, row_id: str = "original_row_id") -> DataFrame:
    """A row for each harmonised row, with its source row's columns. harmonized: orig_row_id, harmonized_value, harmonized_unit, orig_unit."""
    have = set(curated.columns) - {row_id}
    extra = {"casrn": [c for c, t in (tags or {}).items() if t in ("CASRN", "CAS")], "name": [c for c, t in (tags or {}).items() if t == "Name"]}
    left = harmonized.select(F.col("orig_row_id").alias("_id"), *[F.col(c).alias(f"_h_{c}") for c in harmonized.columns if c != "orig_row_id"])
    rows = left.join(curated, F.col("_id") == F.col(row_id))

    def pick(name: str) -> Column:
        kind = "double" if name in NUMBERS else "string"
        options = [*FALLBACK.get(name, (name, name.removesuffix("_original"))), *extra.get(name, [])]
        got = [F.col(c).try_cast(kind) for c in dict.fromkeys(options) if c in have]
        if not got:
            return F.lit(DEFAULTS.get(name)).cast(kind)
        if kind == "string" and len(got) > 1:
            return F.coalesce(*[F.nullif(c, F.lit("")) for c in got[:-1]], got[-1])
        return got[0]

    own = {"toxval_numeric": F.col("_h_harmonized_value").cast("double"), "toxval_units": F.col("_h_harmonized_unit"), "toxval_units_original": F.col("_h_orig_unit"), "source": pick("source") if "source" in have else F.lit(source), "source_hash": F.lit(None).cast("string")}
    if "numeric_value_original" in harmonized.columns:
        own["toxval_numeric_original"] = F.col("_h_numeric_value_original").try_cast("double")
    elif "orig_result" in have:
        own["toxval_numeric_original"] = F.regexp_replace("orig_result", "[<>=~]", "").try_cast("double")
    else:
        own["toxval_numeric_original"] = F.col("_h_harmonized_value").cast("double")
    out = rows.select(*[own.get(c, pick(c) if c not in own else None).alias(c) for c in COLUMNS])
    return out.withColumn("source_hash", row_hash([c for c in COLUMNS if c != "source_hash"]))


def assert_typed(df: DataFrame) -> None:
    """Refuses columns of the wrong type, booleans and voids above all."""
    wrong = [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields if f.name in COLUMNS and f.dataType != SCHEMA[f.name].dataType]
    if wrong:
        raise TypeError(", ".join(wrong))
