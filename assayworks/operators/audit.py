"""What a cleaning step returns, and the log of what it changed."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import string_columns

AUDIT_SCHEMA = "row_id int, field string, step string, original_value string, new_value string, reason string"


LOG = "_audit"
_ENTRY = "array<struct<field:string,step:string,original_value:string,new_value:string,reason:string>>"


@dataclass
class Step:
    """A step's rows, each with the log of its own changes so far, and the tags of columns that were added.

    The log travels in a column, so a chain of steps is one pass over the table and its audit another, however long it is.
    """

    rows: DataFrame
    new_tags: dict[str, str] = field(default_factory=dict)

    @property
    def data(self) -> DataFrame:
        return self.rows.drop(LOG)

    @property
    def audit(self) -> DataFrame:
        """row_id, field, step, original_value, new_value, reason of every cell changed."""
        got = self.rows.select(F.col("original_row_id").cast("int").alias("row_id"), F.explode(LOG).alias("c"))
        return got.select("row_id", "c.*")


def logged(df: DataFrame) -> DataFrame:
    return df if LOG in df.columns else df.withColumn(LOG, F.array().cast(_ENTRY))


def entries(pairs: dict[str, tuple[Column, Column]], step: str, reason: Column | str) -> Column:
    """The log of the fields whose value before and after differ, both being present. pairs: field to (before, after)."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    cells = [F.when(a != b, F.struct(F.lit(n).alias("field"), F.lit(step).alias("step"), a.cast("string").alias("original_value"), b.cast("string").alias("new_value"), why.alias("reason"))) for n, (a, b) in pairs.items()]
    return F.array_compact(F.array(*cells)).cast(_ENTRY)


def empty_audit(spark: SparkSession) -> DataFrame:
    return spark.sql("select " + ", ".join(f"cast(null as {t}) {n}" for n, t in (x.split() for x in AUDIT_SCHEMA.split(", "))) + " where false")


def changes(df: DataFrame, pairs: dict[str, tuple[Column, Column]], step: str, reason: Column | str, row_id: str = "original_row_id") -> DataFrame:
    """The log of a table of before and after values, as rows."""
    if not pairs:
        return empty_audit(df.sparkSession)
    got = df.select(F.col(row_id).cast("int").alias("row_id"), F.explode(entries(pairs, step, reason)).alias("c"))
    return got.select("row_id", "c.*")


def stepped(df: DataFrame, new: dict[str, Column], step: str, reason: str, audited: list[str] | None = None, shown=lambda c: c, tags: dict[str, str] | None = None) -> Step:
    """df with columns replaced or added by expressions over it, and the log of the audited ones.

    New values are made in a projection of their own, so each is evaluated once for the column and its log.
    """
    df = logged(df)
    audited = [c for c in (audited if audited is not None else new) if c in df.columns]
    made = df.withColumns({f"_new_{c}": e for c, e in new.items()})
    log = F.concat(LOG, entries({c: (F.col(c), shown(F.col(f"_new_{c}"))) for c in audited}, step, reason)) if audited else F.col(LOG)
    kept = [F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in df.columns if c != LOG]
    return Step(made.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in new if c not in df.columns], log.alias(LOG)), tags or {})


def skipped(df: DataFrame) -> Step:
    return Step(logged(df))


#: Distinct keys up to this count are broadcast when their results are joined back.
MAX_BROADCAST_KEYS = 200_000


def deduplicated(step_fn, df: DataFrame, cols: list[str], threshold: float = 0.5) -> Step:
    """The step on distinct values of cols only, where few rows are distinct, joined back to all rows.

    The share of distinct keys is estimated by one aggregate, which does not shuffle rows. The step must keep rows and see no
    column but cols; what it does to a key it does to all its rows, so the result is that of the step itself.
    """
    key = F.xxhash64(*[F.coalesce(F.col(c), F.lit("__NA__")) for c in cols])
    total, distinct = df.agg(F.count("*"), F.approx_count_distinct(key, 0.02)).first()
    if not total or distinct / total > threshold:
        return step_fn(df)
    keyed = df.select(*cols).distinct().withColumns({"original_row_id": F.lit(0).cast("long"), "_key": F.struct(*cols)})
    got = step_fn(keyed)
    new = [c for c in got.rows.columns if c not in ("original_row_id", "_key", LOG)]
    right = got.rows.select("_key", F.col(LOG).alias("_more"), *[F.col(c).alias(f"_new_{c}") for c in new])
    if distinct <= MAX_BROADCAST_KEYS:
        right = F.broadcast(right)
    df = logged(df)
    joined = df.join(right, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key.{c}")) for c in cols]), "left")
    kept = [F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in df.columns if c != LOG]
    return Step(joined.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in new if c not in df.columns], F.concat(LOG, "_more").alias(LOG)), got.new_tags)


def build_audit_trail(before: DataFrame, after: DataFrame, step: str, reason: str, row_id: str = "original_row_id") -> DataFrame:
    """Cells of string columns in both tables that differ, both being present, joined by row id."""
    cols = [c for c in string_columns(before) if c in after.columns and c != row_id]
    both = before.select(F.col(row_id), *[F.col(c).alias(f"a_{c}") for c in cols]).join(after.select(F.col(row_id), *[F.col(c).alias(f"b_{c}") for c in cols]), row_id)
    return changes(both, {c: (F.col(f"a_{c}"), F.col(f"b_{c}")) for c in cols}, step, reason, row_id)


def remapped(audit: DataFrame, parents: DataFrame) -> DataFrame:
    """Each row of an audit once for every parent row. parents: row_id, parent_id."""
    return audit.join(parents, "row_id").select(F.col("parent_id").cast("int").alias("row_id"), "field", "step", "original_value", "new_value", "reason")
