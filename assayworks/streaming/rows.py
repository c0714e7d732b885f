"""The row-wise operators on streams: they are stateless, so a batch and a stream share the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, units
from ..operators import cleaning, detection


def cleaned(stream: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Unicode, white space and name clean-up of a stream; steps that need the whole table are left to batches."""
    cols = [c for c, t in tags.items() if t == "Name"]
    df = stream if "original_row_id" in stream.columns else stream.withColumn("original_row_id", F.lit(None).cast("long"))
    df = cleaning.trim_step(cleaning.unicode_step(df).data).data
    for step in (cleaning.protect_chiral_step, cleaning.strip_enclosures_step, cleaning.strip_adjectives_step, cleaning.strip_salts_step, cleaning.strip_unspecified_step, cleaning.tidy_step, cleaning.flag_multi_analyte_step, cleaning.restore_chiral_step, cleaning.truncated_step):
        df = step(df, cols).data
    return df


def converted(stream: DataFrame, table: DataFrame, value: str, unit: str) -> DataFrame:
    """A stream's values in common units: a join with the static unit table."""
    return units.harmonized(stream, table, value, unit)


def dated(stream: DataFrame, column: str) -> DataFrame:
    return dates.with_dates(stream, column)


def detected(stream: DataFrame, **options) -> DataFrame:
    return detection.classified(stream, **options)


def counted(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "1 hour", key: str = "detection_event_class") -> DataFrame:
    """Events of each class by window of event time, with late rows up to the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def upserted(stream: DataFrame, merge, checkpoint: str, once: bool = False):
    """Runs merge(batch, number) for each micro-batch; started, with its checkpoint. once: until all there is has been read."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
