"""The corpus pipeline: the stages below, in order, each over all that the one before kept.

Toxic documents and those that miss a quality rule go, one document of each group of near-duplicates stays, secrets are
replaced by their kind in the text, and what remains is packed into sequences. Rows without a doc_id pass the near-duplicate
stage, which links documents by their ids. Of rows with one doc_id and one text, one stays there, that with the smallest
other columns; of rows with one doc_id and different texts each text stays, so no text is lost for its id. A null text is
an empty document, which misses the quality rules; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayworks.llm import near_dup, packing, quality, secrets, toxicity
from assayworks.llm.common import dropped, ready, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of documents that go, counted before they are broadcast; beyond, the join shuffles the texts.
MAX_BROADCAST_IDS = 2_000_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality.quality(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    found = near_dup.near_duplicates(spark, docs).filter("doc_id is not null")
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    small = gone.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    kept = docs.select(*COLUMNS).join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    # Ids that several rows share are looked for among the ids alone; only where there are any are texts grouped.
    several = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if several.limit(1).count():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        shared = kept.join(several, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r"))
        kept = kept.join(several, "doc_id", "left_anti").unionByName(shared.select("doc_id", "text", "r.*"))
    return kept.select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    got = secrets.scan(docs, keep=COLUMNS)
    return got.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.packed_documents(spark, docs)


STAGES = [("toxicity", toxicity_stage), ("quality rules", quality_stage), ("near-duplicates", near_dup_stage), ("secret scan", secrets_stage), ("packing", packing_stage)]

#: Signatures, the random field, spans and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), []
    for name, stage in STAGES:
        docs, path = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(spark, *before)
        before = [path]
    return docs
