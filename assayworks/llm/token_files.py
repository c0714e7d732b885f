"""Token ids in Parquet: one row a document, with the ids as a list column and a few columns to select by.

File format: documents in ascending order of doc_id, over files in the order of their numbers. `tokens` is a list of int32
in data pages of the second version: plain dictionary pages where a row group's ids repeat enough, else delta-packed.
Row groups and pages have a bounded size, and pages have an index, so a read by doc_id, or of `n_tokens` alone, takes only
the pages it needs. `start` is not stored: it follows from the files' totals and each document's place in its file. There is
a file for each FILE_BYTES of input, but one for each core at least.

Defined results: a null or empty text has the end id alone; rows without a doc_id come first; repeated rows (and equal
doc_ids) are kept, in an order fixed by the files; a text of any length is one row, encoded in parts, so that a task holds
the text, its ids and batches of BATCH_BYTES; an empty table gives an empty table; other columns are carried on request.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import arrow_bytes, dropped, shared_dir, written

END_ID = 2
#: Pages stay below half a region of a small Java heap, so that their buffers are no humongous objects there.
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES, PAGE_ROWS = 8 << 20, 128 << 10, 256 << 10, 2000
#: Bytes of a batch to and from Python; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20
#: Bytes of input, as stored, that one file of ids is made from.
FILE_BYTES = 16 << 20


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_rows(docs: DataFrame, path: str, end_id: int | None = END_ID, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """keep + tokens, n_tokens, and the tokens and rows before the document in its partition."""
    keep = list(keep)
    src = docs.select(*keep, docs[text].alias("_text"))
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([*src.select(*keep).schema.fields, long("n_tokens"), T.StructField("part", T.IntegerType()), long("before"), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = tokens.encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids, off in tokens.encoded(enc, batch.column("_text"), end_id):
                n = np.diff(off)
                rows = batch.slice(a, b - a)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(n), pa.array(np.full(b - a, part, np.int32)), pa.array(before + off[:-1]), lists], names=schema.names)
                before += int(off[-1])

    return src.mapInArrow(run, schema)


def n_files_of(docs: DataFrame) -> int:
    """Files for docs: by the size of the columns it reads, as the optimizer estimates it from the files, without reading them."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a table whose size is not known counts as endless there
    return max(docs.sparkSession.sparkContext.defaultParallelism, min(-(-stored // FILE_BYTES), 1 << 22))


def write_tokens(docs: DataFrame, folder: str, path: str, n_files: int | None = None, end_id: int | None = END_ID) -> None:
    """Writes the documents' ids to folder in ascending order of doc_id."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    ordered = docs.repartitionByRange(n_files or n_files_of(docs), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    with arrow_bytes(spark, BATCH_BYTES):
        out = token_rows(ordered, path, end_id).write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2")
        out = out.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
        out.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, columns: Iterable[str] = ("doc_id", "n_tokens", "tokens")) -> DataFrame:
    """The asked columns and start. What is read of the ids follows from the columns asked for."""
    df = spark.read.parquet(folder)
    # A row for each file; files are a fixed share of the input apart, so this is small beside it and is joined by key.
    totals = df.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = _running(totals)
    return df.join(F.broadcast(before) if totals.count() <= 100_000 else before, "part").select(*columns, (F.col("base") + F.col("before")).alias("start"))


def _running(totals: DataFrame) -> DataFrame:
    """part and the sum of totals of smaller parts, by blocks, so that no task gets more than a block."""
    block = totals.withColumn("block", F.floor(F.col("part") / 1024))
    from pyspark.sql import Window

    inner = F.coalesce(F.sum("total").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = block.withColumn("inner", inner)
    sums = block.groupBy("block").agg(F.sum("total").alias("s"))
    sums = sums.withColumn("outer", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return block.join(F.broadcast(sums.select("block", "outer")), "block").select("part", (F.col("inner") + F.col("outer")).alias("base"))


def with_crc32(df: DataFrame, column: str = "tokens", to: str = "ids_crc32") -> DataFrame:
    """df with the crc32 of the list's ids, as little-endian unsigned 32-bit numbers, in place of the list."""
    keep = [c for c in df.columns if c != column]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(to, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [crc32_of(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(crc, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder, n = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", n_files_of(docs)
    write_tokens(docs, folder, tokens.default_path(), n)
    with arrow_bytes(spark, BATCH_BYTES):
        # a task for each file of ids, so that digests make no more files than these
        got, _ = written(spark, with_crc32(read_tokens(spark, folder).coalesce(n)), "token-digests")
    dropped(spark, folder)
    return got.select("doc_id", "start", "n_tokens", "ids_crc32")
