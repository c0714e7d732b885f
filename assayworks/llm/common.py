"""What the corpus operators share: shared-folder tables, table readers, worker set-up and vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = str(Path(__file__).resolve().parents[2])

#: Text is worked on in slices of about this many bytes, so a worker's arrays stay small however long a batch is.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Lets the Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local session that names none gets one of its own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='assayworks-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def written(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: later reads do not depend on any executor."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def arrow_bytes(spark: SparkSession, n: int) -> Iterator[None]:
    """At most n bytes (or one row) in a batch to or from Python, for plans made and run within."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def dropped(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


# --- vectorised words -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 2**64))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _pow(base: np.uint64, name: str, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        got = _powers[name] = np.multiply.accumulate(steps)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over the buffer."""
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _pow(_B, "b", n), out=run[1:])
    return mix((run[ends] - run[starts]) * _pow(_B_INV, "i", n + 1)[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return off, np.frombuffer(texts.buffers()[2] or b"", np.uint8)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `most` bytes; nulls are empty texts."""
    off, data = text_bytes(texts)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def blank_places(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut between words: before white space that follows something else."""
    blank = _SPACE[data]
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def text_parts(data: np.ndarray, places=blank_places, most: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """One text in parts of about `most` bytes, cut only where `places` allows: a stretch without such a place stays whole."""
    a = 0
    while len(data) - a > most:
        lo, b = a, a + most
        while True:
            found = places(data[lo:b])
            if len(found):
                b = lo + int(found[-1])
                break
            if b >= len(data):
                break
            lo, b = b - 1, min(len(data), b + most)
        yield data[a:b]
        a = b
    if a < len(data) or not len(data):
        yield data[a:]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of each text, and the words' offsets by text."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = solid[1:] != solid[:-1]
    starts = edge & solid[1:]
    ends = edge & solid[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = inner[solid[inner + 1] & solid[inner]]  # a word that runs over the border of two texts
    starts[inner] = True
    ends[inner] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, off)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]
