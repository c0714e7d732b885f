"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are grouped by length into buckets, longest first, and buckets into tiles; queries into blocks, and blocks into tiles.
A query that has k results with a lowest score s needs from a bucket with longest vector l only vectors of cosine
s / (|q| l) and more. From that local threshold each bucket is searched in one of two ways: where it is low, by length
(only the bucket's vectors of length s / |q| and more, a prefix); where it is high, by coordinates (only vectors whose
values in the query's largest coordinates can still reach the cosine). What is left is verified by exact products.

Two rounds: first all queries meet the longest vectors and every SEED_EACH-th part of the rest, which gives each query a
threshold; then a block goes only to tiles, and a bucket only to tiles of queries, where lengths still allow a result. A
tile of vectors and one of queries meet in one task, each sent once, and a query has at most k results from it.

Defined results: vectors that are null or empty, hold a null or non-finite component, or have a square beyond a double take
no part; neither do rows without an id. Scores beyond 64 bits, which the SQL cannot give, are 2^63 - 1 with their sign.
Vectors of different dimensions are not compared. Rows with the query's own id are not its results; repeated rows are
results each, and equal queries are asked once; rows with one id and different vectors are one query, with the best of all
their results. An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written

SCALE = 64
BUCKET_ROWS, BLOCK_ROWS = 2048, 256
#: Buckets of a part of the sorted vectors; parts of a tile, and blocks of a tile of queries, at most.
PART_BUCKETS, TILE_PARTS, TILE_BLOCKS = 4, 16, 512
#: Of the parts, each so-manyth is met in the first round.
SEED_EACH = 16
#: Above this local cosine threshold, bounds on coordinates leave fewer vectors than bounds on length.
COORDINATE_FROM, FOCUS = 0.8, 4
PACKED = "dim int, number bigint, top double, n int, ids binary, norms binary, vectors binary"


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id, dim, norm and v of the vectors that take part: 32-bit integers as bytes, or whole doubles if some are beyond."""
    src = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("x")).filter("vec_id is not null and x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, vs = [], [], [], []
            lists = batch.column("x")
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            off = lists.offsets.to_numpy()
            for i, a, b in zip(batch.column("vec_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                x = np.floor(flat[a:b] * scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    square = x @ x
                if not len(x) or not np.isfinite(square):
                    continue
                ids.append(i)
                dims.append(len(x))
                norms.append(float(np.sqrt(square)))
                vs.append(x.astype("<i4" if np.abs(x).max() < 2**31 else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(vs, pa.binary())], names=["vec_id", "dim", "norm", "v"])

    return src.mapInArrow(run, "vec_id bigint, dim int, norm double, v binary")


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Up to `rows` consecutive vectors of one dimension and width as one row, numbered uniquely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, int], list] = {}

        def out(kind: tuple[int, int]) -> pa.RecordBatch:
            nonlocal number
            ids, norms, vs = zip(*held.pop(kind), strict=True)
            number += 1
            row = [kind[0], number, max(norms), len(ids), np.array(ids, "<i8").tobytes(), np.array(norms, "<f8").tobytes(), b"".join(vs)]
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["dim", "number", "top", "n", "ids", "norms", "vectors"])

        for batch in batches:
            for i, d, n, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "norm", "v")), strict=True):
                held.setdefault((d, len(v)), []).append((i, n, v))
                if len(held[d, len(v)]) >= rows:
                    yield out((d, len(v)))
        for kind in list(held):
            yield out(kind)

    return vectors.select("vec_id", "dim", "norm", "v").mapInArrow(run, PACKED)


def _matrix(raw: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * dim * rows else "<f8").reshape(-1, dim).astype(np.float64)


def _products(q: np.ndarray, v: np.ndarray, long_q: float, long_v: float) -> np.ndarray:
    """Exact products of rows of whole numbers, of which the longest have these lengths; beyond 64 bits 2^63 - 1 with the sign."""
    bound = long_q * long_v
    # sums stay exact in doubles below 2^53, else whole numbers are multiplied
    if max(bound, long_q, long_v) < 2**24:
        return (q.astype(np.float32) @ v.T.astype(np.float32)).astype(np.int64)
    if bound < 2**53:
        return (q @ v.T).astype(np.int64)
    if max(bound, long_q, long_v) < 2**62:
        return q.astype(np.int64) @ v.T.astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return np.clip(whole(q) @ whole(v).T, 1 - 2**63, 2**63 - 1).astype(np.int64)


class _Block:
    """A block's queries with the best results so far."""

    def __init__(self, k: int, dim: int, ids: bytes, norms: bytes, vectors: bytes, lows: list[float | None] | None = None):
        self.k, self.dim = k, dim
        self.ids, self.norms = np.frombuffer(ids, "<i8"), np.frombuffer(norms, "<f8")
        self.q = _matrix(vectors, dim, len(self.ids))
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]
        # a result must reach this score
        self.low = np.array([-np.inf if x is None else x for x in lows], float) if lows else np.full(len(self.ids), -np.inf)

    def meet(self, ids: np.ndarray, norms: np.ndarray, v: np.ndarray, top: float) -> None:
        # A query of length 0 scores 0 everywhere; its threshold is met by all or none.
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.low == -np.inf, -np.inf, self.low / (self.norms * top))
        cosine = np.where(np.isnan(cosine), -np.inf, cosine)
        by_coordinate = (cosine > COORDINATE_FROM) & (cosine <= 1 + 1e-9)
        by_length = cosine <= COORDINATE_FROM
        i = np.flatnonzero(by_length)
        if len(i):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.low[i] > 0, self.low[i] / self.norms[i], 0.0)
            # the longest prefix that any of them needs; norms fall
            most = int(np.searchsorted(-norms, -(need.min() * (1 - 1e-12)), "right"))
            if most:
                s = _products(self.q[i], v[:most], self.norms[i].max(), norms[0])
                hit = s >= self.low[i][:, None]
                for r, j in enumerate(i.tolist()):
                    at = np.flatnonzero(hit[r])
                    if len(at):
                        self._take(j, ids[at], s[r, at])
        for j in np.flatnonzero(by_coordinate).tolist():
            q, c = self.q[j] / self.norms[j], min(1.0, cosine[j])
            ok = norms * self.norms[j] >= self.low[j] * (1 - 1e-12)
            local = np.minimum(1.0, self.low[j] / (self.norms[j] * np.maximum(norms, 1e-300)))  # each vector's own threshold, c and more
            local = np.maximum(local, c)
            for f in np.argsort(-np.abs(q))[:FOCUS].tolist():
                x = v[:, f] / np.maximum(norms, 1e-300)
                room = np.sqrt(np.maximum(0, (1 - local**2) * (1 - q[f] ** 2))) + 1e-9
                ok &= np.abs(x - local * q[f]) <= room + (1 - local) * abs(q[f])
            at = np.flatnonzero(ok)
            if len(at):
                exact = _products(self.q[j : j + 1], v[at], self.norms[j], norms[at[0]])[0]
                hit = exact >= self.low[j]
                self._take(j, ids[at[hit]], exact[hit])

    def _take(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[j]
        i, s = np.concatenate([self.best[j][0], ids[other]]), np.concatenate([self.best[j][1], scores[other]])
        if len(i) > 4 * self.k:  # far more than k: first only those that reach the k-th score
            cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
            i, s = i[s >= cut], s[s >= cut]
        order = np.lexsort((i, -s))[: self.k]
        self.best[j] = (i[order], s[order])
        if len(order) == self.k:
            self.low[j] = s[order[-1]]

    def out(self, number: int) -> pa.Table:
        n = [len(i) for i, _ in self.best]
        cols = [np.full(sum(n), number), np.repeat(np.arange(len(n), dtype=np.int32), n), np.repeat(self.ids, n), *(np.concatenate([x[c] for x in self.best]) for c in (0, 1))]
        return pa.table(cols, names=["number", "j", "query_id", "vec_id", "score"])


FOUND = "number bigint, j int, query_id bigint, vec_id bigint, score bigint"


def met(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The best k of each tile's vectors for each query of a block that is sent there. Both sides have dim, tile and block_tile."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            rows = sorted(right.select(["top", "ids", "norms", "vectors"]).to_pylist(), key=lambda r: -r["top"])
            dim = left.column("dim")[0].as_py()
            for r in rows:
                r["ids"], r["norms"] = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["norms"], "<f8")
            for q in left.select(["number", "ids", "norms", "vectors", "lows"]).to_pylist():
                block = _Block(k, dim, q["ids"], q["norms"], q["vectors"], q["lows"])
                for r in rows:
                    block.meet(r["ids"], r["norms"], _matrix(r["vectors"], dim, len(r["ids"])), r["top"])
                parts.append(block.out(q["number"]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=["number", "j", "query_id", "vec_id", "score"])

    key = ("dim", "tile", "block_tile")
    return blocks.groupBy(*key).cogroup(buckets.groupBy(*key)).applyInArrow(run, FOUND)


def top_k(spark: SparkSession, df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for every row where is_query holds, ties to the smaller id."""
    vectors, p1 = written(spark, scaled(df, key, vector, scale), "vectors")
    count = vectors.count()
    parts = max(1, -(-count // (PART_BUCKETS * BUCKET_ROWS)))
    ordered = vectors.repartitionByRange(parts, F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    buckets, p2 = written(spark, packed(ordered, BUCKET_ROWS), "buckets")
    asked = vectors.filter(is_query).dropDuplicates(["vec_id", "v"])
    blocks, p3 = written(spark, packed(asked.coalesce(max(1, -(-count // (100 * BLOCK_ROWS)))), BLOCK_ROWS), "queries")
    # Parts follow each other in length, so a tile is a run of parts: many for a small table, so that all cores have one.
    tiles = max(-(-parts // TILE_PARTS), min(parts, spark.sparkContext.defaultParallelism))
    block_tiles = max(1, -(-blocks.count() // TILE_BLOCKS))
    part = F.shiftright("number", 32)
    buckets = buckets.withColumns({"part": part, "tile": F.floor(part * tiles / parts).cast("int")})
    block_tile = F.pmod(F.xxhash64("number"), F.lit(block_tiles)).cast("int").alias("block_tile")
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def sent(lows: DataFrame | None, seed: bool) -> DataFrame:
        mine = blocks.select("dim", "number", "ids", "norms", "vectors", block_tile)
        if lows is None:
            mine = mine.withColumns({"lows": F.lit(None).cast("array<double>"), "need": F.lit(-1.0)})
        else:
            mine = mine.join(lows, "number", "left").withColumn("need", F.coalesce("need", F.lit(-1.0)))
        theirs = buckets.filter((F.col("part") % SEED_EACH == 0) == seed).select("dim", "tile", "top", "ids", "norms", "vectors")
        # A small row for each tile of either kind: what its longest vector can reach, and what its least demanding query needs.
        tops = theirs.groupBy("dim", "tile").agg(F.max("top").alias("reach"))
        needs = mine.groupBy("dim", "block_tile").agg(F.min("need").alias("need"))
        left = mine.select("*", numbers(tiles, "tile")).join(tops, ["dim", "tile"]).filter("reach >= need").drop("reach", "need")
        right = theirs.select("*", numbers(block_tiles, "block_tile")).join(needs, ["dim", "block_tile"]).filter("top >= need").drop("need")
        return met(left, right, k)

    first, p4 = written(spark, sent(None, True), "first")
    # The k-th best score so far of each query, and the length that a block's least demanding query needs.
    kth = first.groupBy("number", "j").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).cast("double").alias("low"))
    norms = blocks.select("number", "n", F.col("norms").alias("raw"))
    lows = kth.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("j", "low"))).alias("x"))
    lows = _needed(lows.join(norms, "number"))
    second, p5 = written(spark, sent(lows, False), "second")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    got = first.unionByName(second).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    got, _ = written(spark, got, "top")
    dropped(spark, p1, p2, p3, p4, p5)
    return got


def _needed(lows: DataFrame) -> DataFrame:
    """number, lows (of all the block's queries, null where there are fewer than k results) and the length that any of them needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, need = [], []
            for x, n, raw in zip(*(batch.column(c).to_pylist() for c in ("x", "n", "raw")), strict=True):
                low: list[float | None] = [None] * n
                for r in x:
                    low[r["j"]] = r["low"]
                # a query without a positive threshold needs all lengths
                least = [v / l * (1 - 1e-12) if v is not None and v > 0 and l > 0 else -1.0 for v, l in zip(low, np.frombuffer(raw, "<f8").tolist(), strict=True)]
                out.append(low)
                need.append(min(least))
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(out, pa.list_(pa.float64())), pa.array(need, pa.float64())], names=["number", "lows", "need"])

    return lows.mapInArrow(run, "number bigint, lows array<double>, need double")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = {
    "op9_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
}
