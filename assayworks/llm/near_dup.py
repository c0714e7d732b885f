"""Near-duplicates: SuperMinHash signatures, banding, exact verification and union-find grouping.

SuperMinHash gives each element of a set a random permutation of the signature's slots, drawn step by step: at step j the
element offers slot p(j) the value j + r(j), r uniform in [0, 1). Slots of one element thus get correlated ranks, which makes
signatures less varied than independent minima, and the draw stops as soon as every slot holds a value of a lower step. Here
step j runs over all elements of the documents that still have an empty slot, which is the same early stop by document.

Documents with equal sets are one class from the start: a digest of the whole sorted set, of 128 bits without known
collisions, confirms them. Then stars: each bucket of the first bands is joined to one hub only, the member that shares most
with others, which in a group of edited copies is their original; verified links merge classes into components, so that large
groups of copies fall together at a cost in proportion to their size. What is left are buckets of all bands that still hold
several components. Their members meet in blocks of bounded size, with short codes of their signatures, and only pairs of
different components whose codes agree enough go on. Links are confirmed on the full sets, so every link found is right. A
link of similarity 0.75 is missed by all bands, or by its codes, with a probability of about one in a hundred thousand, and
no bucket, however large, is cut.

Union-find: each partition of links is first reduced to a spanning forest, and the forests' roots are then merged by
minimum labels with pointer jumping, over tables in the shared folder.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; rows without a doc_id get none,
and are linked with nothing; repeated rows have equal sets; of equal doc_ids with different texts each row is a document,
linked through their common id; of hubs that share equally the smallest id wins; a long text's set is made in parts, with
eight bytes held for each word; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, blank_places, dropped, lowered, mix, span_hashes, text_parts, text_slices, word_spans, written

SHINGLE, THRESHOLD_PERCENT = 5, 75
BANDS, ROWS = 60, 6
SLOTS = BANDS * ROWS
#: Bands whose buckets are joined as stars first.
STAR_BANDS = 16
#: Slots of which a byte each is kept as a code; the share of equal bytes that a pair must reach. At similarity 0.75 that
#: share is 0.75 with a standard deviation of 0.023 at most, so this lies more than four of them below.
CODE, CODE_SHARE = SLOTS, 0.65  # the code covers all bands
#: Members of a bucket that meet in one task, on either side.
BLOCK = 512
#: Elements of a step of the signatures that are drawn at once.
STEP_ROWS = 1 << 18
_G = np.uint64(0x9E3779B97F4A7C15)
_R_BITS = 22


def _combined(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n windows of SHINGLE words that follow each other in w."""
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + w[k : k + n] + _G)
    return h


def _long_set(data: np.ndarray) -> np.ndarray:
    """shingle_sets of one long text, in parts: what stays is eight bytes for each word."""
    words = []
    for part in text_parts(data):
        part = lowered(part)
        s, e, _ = word_spans(part, np.array([0, len(part)]))
        words.append(span_hashes(part, s, e))
    w = np.concatenate(words)
    if len(w) < SHINGLE:
        return shingle_sets(data, np.array([0, len(data)]))[0]
    n, step = len(w) - SHINGLE + 1, 1 << 18
    h = np.empty(n, np.uint64)
    for a in range(0, n, step):
        b = min(n, a + step)
        h[a:b] = _combined(w[a : b + SHINGLE - 1], b - a)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after another, and their offsets."""
    if len(off) == 2 and len(data) > 2 * SLICE_BYTES and len(blank_places(data)) >= SHINGLE:
        h = _long_set(data)
        return h, np.array([0, len(h)])
    data = lowered(data)
    s, e, first = word_spans(data, off)
    w = span_hashes(data, s, e)
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = first[:-1][doc] + np.arange(len(doc)) - bounds[:-1][doc]
    h = np.zeros(len(doc), np.uint64)
    size = np.minimum(n, SHINGLE)[doc]
    padded = np.append(w, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        has = size > k
        h = np.where(has, mix(h * np.uint64(0xD1342543DE82EF95) + padded[at + k] + _G), h)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][count > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def superminhash(h: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """[texts, slots] signatures: step in the high 10 bits, r in the others. Texts with an empty set keep the highest value."""
    docs = len(bounds) - 1
    sig = np.full(docs * slots, np.uint32(0xFFFFFFFF))
    doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(bounds))
    past: list[np.ndarray] = []
    perm = None
    for j in range(slots):
        if not len(h):
            break
        k = np.empty(len(h), np.int32)
        if j == 16:  # few texts are so short; their permutations are written out
            perm = np.tile(np.arange(slots, dtype=np.int32), (len(h), 1))
            rows = np.arange(len(h))
            for t, p in enumerate(past):
                perm[rows, t], perm[rows, p] = perm[rows, p], perm[rows, t].copy()
            past = []
        for a in range(0, len(h), STEP_ROWS):  # the elements of a step in runs, so that its arrays are bounded
            b = min(len(h), a + STEP_ROWS)
            x = mix(h[a:b] + np.uint64((j + 1) * int(_G) % 2**64))
            k[a:b] = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int32)
            if perm is not None:
                rows = np.arange(a, b)
                slot = perm[rows, k[a:b]].copy()
                perm[rows, k[a:b]] = perm[a:b, j]
                perm[a:b, j] = slot
            else:  # what swaps 0..j-1 left at place k
                slot = k[a:b].copy()
                for t in range(j - 1, -1, -1):
                    p = past[t][a:b]
                    slot = np.where(slot == p, t, np.where(slot == t, p, slot))
            value = (np.uint32(j) << np.uint32(_R_BITS)) | (x >> np.uint64(64 - _R_BITS)).astype(np.uint32)
            np.minimum.at(sig, doc[a:b].astype(np.int64) * slots + slot, value)
        if perm is None:
            past.append(k)
        open_ = (sig.reshape(docs, slots) == 0xFFFFFFFF).any(1)
        if not open_.any():
            break
        stay = open_[doc]
        if not stay.all():
            h, doc = h[stay], doc[stay]
            past = [p[stay] for p in past]
            perm = perm[stay] if perm is not None else None
    return sig.reshape(docs, slots)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[texts, bands] hashes, each mixed with the band's number."""
    x = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _G), (len(sig), bands)).copy()
    cells = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    for r in range(rows):
        x = mix(x * np.uint64(0xD1342543DE82EF95) + cells[:, :, r] + _G)
    return x


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, f1 and f2 (a 128-bit digest of the whole sorted set), bands and code."""
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    schema = T.StructType([src.schema["id"], *T.StructType.fromDDL("n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, code binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column("_text")):
                h, bounds = shingle_sets(data, off)
                sig = superminhash(h, bounds)
                bands = band_hashes(sig).view(np.int64)
                code = mix(sig[:, :CODE].astype(np.uint64)).astype(np.uint8)
                codes = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, (b - a + 1) * CODE, CODE, dtype=np.int32)), pa.py_buffer(code.tobytes())])
                n = np.diff(bounds)
                # the whole set, sorted, in a digest without known collisions: equal digests confirm equal sets
                marks = [hashlib.blake2b(h[x:y], digest_size=16).digest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                f = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2).T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), pa.array(f[0].copy()), pa.array(f[1].copy()), lists, codes], names=schema.names)

    return src.mapInArrow(run, schema)


def verified(pairs: DataFrame) -> DataFrame:
    """Of pairs a, b with texts ta, tb, those linked: 100 * intersection >= 75 * union of the full sets."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets, which = [], []  # each distinct text's set, once for a run of pairs
                for side in ("ta", "tb"):
                    once = part.column(side).dictionary_encode()
                    got = []
                    for p, q, data, off in text_slices(once.dictionary):
                        h, bounds = shingle_sets(data, off)
                        got += [h[bounds[i] : bounds[i + 1]] for i in range(q - p)]
                    sets.append(got)
                    which.append(once.indices.to_pylist())
                keep = []
                for i, j in zip(*which, strict=True):
                    x, y = sets[0][i], sets[1][j]
                    if min(len(x), len(y)) * 100 < THRESHOLD_PERCENT * max(len(x), len(y)):
                        keep.append(False)
                        continue
                    k = np.searchsorted(y, x)
                    k[k == len(y)] = 0
                    both = int((y[k] == x).sum())
                    keep.append(100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, schema)


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's links as edges from nodes to the smallest of their part of the component."""
    schema = T.StructType([T.StructField("a", edges.schema["a"].dataType), T.StructField("b", edges.schema["b"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            at = x
            while parent.setdefault(at, at) != at:
                at = parent[at]
            while parent[x] != at:
                parent[x], x = at, parent[x]
            return at

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:  # bounded: hand out what there is and begin anew
                yield _pairs(parent, root)
                parent.clear()
        yield _pairs(parent, root)

    def _pairs(parent: dict, root) -> pa.RecordBatch:
        nodes = [x for x in list(parent) if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, schema)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it reaches), for every node of edges a, b."""
    edges, made = written(spark, _forest(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).filter("a <> b").distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, path = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        # the label of the label: components shrink to their roots in a logarithm of their width
        jump = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.label").alias("label"))
        after = near.unionByName(jump).unionByName(labels).groupBy("node").agg(F.min("label").alias("label"), F.max(F.lit(1)).alias("one")).select("node", "label")
        after, new = written(spark, after, "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        dropped(spark, path)
        labels, path = after, new
        if not changed:
            dropped(spark, made)
            return labels


def agreeing(blocks: DataFrame) -> DataFrame:
    """Pairs a, b of different labels, near enough sizes and codes that agree, of each block.

    blocks: bucket, band, i, j, home, id, label, n, code, bands; rows of a block (bucket, i, j) follow each other. Pairs are
    of a home row and a probe.
    """
    kind = blocks.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    need = int(np.ceil(CODE_SHARE * CODE))

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
        cut = np.ones(len(key[0]), bool)
        cut[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(cut))
        home = rows.column("home").to_numpy(zero_copy_only=False)
        ids, label, n, band = (rows.column(c).to_numpy() for c in ("id", "label", "n", "band"))
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, CODE)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        left, right = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            h, p = s + np.flatnonzero(home[s:e]), s + np.flatnonzero(~home[s:e])
            if not len(h) or not len(p):
                continue
            for q in p.tolist():
                ok = (label[h] != label[q]) & (100 * np.minimum(n[h], n[q]) >= THRESHOLD_PERCENT * np.maximum(n[h], n[q]))
                at = h[ok]
                if len(at):
                    at = at[(code[at] == code[q]).sum(1) >= need]
                    # of the buckets that a pair shares, only that of its first equal band makes it; the bands' hashes
                    # decide, as codes of unequal slots may agree
                    at = at[(bands[at] == bands[q]).argmax(1) == band[q]]
                    left.append(np.minimum(ids[at], ids[q]))
                    right.append(np.maximum(ids[at], ids[q]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        once = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(once[0], pa.int64()), pa.array(once[1], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
            same = np.logical_and.reduce([k == k[-1] for k in key])
            at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last block may go on
            if at:
                yield pairs(rows.slice(0, at))
            held = rows.slice(at)
        if held is not None and held.num_rows:
            yield pairs(held)

    return blocks.select("bucket", "i", "j", "home", F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "n", "band", "code", "bands").mapInArrow(run, schema)


def _met(members: DataFrame, codes: DataFrame) -> DataFrame:
    """The blocks of buckets of several labels. Pairs have a probe: members of all labels but the most frequent.

    A bucket's members are dealt to blocks as homes, and its probes to blocks as probes; each block of homes meets each of
    probes. A large component with few others thus costs as much as it has members.
    """
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("s"), F.max("c").alias("top"))
    up = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = sizes.select("bucket", "most", up(F.col("s")).alias("nh"), up(F.col("s") - F.col("top")).alias("np"))
    rows = members.join(sizes, "bucket").join(codes, "id")
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ["bucket", "band", "id", "label", "n", "code", "bands"]
    homes = rows.select(*cols, F.lit(True).alias("home"), deal("nh", 1).alias("i"), F.explode(span("np")).alias("j"))
    probes = rows.filter("label <> most").select(*cols, F.lit(False).alias("home"), F.explode(span("nh")).alias("i"), deal("np", 2).alias("j"))
    return homes.unionByName(probes).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id."""
    sigs, sig_path = written(spark, signatures(docs, key, text), "signatures")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("id is not null and t is not null")
    # Equal sets are one class, named by its smallest id.
    found = sigs.filter("n_shingles > 0 and id is not null")
    classes, class_path = written(spark, found.groupBy("n_shingles", "f1", "f2").agg(F.min("id").alias("rep")), "classes")
    names = classes.select(F.col("rep").alias("id")).distinct()
    paths = [sig_path, class_path]

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        pairs, p = written(spark, pairs.distinct(), f"pairs-{label}")
        both = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
        both = both.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
        links, q = written(spark, verified(both), f"links-{label}")
        dropped(spark, p)
        paths.append(q)
        return links

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * THRESHOLD_PERCENT
    star = found.select("id", F.col("n_shingles").alias("n"), F.slice("bands", 1, STAR_BANDS).alias("bands")).join(names, "id", "left_semi").select("id", "n", F.explode("bands").alias("bucket"))
    shared = star.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    star, star_path = written(spark, star.join(shared, "bucket"), "star")
    degree = star.groupBy("id").agg(F.sum("c").alias("degree"))
    hubs = star.join(degree, "id").groupBy("bucket").agg(F.max_by(F.struct("id", "n"), F.struct("degree", -F.col("id").cast("long"))).alias("h")).select("bucket", F.col("h.id").alias("hub"), F.col("h.n").alias("hn"))
    rays = star.join(hubs, "bucket").filter((F.col("id") != F.col("hub")) & fits(F.col("n"), F.col("hn"))).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    links = linked(rays, "star")
    dropped(spark, star_path)
    labels = components(spark, links).select(F.col("node").alias("id"), "label")

    full = found.select("id", F.col("n_shingles").alias("n"), "bands").join(names, "id", "left_semi").join(labels, "id", "left")
    full = full.select("id", "n", F.coalesce("label", "id").alias("label"), F.posexplode("bands").alias("band", "bucket"))
    mixed = full.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    members, member_path = written(spark, full.join(mixed, "bucket"), "members")
    codes = found.select("id", "code", "bands").join(members.select("id").distinct(), "id", "left_semi")
    more = linked(agreeing(_met(members, codes)), "blocks")
    dropped(spark, member_path)

    # Copies are linked to their class by the digest of their sets; rows with one id are one node.
    wide = lambda df: df.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    copies = found.select("id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    named = components(spark, wide(copies).unionByName(wide(links)).unionByName(wide(more)))
    out = sigs.select("id", "n_shingles").join(named.select(F.col("node").alias("id"), "label"), "id", "left")
    out, _ = written(spark, out.select(F.col("id").alias(key), "n_shingles", F.coalesce("label", "id").alias("component_id")), "components")
    dropped(spark, *paths)
    return out


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.withColumn("kept", F.col("doc_id") == F.col("component_id"))
