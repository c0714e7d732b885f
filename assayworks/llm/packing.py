"""Best-fit packing by a grouping genetic algorithm on islands.

A chromosome is a set of bins (sequences), each a group of pieces. Crossover injects the best-filled bins of one parent whole
into the other, removes the bins that hold a piece a second time, and puts the pieces so displaced back: first by exchange,
where a bin gives up one or two pieces for a displaced one that fills it better, then by best fit. Mutation empties some
badly filled bins and puts their pieces back the same way. New blood is made by filling bins exactly, with the pieces first
that were left in unfilled bins before.

Pieces are dealt to islands by hash, so many islands evolve at once and no island grows with the data. After an epoch an
island's elite migrates: its exactly filled bins are final, and its other bins move on whole, dealt to fewer islands, where
the bins that several elites sent there are a chromosome of the new population, beside those that best fit makes of the same
pieces. The epochs end when one island takes all that is left.

Documents longer than the capacity are cut: the first piece takes the remainder, all others are full and make a sequence of
their own.

Defined results: a null or empty text is the end id alone; repeated rows (and equal doc_ids, and rows without one) are packed
as documents of their own; ties in best fit go to the bin found last; a text of any length is encoded in parts, so that a task
holds the text and its ids; an empty table gives an empty table; columns other than those named are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import dropped, written
from .token_files import END_ID, crc32_of

CAPACITY = 1024
#: Pieces to an island, on average; chromosomes of a population; generations of an island, and of the last one.
ISLAND_PIECES, POPULATION, GENERATIONS, LAST_GENERATIONS = 4096, 6, 24, 150
MAX_EPOCHS = 8

Bin = list[int]  # pieces, by their numbers in the island


class Bins:
    """Open bins by the room they have left, with a bitset of the rooms there are: best fit takes a few steps."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[Bin]):
        self.sizes, self.capacity = sizes, capacity
        self.by_room: dict[int, list[Bin]] = {}
        self.rooms = 0
        for b in bins:
            self._put(b, capacity - sum(sizes[i] for i in b))

    def _put(self, b: Bin, room: int) -> None:
        self.by_room.setdefault(room, []).append(b)
        self.rooms |= 1 << room

    def add(self, piece: int) -> None:
        size = self.sizes[piece]
        fits = self.rooms >> size
        if not fits:
            self._put([piece], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        same = self.by_room[room]
        b = same.pop()
        if not same:
            self.rooms ^= 1 << room
        b.append(piece)
        self._put(b, room - size)

    def all(self) -> list[Bin]:
        return [b for same in self.by_room.values() for b in same]


def best_fit(sizes: list[int], capacity: int, order: list[int], bins: list[Bin] = ()) -> list[Bin]:
    """Adds the pieces in order, each to the bin that it leaves least room in; bins are copied."""
    got = Bins(sizes, capacity, [list(b) for b in bins])
    for i in order:
        got.add(i)
    return got.all()


def filled(sizes: list[int], capacity: int, order: list[int]) -> list[Bin]:
    """A bin for each piece in order that has none: with one or two others that fill it exactly, the largest there are, else
    with the largest that fits and so on. The small pieces, which fill any room, are left for last."""
    by_size: dict[int, list[int]] = {}
    for i in order:
        by_size.setdefault(sizes[i], []).append(i)
    have, placed, out = 0, set(), []
    for x in by_size:
        have |= 1 << x

    def take(size: int) -> int:
        nonlocal have
        same = by_size[size]
        i = same.pop()
        placed.add(i)
        if not same:
            have ^= 1 << size
        return i

    for i in order:
        if i in placed:
            continue
        by_size[sizes[i]].remove(i)
        if not by_size[sizes[i]]:
            have ^= 1 << sizes[i]
        b, room = [i], capacity - sizes[i]
        while room:
            fits = have & ((1 << room + 1) - 1)
            if not fits:
                break
            most = fits.bit_length() - 1
            if most < room:
                for x in range(most, (room - 1) // 2, -1):
                    if have >> x & 1 and have >> room - x & 1 and (2 * x != room or len(by_size[x]) > 1):
                        most = x
                        break
            b.append(take(most))
            room -= most
        out.append(b)
    return out


def exchanged(sizes: list[int], capacity: int, bins: list[Bin], loose: list[int]) -> tuple[list[Bin], list[int]]:
    """Bins that are not full give up one or two pieces for a loose one that fills them better. New bins, and what is loose."""
    free = sorted((sizes[i], i) for i in loose)
    out = []
    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        while room and free:
            best = None
            for x, i in enumerate(b):
                for j in (None, *b[x + 1 :]) if len(b) <= 8 else (None,):
                    held = sizes[i] + (0 if j is None else sizes[j])
                    k = bisect_right(free, (held + room, len(sizes))) - 1
                    if k >= 0 and free[k][0] > held and (best is None or free[k][0] - held > best[0]):
                        best = (free[k][0] - held, k, i, j)
            if best is None:
                break
            gain, k, i, j = best
            b = [x for x in b if x not in (i, j)] + [free.pop(k)[1]]
            for x in (i, j):
                if x is not None:
                    insort(free, (sizes[x], x))
            room -= gain
        out.append(b)
    return out, [i for _, i in free]


def put_back(sizes: list[int], capacity: int, bins: list[Bin], loose: list[int], rng: np.random.Generator, noise: float) -> list[Bin]:
    """Loose pieces into bins, by exchange and then by best fit, the largest first but for some noise."""
    bins, loose = exchanged(sizes, capacity, bins, loose)
    by = rng.random(len(loose)) * noise + 1 - noise / 2
    order = [i for _, i in sorted(zip((-sizes[i] * x for i, x in zip(loose, by.tolist(), strict=True)), loose, strict=True))]
    return best_fit(sizes, capacity, order, bins)


def fitness(sizes: list[int], capacity: int, bins: list[Bin]) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller and emptier rather than alike (mean square fill)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], capacity: int, into: list[Bin], of: list[Bin], rng: np.random.Generator) -> list[Bin]:
    """Injects well-filled bins of one parent, removes bins with duplicates from the other, puts back what they displace."""
    fill = sorted(((sum(sizes[i] for i in b), k) for k, b in enumerate(of)), reverse=True)
    full = sum(f == capacity for f, _ in fill)
    best = [of[k] for _, k in fill[: max(full, len(fill) // 4, 1)]]
    injected = [best[k] for k in rng.choice(len(best), max(1, len(best) // 2), replace=False)]
    seen = {i for b in injected for i in b}
    kept, displaced = list(injected), []
    for b in into:
        if seen.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in seen]
    return put_back(sizes, capacity, kept, displaced, rng, 0.0)


def mutated(sizes: list[int], capacity: int, bins: list[Bin], rng: np.random.Generator) -> list[Bin]:
    """Empties the worst-filled bins and as many at random, and puts their pieces back in a noisy order."""
    fill = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    n = min(len(bins), int(rng.integers(2, max(3, len(bins) // 25))))
    out = set(fill[:n]) | set(rng.choice(len(bins), n, replace=False).tolist())
    return put_back(sizes, capacity, [b for k, b in enumerate(bins) if k not in out], [i for k in sorted(out) for i in bins[k]], rng, 0.4)


def bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by pieces of which no two fit together."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def evolve(sizes: list[int], capacity: int = CAPACITY, seed: int = 0, migrants: list[Bin] = (), population: int = POPULATION, generations: int = GENERATIONS) -> list[Bin]:
    """The elite chromosome of one island. migrants: bins that earlier elites sent, together a chromosome of the population."""
    n = len(sizes)
    if not n:
        return []
    rng = np.random.Generator(np.random.PCG64(seed))
    least = bound(sizes, capacity)
    down = sorted(range(n), key=lambda i: -sizes[i])
    people = [best_fit(sizes, capacity, down)] + ([[list(b) for b in migrants]] if migrants else [])
    scores = [fitness(sizes, capacity, p) for p in people]
    weight = [1.0] * n  # pieces of bins that stay unfilled come earlier in the next order
    for g in range(generations):
        if max(scores)[0] >= -least:
            break
        if g % 3 == 0 or len(people) < 3:
            child = filled(sizes, capacity, sorted(range(n), key=lambda i: -sizes[i] * weight[i]))
            for b in child:
                room = capacity - sum(sizes[i] for i in b)
                if room > 4:
                    for i in b:
                        weight[i] += min(0.1, room / 1000)
        else:
            order = sorted(range(len(people)), key=lambda k: scores[k], reverse=True)
            a, b = order[int(rng.integers(0, max(1, len(order) // 2)))], order[int(rng.integers(0, len(order)))]
            child = crossover(sizes, capacity, people[b], people[a], rng) if a != b and g % 3 == 1 else mutated(sizes, capacity, people[a], rng)
        score = fitness(sizes, capacity, child)
        if len(people) < population:
            people.append(child)
            scores.append(score)
            continue
        worst = min(range(len(people)), key=lambda k: scores[k])
        if score > scores[worst] and score not in scores:
            people[worst], scores[worst] = child, score
    return people[max(range(len(people)), key=lambda k: scores[k])]


PIECES = "doc_id bigint, uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for every piece; uid numbers pieces uniquely."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text"))
    schema = T.StructType.fromDDL(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, uid = tokens.encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, ids, off in tokens.encoded(enc, batch.column("_text"), end_id):
                n = np.diff(off)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * capacity  # the first piece takes the remainder
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = off[doc] + start
                raw = ids.astype("<u4")
                crc = [crc32_of(raw[x : x + y]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [batch.column("doc_id").slice(a, b - a).take(pa.array(doc)), pa.array(uid + np.arange(len(doc))), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                uid += len(doc)
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with uid and length) + sequence_id and offset, as a table in the shared folder."""
    cols = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("final", T.BooleanType())])
    done = [pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.col("uid") * 2, "offset": F.lit(0).cast("long")})]
    left = pieces.filter(F.col("length") < capacity).withColumn("nest", F.lit(-1).cast("long"))
    count, paths = left.count(), []
    for epoch in range(MAX_EPOCHS):
        if not count:
            break
        islands = max(1, -(-count // ISLAND_PIECES))
        last = islands == 1 or epoch == MAX_EPOCHS - 1
        # Single pieces at first, later whole bins of the elites before.
        island = F.pmod(F.xxhash64("nest" if epoch else "uid", F.lit(epoch)), F.lit(islands)).alias("island")
        packed, path = written(spark, left.select(*cols, "nest", island).groupBy("island").applyInArrow(_island(cols, schema, capacity, epoch, last), schema), f"packed-{epoch}")
        paths.append(path)
        done.append(packed.filter("final").drop("final"))
        left = packed.filter("not final").select(*cols, F.col("sequence_id").alias("nest"))
        count = 0 if last else left.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out, _ = written(spark, out, "sequences")
    dropped(spark, *paths)
    return out


def _island(cols: list[str], schema: T.StructType, capacity: int, epoch: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        # An island's rows come in no fixed order; sorted, the same pieces always give the same bins.
        group = group.sort_by([("length", "descending"), ("uid", "ascending")])
        uid, sizes, nest = group.column("uid").to_numpy(), group.column("length").to_pylist(), group.column("nest").to_pylist()
        migrants: dict[int, Bin] = {}
        for i, k in enumerate(nest):
            migrants.setdefault(k, []).append(i)
        bins = evolve(sizes, capacity, int(uid[0] & 0x7FFFFFFF) * 31 + epoch, list(migrants.values()) if epoch else [], generations=LAST_GENERATIONS if last else GENERATIONS)
        seq, off, final = np.zeros(len(uid), np.int64), np.zeros(len(uid), np.int64), np.zeros(len(uid), bool)
        for b in bins:
            at, name = 0, int(min(uid[i] for i in b)) * 2 + 1  # no other bin of this or of any other island holds that piece
            for i in b:
                seq[i], off[i] = name, at
                at += sizes[i]
            final[b] = last or at == capacity
        return pa.Table.from_arrays([*[group.column(c) for c in cols], pa.array(seq), pa.array(off), pa.array(final)], names=schema.names)

    return run


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    pieces, path = written(spark, pieces_of(docs, tokens.default_path()), "pieces")
    got = pack(spark, pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    dropped(spark, path)
    return got
