"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of ASCII letters and digits and of non-ASCII bytes, lower-cased. A token's features are the whole token and
its first 3 to 8 bytes, kept where they speak for toxic documents. Labels are given by document only, so the tokens of the
training sample are labelled by association: in a toxic document, a token with a feature that is found almost only in
toxic documents. The field has two states; its weights are fitted to the labelled tokens in windows. Forward-backward over
each whole document gives marginals: tokens above a half are the offending offsets, and the document's score is a logistic
function, fitted to the sample's labels, of the log odds of any toxic token, the expected number of them and the length.

Bounds of the fit, which is on the driver: at most MAX_TOXIC toxic and MAX_CLEAN clean training documents, in the order of a
hash of doc_id, and of each no more than TOXIC_BYTES and CLEAN_BYTES; one text of each doc_id; MAX_FEATURES features; all
windows round labelled tokens and UNLABELLED_SHARE of those round others, but MAX_WINDOWS of either at most, drawn by a hash
evenly from all training documents. Everything else covers all rows. Rows with crc32(doc_id) mod 3 = 1 are held out and
never fitted on.

Defined results: null and empty texts are scored as empty documents; repeated rows are scored one by one; of training rows
with one doc_id and several texts, one text by its hash is fitted on; without a toxic and a clean training label the score is
the share of toxic labels (0 without any); a text of any length is scored whole, in parts, so that only its tokens with
features are held at once; of equally good features or rows the order of hashes decides; an empty table gives an empty table;
other columns are carried only when asked for, and may not be named like an output.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, dropped, lowered, mix, span_hashes, text_parts, text_slices, written

MAX_TOXIC, MAX_CLEAN = 3000, 9000
TOXIC_BYTES, CLEAN_BYTES = 16 << 20, 48 << 20
#: Features kept: so strongly, and in so many toxic documents of the sample.
MIN_LIFT, MIN_TOXIC_DOCS, MAX_FEATURES = 2.0, 3, 50_000
#: A token is labelled toxic by a feature of this precision and log-likelihood gain over the base rate.
LABEL_PRECISION, LABEL_GAIN = 0.9, 12.0
PREFIXES = (3, 4, 5, 6, 7, 8)
WINDOW = 8
UNLABELLED_SHARE, MAX_WINDOWS = 0.25, 200_000
#: Windows whose gradients are computed at once; all of them are summed in every round.
FIT_ROWS = 60_000
THRESHOLD = 0.7

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of UTF-8."""
    out = lowered(data)
    if len(out) > 1:
        second = out[1:]
        second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def token_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _TOKEN[data]
    edge = solid[1:] != solid[:-1]
    starts, ends = edge & solid[1:], edge & solid[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = inner[solid[inner + 1] & solid[inner]]
    starts[inner] = ends[inner] = True
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends), np.searchsorted(s, off)


def token_places(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut between tokens."""
    token = _TOKEN[data]
    return np.flatnonzero(~token[1:] & token[:-1]) + 1


def lead(data: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The first three bytes of tokens of three bytes and more."""
    return (data[s].astype(np.int32) << 16) | (data[s + 1].astype(np.int32) << 8) | data[s + 2]


def feature_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """[tokens, 1 + prefixes] hashes: the whole token, then each proper prefix (0: none). Tokens have three bytes at least."""
    out = np.zeros((len(s), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = span_hashes(data, s, e) | np.uint64(1)
    for j, k in enumerate(PREFIXES, 1):
        has = np.flatnonzero(e - s > k)
        out[has, j] = span_hashes(data, s[has], s[has] + k) & ~np.uint64(1)
    return out


@dataclass
class Model:
    """keys: sorted feature hashes; weights: theirs; lead: which three first bytes any feature has; trans: T01, T10, T11, bias."""

    keys: np.ndarray
    weights: np.ndarray
    lead: np.ndarray
    trans: np.ndarray
    logit: np.ndarray
    prior: float

    def looked_up(self, h: np.ndarray) -> np.ndarray:
        """Feature numbers from 1, 0 for none."""
        k = np.searchsorted(self.keys, h)
        k[k == len(self.keys)] = 0
        return np.where(self.keys[k] == h, k + 1, 0)


def _step(trans: np.ndarray) -> np.ndarray:
    t01, t10, t11, b = trans
    return np.exp(np.array([[0.0, t01 + b], [t10, t11 + b]]))


def marginals(gaps: np.ndarray, emit: np.ndarray, doc_off: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each event token's marginal of state 1, and each document's log of all paths' weight over the all-0 path's.

    Tokens without features are not visited: between events, a run of them is a power of one 2x2 matrix, taken by its
    eigenvalues. gaps: such tokens before each event; lengths: tokens of each document.
    """
    a = _step(trans)
    lam, v = np.linalg.eig(a)
    order = np.argsort(-lam.real)
    lam, v = lam.real[order], v.real[:, order]
    vi, ratio = np.linalg.inv(v), max(lam[1] / lam[0], -1.0)

    def power(g: np.ndarray) -> np.ndarray:  # a^g / lam0^g
        d = np.power(ratio, g)
        return v[:, 0][None, :, None] * vi[0][None, None, :] + d[:, None, None] * (v[:, 1][None, :, None] * vi[1][None, None, :])

    n, docs = len(emit), len(doc_off) - 1
    counts = np.diff(doc_off)
    order = np.argsort(-counts, kind="stable")
    most = int(counts[order[0]]) if docs else 0
    e1 = np.exp(np.clip(emit, -30, 30))
    step = power(gaps.astype(np.float64)) if n else np.zeros((0, 2, 2))
    t01, t10, t11, b = trans
    event = np.exp(np.array([[0.0, t01 + b], [t10, t11 + b]]))
    full = np.einsum("nij,jk->nik", step, event)
    full[:, :, 1] *= e1[:, None]
    alive = np.searchsorted(-counts[order], -np.arange(most), "left")  # documents with an event k
    fwd = np.zeros((n, 2))
    log_z = np.zeros(docs)
    state = np.tile([1.0, 0.0], (docs, 1))
    first = doc_off[:-1][order]
    for k in range(most):
        m = alive[k]
        at = first[:m] + k
        x = np.einsum("ni,nij->nj", state[:m], full[at])
        s = x.sum(1)
        x /= s[:, None]
        fwd[at] = x
        state[:m] = x
        log_z[:m] += np.log(s)
    skipped = np.concatenate([[0], np.cumsum(gaps)])
    tail = (lengths - counts - (skipped[doc_off[1:]] - skipped[doc_off[:-1]]))[order]
    last = power(tail.astype(np.float64))
    out = np.einsum("ni,nij->nj", state, last).sum(1)
    log_z += np.log(np.maximum(out, 1e-300)) + (lengths[order] - counts[order]) * np.log(lam[0])
    back = last.sum(2)
    post = np.zeros(n)
    state = back
    for k in range(most - 1, -1, -1):
        m = alive[k]
        # documents whose last event is k start here from their tails; the rest carry on
        at = first[:m] + k
        f = fwd[at] * state[:m]
        post[at] = f[:, 1] / f.sum(1)
        x = np.einsum("nij,nj->ni", full[at], state[:m])
        state[:m] = x / x.sum(1)[:, None]
    z = np.zeros(docs)
    z[order] = log_z
    return post, z


def events(model: Model, data: np.ndarray, off: np.ndarray):
    """Tokens with a kept feature: places, numbers in the document, feature numbers; and the tokens of each document."""
    s, e, first = token_spans(data, off)
    lengths = np.diff(first)
    long = np.flatnonzero(e - s >= 3)
    long = long[model.lead[lead(data, s[long])]] if len(long) else long
    feats = model.looked_up(feature_hashes(data, s[long], e[long])) if len(long) and len(model.keys) else np.zeros((len(long), 1 + len(PREFIXES)), np.int64)
    has = feats.any(1)
    long, feats = long[has], feats[has]
    doc_off = np.searchsorted(long, first)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(doc_off))
    return s[long], e[long], long - first[doc], feats, doc_off, lengths


def _gaps(place: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
    gaps = place.copy()
    gaps[1:] -= place[:-1] + 1
    heads = doc_off[:-1][np.diff(doc_off) > 0]
    gaps[heads] = place[heads]
    return gaps


def _doc_features(post: np.ndarray, z: np.ndarray, doc_off: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(post)])
    expected = total[doc_off[1:]] - total[doc_off[:-1]]
    odds = np.clip(np.log(np.maximum(np.expm1(np.clip(z, 1e-9, 50)), 1e-9)), -12, 12)
    return np.stack([np.ones(len(z)), odds, np.log1p(expected), np.log1p(lengths)], 1)


def _found(model: Model, data: np.ndarray, off: np.ndarray):
    """Events as spans in code points of their document, and their features; long texts in parts."""
    whole = len(off) == 2 and len(data) > 2 * SLICE_BYTES
    got, tokens, chars = [], 0, 0
    for part in text_parts(data, token_places) if whole else [data]:
        part = folded(part)
        s, e, place, feats, doc_off, lengths = events(model, part, np.array([0, len(part)]) if whole else off)
        n = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int64)])
        base = 0 if whole else n[np.repeat(off[:-1], np.diff(doc_off))]
        got.append((n[s] - base + chars, n[e] - base + chars, place + tokens, feats))
        if not whole:
            return *got[0], doc_off, lengths
        tokens, chars = tokens + int(lengths[0]), chars + int(n[-1])
    s, e, place, feats = (np.concatenate(x) for x in zip(*got, strict=True))
    return s, e, place, feats, np.array([0, len(s)]), np.array([tokens])


def scored(model: Model, data: np.ndarray, off: np.ndarray):
    """Scores of the documents, and the offending tokens as documents, first and end code points, and marginals."""
    s, e, place, feats, doc_off, lengths = _found(model, data, off)
    emit = np.append(0.0, model.weights)[feats].sum(1)
    post, z = marginals(_gaps(place, doc_off), emit, doc_off, lengths, model.trans)
    x = _doc_features(post, z, doc_off, lengths)
    score = 1 / (1 + np.exp(-np.clip(x @ model.logit, -40, 40))) if model.prior < 0 else np.full(len(lengths), model.prior)
    hit = np.flatnonzero(post > 0.5)
    return score, np.searchsorted(doc_off, hit, "right") - 1, s[hit], e[hit], post[hit]


def _gradients(feats: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the windows of the gradients by transitions and by weights."""
    rows, size = y.shape
    flat = feats.reshape(-1, feats.shape[-1])
    emit = (w[flat].sum(1).reshape(rows, size) + trans[3]) * mask
    edge = np.exp(np.array([[0.0, trans[0]], [trans[1], trans[2]]]))
    node = np.exp(np.clip(emit, -30, 30))
    fwd, bwd = np.zeros((size, rows, 2)), np.zeros((size, rows, 2))
    state = np.tile([1.0, 0.0], (rows, 1))
    for k in range(size):
        state = state @ edge
        state[:, 1] *= node[:, k]
        state /= state.sum(1)[:, None]
        fwd[k] = state
    state = np.ones((rows, 2))
    for k in range(size - 1, -1, -1):
        bwd[k] = state
        x = state * np.stack([np.ones(rows), node[:, k]], 1)
        state = x @ edge.T
        state /= state.sum(1)[:, None]
    p = fwd * bwd
    p = (p[:, :, 1] / p.sum(2)).T
    prev = np.concatenate([np.tile([1.0, 0.0], (1, rows, 1)), fwd[:-1]])
    joint = prev[:, :, :, None] * edge[None, None] * np.stack([np.ones((size, rows)), node.T], 2)[:, :, None, :] * bwd[:, :, None, :]
    joint /= joint.sum((2, 3))[:, :, None, None]
    before = np.concatenate([np.zeros((rows, 1)), y[:, :-1]], 1)
    diff = (y - p) * mask
    want = np.array([(y * (1 - before)).sum(), ((1 - y) * before).sum(), (y * before).sum()])
    got = joint.sum((0, 1))
    d = np.append(want - [got[0, 1], got[1, 0], got[1, 1]], diff.sum())
    return d, np.bincount(flat.ravel(), np.repeat(diff.ravel(), flat.shape[1]), len(w))


def _fit_chain(feats: np.ndarray, y: np.ndarray, mask: np.ndarray, n: int, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adagrad on the conditional likelihood of windows [rows, tokens] of labelled tokens."""
    w, trans = np.zeros(n + 1), np.array([-1.0, 0.0, 0.0, -2.0])
    gw, gt = np.full(n + 1, 1e-6), np.full(4, 1e-6)
    rows, size = y.shape
    for _ in range(rounds):
        d, g = np.zeros(4), np.zeros(n + 1)
        for a in range(0, rows, FIT_ROWS):
            more = _gradients(feats[a : a + FIT_ROWS], y[a : a + FIT_ROWS].astype(float), mask[a : a + FIT_ROWS], w, trans)
            d, g = d + more[0], g + more[1]
        d, g = d / rows - 0.002 * trans, g / rows - 1e-4 * w
        g[0] = 0
        gw += g * g
        gt += d * d
        w += 0.4 * g / np.sqrt(gw)
        trans = trans + 0.2 * d / np.sqrt(gt)
    return w[1:], trans


def _fit_logit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """A model from texts and their 0/1 labels."""
    y = labels.astype(bool)
    none = np.zeros(0, np.uint64)
    empty = Model(none, np.zeros(0), np.zeros(1 << 24, bool), np.array([-1.0, 0, 0, -8.0]), np.zeros(4), float(y.mean()) if len(y) else 0.0)
    if not y.any() or y.all():
        return empty

    def pairs(rows: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Features and in how many of the texts each is found."""
        found: list[np.ndarray] = []
        for _, _, data, off in text_slices(texts.take(pa.array(rows)), SLICE_BYTES):
            data = folded(data)
            s, e, first = token_spans(data, off)
            long = np.flatnonzero(e - s >= 3)
            h = feature_hashes(data, s[long], e[long])
            doc = np.searchsorted(first, long, "right") - 1
            doc = np.repeat(doc[:, None], h.shape[1], 1)
            ok = h != 0
            h, doc = h[ok], doc[ok]
            if known is not None:
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                ok = known[k] == h
                h, doc = h[ok], doc[ok]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            u, c = np.unique(h[new], return_counts=True)
            found.append(np.rec.fromarrays([u, c], names="h,c"))
        h, c = np.concatenate([f.h for f in found]), np.concatenate([f.c for f in found])
        u, inv = np.unique(h, return_inverse=True)
        return u, np.bincount(inv, c, len(u))

    n1, n0 = int(y.sum()), int((~y).sum())
    keys, tox = pairs(np.flatnonzero(y), None)
    few = tox >= min(MIN_TOXIC_DOCS, max(2, n1 // 20))
    keys, tox = keys[few], tox[few]
    if not len(keys):
        return empty
    ckeys, ccount = pairs(np.flatnonzero(~y), keys)
    clean = np.zeros(len(keys))
    clean[np.searchsorted(keys, ckeys)] = ccount
    lift = np.log((tox + 0.5) / (n1 - tox + 0.5)) - np.log((clean + 0.5) / (n0 - clean + 0.5))
    precision = tox / (tox + clean)
    gain = tox * np.log(np.maximum(precision, 1e-9) * (n0 + n1) / n1)
    kept = np.flatnonzero(lift >= MIN_LIFT)
    kept = np.sort(kept[np.argsort(-gain[kept], kind="stable")][:MAX_FEATURES])
    keys = keys[kept]
    strong = np.append(False, ((precision >= LABEL_PRECISION) & (gain >= LABEL_GAIN))[kept])
    model = Model(keys, np.zeros(len(keys)), np.ones(1 << 24, bool), empty.trans, np.zeros(4), -1.0)
    leads = np.zeros(1 << 24, bool)
    kept_slices, counts = [], np.zeros(2)
    for a, b, data, off in text_slices(texts, SLICE_BYTES):
        data = folded(data)
        s, e, place, feats, doc_off, lengths = events(model, data, off)
        leads[lead(data, s)] = True
        doc = np.repeat(np.arange(b - a), np.diff(doc_off))
        label = strong[feats].any(1) & y[a:b][doc]
        kept_slices.append((feats.astype(np.int32), place, doc_off, lengths, label, a))
        counts += [(~label).sum(), label.sum()]
    share = np.minimum([UNLABELLED_SHARE, 1.0], MAX_WINDOWS / np.maximum(counts, 1))
    windows_f, windows_y, windows_m = [], [], []
    for feats, place, doc_off, lengths, label, a in kept_slices:
        doc = np.repeat(np.arange(len(lengths)), np.diff(doc_off))
        # windows round events; the tokens without features between them are features 0, label 0
        drawn = mix((doc + a).astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)).astype(np.float64) / 2.0**64
        pick = np.flatnonzero(drawn < share[label.astype(int)])
        if len(pick) == 0:
            continue
        size = 2 * WINDOW + 1
        f = np.zeros((len(pick), size, feats.shape[1]), np.int32)
        t, m = np.zeros((len(pick), size), bool), np.zeros((len(pick), size), bool)
        places = place[pick][:, None] + np.arange(-WINDOW, WINDOW + 1)[None]
        m[:] = (places >= 0) & (places < lengths[doc[pick]][:, None])
        for j in range(-WINDOW, WINDOW + 1):
            near = pick + j
            ok = (near >= 0) & (near < len(place))
            near = np.clip(near, 0, len(place) - 1)
            d = place[near] - place[pick] + WINDOW
            ok &= (doc[near] == doc[pick]) & (d >= 0) & (d < size)
            i = np.flatnonzero(ok)
            f[i, d[i]] = feats[near[i]]
            t[i, d[i]] = label[near[i]]
        windows_f.append(f)
        windows_y.append(t)
        windows_m.append(m)
    if not windows_f:
        return empty
    f, t, m = (np.concatenate(x) for x in (windows_f, windows_y, windows_m))
    w, trans = _fit_chain(f, t, m, len(keys))
    x = []
    for feats, place, doc_off, lengths, _, _ in kept_slices:
        post, z = marginals(_gaps(place, doc_off), np.append(0.0, w)[feats].sum(1), doc_off, lengths, trans)
        x.append(_doc_features(post, z, doc_off, lengths))
    return Model(keys, w, leads, trans, _fit_logit(np.concatenate(x), y.astype(float)), -1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", most: tuple[int, int] = (MAX_TOXIC, MAX_CLEAN), most_bytes: tuple[int, int] = (TOXIC_BYTES, CLEAN_BYTES)) -> Model:
    """A model fitted to labelled documents that are not held out; of each label, the bounded sample with the smallest hashes."""
    spark = docs.sparkSession
    l = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    l = l.withColumn("h", F.xxhash64("doc_id"))
    sample = None
    for value, n in ((1, most[0]), (0, most[1])):
        part = l.filter(F.col("y") == value).orderBy("h", "doc_id").limit(n)
        sample = part if sample is None else sample.unionByName(part)
    # At most the sum of the bounds: the broadcast, the table and what comes to the driver do not grow with the data.
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "y", "h").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), F.octet_length("_t"))).alias("_t"))
    texts, path = written(spark, texts, "fitted")
    sizes = texts.select("doc_id", "y", "h", F.octet_length("_t").cast("long").alias("n")).toArrow()  # a row each, within the bounds
    fits: list[int] = []
    for value, bytes_ in ((1, most_bytes[0]), (0, most_bytes[1])):
        part = sizes.filter(pc.equal(sizes.column("y"), value)).sort_by([("h", "ascending"), ("doc_id", "ascending")])
        fits += part.column("doc_id").to_numpy()[np.cumsum(part.column("n").to_numpy()) <= bytes_].tolist()
    chosen = spark.createDataFrame([(i,) for i in fits], T.StructType([texts.schema["doc_id"]]))
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "_t").toArrow()
    dropped(spark, path)
    got = got.take(pa.array(np.argsort(got.column("doc_id").to_numpy(), kind="stable")))
    return fit(got.column("_t").combine_chunks() if got.num_rows else pa.array([], pa.string()), got.column("y").to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """keep + score and toxic_spans, the offending offsets (code points, end exclusive, with their marginals)."""
    keep = list(keep)
    if clash := {"score", "toxic_spans"} & set(keep):
        raise ValueError(f"columns named like an output: {sorted(clash)}")
    src = docs.select(*keep, docs[text].alias("_text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([*src.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    leads = np.packbits(model.lead)
    small = (model.keys, model.weights, leads, model.trans, model.logit, model.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*small)
        m.lead = np.unpackbits(m.lead).astype(bool)
        for batch in batches:
            for a, b, data, off in text_slices(batch.column("_text")):
                scores, doc, s, e, p = scored(m, data, off)
                spans = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(p)], names=["start", "end", "p"])
                at = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), spans).cast(kind)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(scores), lists], names=schema.names)

    return src.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))
