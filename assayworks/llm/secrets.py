"""Secret scan with multipart credential linking.

Three base kinds are found by pattern (assign, access, hex). Beyond them, weak parts are collected: identifiers (client,
account, user and access key ids, and the base spans of kind access), endpoints (urls and host settings) and opaque tokens
that no base span covers. A part is an interval of code points; a document's secrets (opaque tokens, and the base spans of
kinds assign and hex) are interval-joined with its identifiers and with its endpoints, within a scope on both sides: the
intervals are in order and apart, so each secret looks up its neighbours by bisection. A secret with both complements in its
scope is a link, of which the nearest are named. An opaque token is reported, as kind `linked`, only if it has a link;
identifiers and endpoints are not reported as such.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; repeated rows are scanned one
by one; texts, tokens, names and blanks of any length are scanned whole, in time linear in their length (times the logarithm
of the number of parts); of equally near complements the first is named; an empty table gives an empty table; other columns
are carried only when asked for, and may not be named like an output.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same matches as a run of any length kept at 24 and more
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Weak parts. Alone, none of them is reported.
IDENTIFIER = re.compile(r"""(?:(?:\b|(?<=_))(?:client|account|access|user|app|key)[_-]?(?:id|name)|access[_-]?key[_-]?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]{4,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
#: Code points between two parts of one credential, at most.
SCOPE = 300

Span = tuple[str, int, int]
Interval = tuple[int, int]


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def nearest(parts: list[Interval], start: int, end: int, scope: int, within: bool = False) -> Interval | None:
    """Of intervals in order and apart, the nearest to start..end within `scope`, the first of equals. One that overlaps it
    counts only as what it lies `within`."""
    left, right = bisect_left(parts, (start,)) - 1, bisect_left(parts, (end,))
    if left >= 0 and parts[left][1] > start:
        left -= 1
    if within and left + 1 < right:
        return parts[left + 1]
    near = ([(start - parts[left][1], parts[left])] if left >= 0 else []) + ([(parts[right][0] - end, parts[right])] if right < len(parts) else [])
    return min(((d, p) for d, p in near if d <= scope), default=(0, None))[1]


def tokens_of(text: str, base: list[Span], identifiers: list[Interval], endpoints: list[Interval]) -> list[Interval]:
    """Opaque tokens apart from base spans and from what is part of a complement; a value after = within an endpoint, as in
    a query string, is a token."""
    taken, out, b, i, p = sorted((s, e) for _, s, e in base), [], 0, 0, 0
    for m in OPAQUE.finditer(text):
        s, e = m.span()
        while b < len(taken) and taken[b][1] <= s:
            b += 1
        while i < len(identifiers) and identifiers[i][1] <= s:
            i += 1
        while p < len(endpoints) and endpoints[p][1] <= s:
            p += 1
        if (b < len(taken) and taken[b][0] < e) or (i < len(identifiers) and identifiers[i][0] < e) or not _mixed(m.group()):
            continue
        if p < len(endpoints) and endpoints[p][0] < e and text[s - 1 : s] != "=":
            continue
        out.append((s, e))
    return out


def linked(text: str, base: list[Span], scope: int = SCOPE) -> list[tuple[Span, Interval, Interval]]:
    """(secret, its nearest identifier, its nearest endpoint) of every secret with both in its scope."""
    endpoints = [m.span() for m in ENDPOINT.finditer(text)]
    if not endpoints:
        return []
    identifiers = _joined([*(m.span() for m in IDENTIFIER.finditer(text)), *((s, e) for k, s, e in base if k == "access")])
    if not identifiers:
        return []
    secrets = [("linked", s, e) for s, e in tokens_of(text, base, identifiers, endpoints)] + [x for x in base if x[0] != "access"]
    out = []
    for kind, s, e in sorted(secrets, key=lambda x: x[1:]):
        by, at = nearest(identifiers, s, e, scope), nearest(endpoints, s, e, scope, within=True)
        if by and at:
            out.append(((kind, s, e), by, at))
    return out


def found(text: str | None, scope: int = SCOPE) -> tuple[list[Span], list[Span], list[tuple[Span, Interval, Interval]]]:
    """Base spans, all spans in order, and the links."""
    if not text:
        return [], [], []
    base = base_spans(text)
    links = linked(text, base, scope)
    more = [x for x, _, _ in links if x[0] == "linked"]
    order = {k: i for i, k in enumerate((*KINDS, "linked"))}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]])) if more else base, links


def spans_of(text: str | None, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    return found(text, scope)[:2]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span's code points replaced by its kind; spans that overlap are replaced as one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = e
    return "".join([*out, text[at:]])


PART = "struct<start:bigint,end:bigint>"
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
OUTPUTS = {"base_spans": SPANS, "spans": SPANS, "links": f"array<struct<secret:{PART},identifier:{PART},endpoint:{PART}>>", "redacted": "string"}


def scan(docs: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """keep + base_spans and spans (arrays of kind, start, end), links (of secret, identifier, endpoint) and the redacted
    text, for every row."""
    keep = list(keep)
    if clash := set(keep) & set(OUTPUTS):
        raise ValueError(f"columns named like an output: {sorted(clash)}")
    src = docs.select(*keep, docs[text].alias("_text"))
    schema = T.StructType([*src.select(*keep).schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in OUTPUTS.items())).fields])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    part_ = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    link = pa.list_(pa.struct([("secret", part_), ("identifier", part_), ("endpoint", part_)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda xs: [{"kind": k, "start": x, "end": y} for k, x, y in xs]
        place = lambda x: {"start": x[-2], "end": x[-1]}
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                base, spans, links, red = [], [], [], []
                for t in part.column("_text").to_pylist():
                    b, s, l = found(t, scope)
                    base.append(named(b))
                    spans.append(named(s))
                    links.append([{"secret": place(x), "identifier": place(y), "endpoint": place(z)} for x, y, z in l])
                    red.append(redacted(t, s) if s else t)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(base, span), pa.array(spans, span), pa.array(links, link), pa.array(red, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def digest(spans: list[Span]) -> tuple[str, str]:
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return joined, hashlib.sha256(joined.encode()).hexdigest()


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("links").cast("long").alias("n_links"))
