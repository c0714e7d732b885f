"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each response gives two records that refer to it by WARC-Refers-To. Both keep its target URI and date; the metadata record
carries the source's status line, HTTP headers and digests as fields, with title and links found in the page; the
conversion record is the page's text, and names the source's payload digest. Their ids follow from the source's id and the
kind of record, so a run that is repeated after a loss gives the same records.

Defined results: a null page is an empty body, with an empty text; a null url leaves the target URI out; a record that
cannot be parsed, or is no response, gives no derivatives; repeated rows give repeated records (of equal ids); texts of any
length are handled whole; an empty table gives an empty table; other columns are carried when asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, CRLF = "WARC/1.1", "\r\n"
DATE = "2024-01-01T00:00:00Z"
Headers = list[tuple[str, str]]


def sha1_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def serialised(headers: Headers, block: bytes) -> bytes:
    """One record; Content-Length and the block's digest are added."""
    headers = [*headers, ("WARC-Block-Digest", sha1_of(block)), ("Content-Length", str(len(block)))]
    # A line break inside a value would begin a header of its own.
    head = "".join(f"{k}: {re.sub(r'[' + chr(13) + chr(10) + r']+', ' ', v)}{CRLF}" for k, v in headers)
    return f"{VERSION}{CRLF}{head}{CRLF}".encode() + block + b"\r\n\r\n"


def _header_lines(raw: bytes) -> Headers:
    out: Headers = []
    for line in raw.decode("utf-8", "replace").split(CRLF):
        k, colon, v = line.partition(":")
        if colon:
            out.append((k.strip(), v.strip()))
        elif out and line[:1] in " \t":
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
    return out


def parsed(record: bytes | None) -> tuple[Headers, bytes] | None:
    """Headers and block of one record, as bytes or as a gzip member; None where it is no whole record."""
    if not record:
        return None
    if record[:2] == b"\x1f\x8b":
        try:
            record = gzip.decompress(record)
        except (OSError, EOFError):
            return None
    head, sep, rest = record.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return None
    headers = _header_lines(head.split(b"\r\n", 1)[1] if b"\r\n" in head else b"")
    size = dict((k.lower(), v) for k, v in headers).get("content-length", "")
    if not size.isdigit() or int(size) > len(rest):
        return None
    return headers, rest[: int(size)]


def response_record(source: object, url: str | None, body: str | None, date: str = DATE) -> bytes:
    """A response record for a page as it was fetched."""
    payload = (body or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", source, url))]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("WARC-Date", date), ("WARC-Payload-Digest", sha1_of(payload)), ("Content-Type", "application/http; msgtype=response")]
    return serialised(headers, http + payload)


#: Elements whose whole content is no text, and elements that begin or end a line.
HIDDEN = ("script", "style", "noscript", "template")
BREAKS = frozenset("p br div li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre title hr".split())
_COMMENT = re.compile("-->")
_OPEN = re.compile(r"<(?:!--|[!?/a-zA-Z])")
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_CLOSE = {n: re.compile(rf"(?i)</{n}\s*>") for n in (*HIDDEN, "title")}
_BLANKS = re.compile(r"[ \t\f\v\r\u00a0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_HREF = re.compile(r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_CHARSET = re.compile(r"(?i)charset=[\"']?([\w-]+)")


class Page:
    """What one pass over a page's markup finds: text (a line for each block), title and links.

    Every search begins where the one before ended, and what was not found once is not looked for again, so time is linear
    in the page's length whatever its markup. Comments, declarations and hidden elements with their content are no text; a
    comment or a hidden element that is never closed is a tag like any other, and its content text. A `<` that begins no
    tag, or is never closed, is text.
    """

    def __init__(self, page: str):
        self.title: str | None = None
        self.links: list[str] = []
        out, missing, at, n = [], set(), 0, len(page)
        plain = lambda x: x.replace("\n", " ")  # noqa: E731 - a line break of the source is a blank

        def after(what: re.Pattern, key: str, start: int) -> re.Match | None:
            got = None if key in missing else what.search(page, start)
            if got is None:
                missing.add(key)
            return got

        while at < n:
            tag = _OPEN.search(page, at)
            if tag is None:
                break
            s = tag.start()
            if tag[0] == "<!--" and (end := after(_COMMENT, "-->", s + 4)):
                out += [plain(page[at:s]), " "]
                at = end.end()
                continue
            e = page.find(">", s)
            if e < 0:
                break
            body = page[s : e + 1]
            found = _NAME.match(body)
            name = found[1].lower() if found else ""
            out.append(plain(page[at:s]))
            at = e + 1
            if body[1] == "/" or not found:
                out.append("\n" if name in BREAKS else "")
                continue
            if name == "a" and (href := _HREF.search(body)):
                self.links.append(html.unescape(href[1].strip("\"'")))
            if name in HIDDEN and (end := after(_CLOSE[name], name, at)):
                out.append(" ")
                at = end.end()
                continue
            if name == "title" and self.title is None and (end := after(_CLOSE[name], name, at)):
                self.title = html.unescape(page[at : end.start()])
            out.append("\n" if name in BREAKS else "")
        out.append(plain(page[at:]))
        self.text = _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(out)))).strip()


def text_of(page: str) -> str:
    """The page's text: no markup, scripts or comments; a line for each block."""
    return Page(page).text


def derivatives(record: bytes | None) -> list[tuple[str, Headers, bytes, str, str]]:
    """(kind, headers, block, source id, source payload digest) of a response's two derivatives."""
    got = parsed(record)
    if got is None:
        return []
    headers, block = got
    named = {k.lower(): v for k, v in headers}
    source = named.get("warc-record-id")
    if named.get("warc-type") != "response" or not source:
        return []
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        head, payload = block, b""
    status, _, lines = head.partition(b"\r\n")
    http = _header_lines(lines)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    found = _CHARSET.search(kind)
    try:
        page = payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    digest = named.get("warc-payload-digest") or sha1_of(payload)
    seen = Page(page)
    clean = lambda s: re.sub(r"\s+", " ", s).strip()
    fields = [("source-status", status.decode("utf-8", "replace")), *[(f"source-header-{k.lower()}", v) for k, v in http]]
    fields += [("source-payload-digest", digest), ("source-block-digest", named.get("warc-block-digest") or sha1_of(block))]
    fields += [("title", clean(seen.title))] if seen.title is not None else []
    fields += [("outlink", clean(x)) for x in seen.links]
    meta = "".join(f"{k}: {v}{CRLF}" for k, v in fields).encode("utf-8", "replace")
    shared = [("WARC-Target-URI", named["warc-target-uri"])] if "warc-target-uri" in named else []
    shared += [("WARC-Date", named.get("warc-date", DATE)), ("WARC-Refers-To", source)]
    ids = {k: record_id(k, source) for k in ("metadata", "conversion")}
    out = []
    for k, content, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", seen.text.encode("utf-8", "replace"))):
        h = [("WARC-Type", k), ("WARC-Record-ID", ids[k]), *shared, ("WARC-Source-Payload-Digest", digest), ("WARC-Payload-Digest", sha1_of(body)), ("Content-Type", content)]
        out.append((k, h, body, source, digest))
    return out


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key and record: a response record for every row."""
    src = pages.select(pages[key], pages[url].alias("_url"), pages[body].alias("_body"))
    schema = T.StructType([src.schema[key], T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                made = [response_record(*x) for x in zip(*(part.column(c).to_pylist() for c in (key, "_url", "_body")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(made, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


DERIVED = "kind string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_digest string, payload_digest string, text string, record binary"


def derive(records: DataFrame, record: str = "record", keep: Iterable[str] = ("page_id",), compress: bool = False) -> DataFrame:
    """keep + two rows for every response: the records with their main headers and the block's text."""
    keep = list(keep)
    src = records.select(*keep, records[record].alias("_record"))
    more = T.StructType.fromDDL(DERIVED)
    schema = T.StructType([*src.select(*keep).schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                at, rows = [], []
                for i, raw in enumerate(part.column("_record").to_pylist()):
                    for kind, headers, block, source, digest in derivatives(raw):
                        named = dict(headers)
                        made = serialised(headers, block)
                        at.append(i)
                        rows.append((kind, named["WARC-Record-ID"], source, named.get("WARC-Target-URI"), named["WARC-Date"], named["Content-Type"], digest, named["WARC-Payload-Digest"], block.decode(), gzip.compress(made, 6, mtime=0) if compress else made))
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in more.fields]
                kinds = [pa.binary() if f.name == "record" else pa.string() for f in more.fields]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(at, pa.int32())) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names)

    return src.mapInArrow(run, schema)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return got.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_digest", "payload_digest", F.length("text").cast("long").alias("n_chars"), F.length("record").cast("long").alias("n_bytes"), F.crc32("record").alias("record_crc32"))
