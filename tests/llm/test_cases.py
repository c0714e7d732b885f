"""The corpus operators in odd cases: long texts, nulls, repeated ids, hostile input, clashing columns, and brute force."""

import functools
import random
import re
import struct
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayworks.llm import common, near_dup, packing, quality, secrets, sentencepiece, token_files, tokens, topk, toxicity, url_filter, warc

ROOT = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    common.ready(spark)


# --- texts longer than a slice ----------------------------------------------------------------------------------------


def test_parts_of_a_text_have_its_ids():
    enc, rng = tokens.Encoder(tokens.default_path()), random.Random(4)
    alphabet = " \t\n\r  'sdmtlvre aBé1²½!?-_ßñ·'  \n\n's'll've're中。文 ab"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(200, 900))) for _ in range(60)]
    for most in (1, 7, 64):
        for a, b, ids, off in tokens.encoded(enc, pa.array(texts), most=most):
            assert b == a + 1 and ids.tolist() == enc.whole([texts[a]])[0] and off.tolist() == [0, len(ids)]
    pieces = sentencepiece.PieceEncoder(sentencepiece.default_path())
    whole = {a: ids.tolist() for a, _, ids, _ in sentencepiece.encoded(pieces, pieces.marked(pa.array(texts)), most=1 << 11) if True}
    for a, b, ids, _ in sentencepiece.encoded(pieces, pieces.marked(pa.array(texts)), most=16):
        assert b == a + 1 and (a not in whole or whole[a][: len(ids)] == ids.tolist())


def test_parts_of_a_text_have_its_shingles_and_spans(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["vermin", "Wörd", "x1", "plain", "中文", "the"]) for _ in range(3000))
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    model = toxicity.fit(pa.array(["vermin scum " + "word " * 20] * 40 + ["plain words " * 20] * 120), np.arange(160) < 40)
    sets, spans = near_dup.shingle_sets(data, off)[0], toxicity.scored(model, data, off)
    sig = near_dup.superminhash(sets, np.array([0, len(sets)]))
    for m in (near_dup, toxicity):
        monkeypatch.setattr(m, "SLICE_BYTES", 64)
        monkeypatch.setattr(m, "text_parts", functools.partial(common.text_parts, most=100))
    monkeypatch.setattr(near_dup, "STEP_ROWS", 17)
    assert np.array_equal(near_dup.shingle_sets(data, off)[0], sets) and np.array_equal(near_dup.superminhash(sets, np.array([0, len(sets)])), sig)
    for x, y in zip(spans, toxicity.scored(model, data, off), strict=True):
        assert np.allclose(x, y)
    s, e = spans[2], spans[3]
    assert len(s) and {text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)} == {"vermin"}


LONG = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from assayworks.llm import common, near_dup, sentencepiece, tokens, toxicity
rng = np.random.default_rng(0)
piece = " ".join("w%x" % i for i in rng.integers(0, 1 << 20, 150_000)) + " the été don't 2024. "
texts = pa.array(["a b c", "".join(f"{i} {piece}" for i in range(1 + (50 << 20) // len(piece))), None])
top = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
model = toxicity.fit(pa.array(["vermin scum " + "word " * 20] * 40 + ["plain words " * 20] * 120), np.arange(160) < 40)
before = top()
n = [len(ids) for _, _, ids, _ in tokens.encoded(tokens.encoder(tokens.default_path()), texts, 2)]
pieces = sentencepiece.PieceEncoder(sentencepiece.default_path())
marked = pieces.marked(texts)
off, data = common.text_bytes(marked)
right = [bool(pieces.model.spells(ids, o, data[off[a]:off[b]], off[a:b + 1] - off[a]).all()) for a, b, ids, o in sentencepiece.encoded(pieces, marked)]
sizes = []
for a, b, raw, o in common.text_slices(texts):
    h, bounds = near_dup.shingle_sets(raw, o)
    near_dup.superminhash(h, bounds)
    sizes.append(len(h))
    toxicity.scored(model, raw, o)
print(n[1] > 10**7, all(right), sizes[1] > 10**5, top() - before)
"""


def test_a_text_of_50_mb_takes_bounded_memory():
    said = subprocess.run([sys.executable, "-c", LONG, ROOT], capture_output=True, text=True, timeout=600)
    assert said.returncode == 0, said.stderr
    *ok, more = said.stdout.split()
    # the text again as marked, its ids and its words' hashes; arrays of the work would be forty times the text
    assert ok == ["True"] * 3 and int(more) < 600


# --- packing and token files ------------------------------------------------------------------------------------------


def test_packing_beats_best_fit_and_keeps_odd_rows(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(200, 451, 1200).tolist()
    down = packing.best_fit(sizes, 1024, sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    bins = packing.evolve(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and packing.bound(sizes, 1024) <= len(bins) < len(down)
    # equal rooms and equal pieces, one that fills a bin, pieces of one token
    for odd in ([512] * 7, [1023, 1, 1, 1], [1] * 2049, [600] * 5):
        got = packing.evolve(odd)
        assert len(got) == packing.bound(odd, 1024) and sorted(i for b in got for i in b) == list(range(len(odd)))
    # migrants are a chromosome: the best one stays the elite
    assert len(packing.evolve(sizes, migrants=bins, generations=1)) <= len(bins)
    rows = [(None, "no id"), (1, "a b"), (1, "a b"), (1, "other"), (2, None)]
    got = packing.packed_documents(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1)] * 3 + [(False, 2), (True, 0)] and len({r["sequence_id"] for r in got}) == 1


def test_leftovers_migrate_to_fewer_islands(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND_PIECES", 40)
    rng = random.Random(1)
    pieces = spark.createDataFrame([(i, i, 0, 0, rng.randint(1, 1024), 0) for i in range(300)], packing.PIECES)
    rows = packing.pack(spark, pieces).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["uid"] for r in rows) == list(range(300))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    sizes = [r["length"] for r in rows]
    assert len(bins) <= 1.03 * packing.bound(sizes, 1024) + 1


def test_token_files_of_odd_ids(spark, tmp_path):
    rows = [(None, "x"), (3, "b"), (3, "b"), (3, "c"), (1, None)]
    folder = f"file://{tmp_path}/t"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, tokens.default_path(), 2)
    got = token_files.read_tokens(spark, folder).collect()
    assert sorted(r["start"] for r in got) == [0, 2, 3, 5, 7] and min((r["start"], r["doc_id"]) for r in got)[1] is None
    assert token_files.n_files_of(spark.read.parquet(folder)) == spark.sparkContext.defaultParallelism


# --- near-duplicates --------------------------------------------------------------------------------------------------


def test_near_duplicates_with_nulls_and_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "x"), (2, a, "x"), (None, a, "x"), (7, None, "x"), (7, "", "x"), (9, b, "x"), (9, a, "x"), (4, b, "x"), (11, " \n", "x")]
    got = near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    assert len(got) == len(rows)
    label = {r["doc_id"]: r["component_id"] for r in got}
    # both texts of 9 are of one node, which joins the groups of a and b
    assert label == {5: 2, 2: 2, 9: 2, 4: 2, 7: 7, 11: 11, None: None}
    assert sorted(r["n_shingles"] for r in got) == [0, 0, 0, 36, 36, 36, 36, 36, 36]


def test_recall_of_near_copies(spark):
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(150):
        w = [f"v{rng.randint(0, 10**6)}" for _ in range(60)]
        x = list(w)
        at = rng.randrange(5, 50)
        x[at] = "edited"  # 5 of 56 shingles differ: a similarity of 51 / 61
        pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    label = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label[b] == a for a, b in pairs)


# --- WARC -------------------------------------------------------------------------------------------------------------

_HIDE = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>")
_BLOCK = re.compile(rf"(?i)</?(?:{'|'.join(sorted(warc.BREAKS))})(?![\w:-])[^>]*>")


def plain(page):
    """What the one pass must give, by patterns over the whole page, one after another."""
    page = _BLOCK.sub("\n", _HIDE.sub(" ", page.replace("\n", " ")))
    page = re.sub(r"<[a-zA-Z/!?][^>]*>", "", page)
    return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\f\v\r ]+", " ", page)).strip()


def test_page_text_equals_patterns():
    rng = random.Random(2)
    bits = ["<p>", "</p>", "<br/>", "<b>", "</b >", "<script>", "</script>", "<SCRIPT x='1'>", "</script >", "<style>", "</style>", "<!-- ", " -->", "<a href='/l'>", "</a>", "word", " ", "\n", "x < y", "<!doctype html>", "<div class=c>", "</div>", "<title>", "</title>", "<h1>"]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        # the patterns look for comments and hidden elements first, wherever they are; a page must not hide one in the other
        if not re.search(r"(?is)<!--(?:(?!-->).)*<(script|style)|<(script|style)[^>]*>(?:(?!</\2).)*<!--|<(script|style)[^>]*>(?:(?!</\3\s*>).)*<(script|style)", page) and "<!--" not in page.rpartition("-->")[2]:
            assert warc.text_of(page) == plain(page), page


def test_hostile_pages_take_linear_time():
    for bit in ("<script>", "<!--", "<title>", "<a ", "<a href=", "<a href='", "<template><!--", "<", "</script", "&lt", "<p ", "<a href=\"x"):
        page = bit * (3_000_000 // len(bit))
        began = time.perf_counter()
        warc.Page(page)
        assert time.perf_counter() - began < 20, bit


def test_warc_of_no_rows_and_clashing_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(none)).count() == 0
    got = warc.derive(warc.responses(spark.createDataFrame([(1, "u", "<p>x", "own")], "page_id long, url string, html string, record string"))).collect()
    for r in got:
        named = dict(warc.parsed(r["record"])[0])
        assert "WARC-Concurrent-To" not in named and named["WARC-Refers-To"] == r["refers_to"] and named["WARC-Source-Payload-Digest"] == r["source_digest"]
    assert {r["kind"] for r in got} == {"metadata", "conversion"}


# --- secrets ----------------------------------------------------------------------------------------------------------


def brute_base(text):
    """Matches by hand: at each place the longest run that each kind allows, leftmost and apart."""
    out = []
    for kind in secrets.KINDS:
        i = 0
        while i < len(text):
            if kind == "assign":
                m = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(k)].lower() == k), None)
                if m is None:
                    i += 1
                    continue
                j = i + len(m)
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    i += 1
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                e = j
                while e < len(text) and re.match(r"[A-Za-z0-9+/_.=-]", text[e]):
                    e += 1
                if e == j:
                    i += 1
                    continue
                if e - j >= 6:
                    out.append((kind, i, e))
                i = e
            elif kind == "access":
                e = i + 4
                while text[i:i + 4] == "AKIA" and e < len(text) and re.match("[A-Z0-9]", text[e]):
                    e += 1
                if text[i:i + 4] == "AKIA" and e > i + 4:
                    if e - i >= 20:
                        out.append((kind, i, e))
                    i = e
                else:
                    i += 1
            else:
                e = i
                while e < len(text) and text[e] in "0123456789abcdef":
                    e += 1
                if e - i >= 24:
                    out.append((kind, i, e))
                i = max(e, i + 1)
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def brute_links(text, base, scope):
    """Every secret against every identifier and every endpoint."""
    ends = [m.span() for m in secrets.ENDPOINT.finditer(text)]
    ids = secrets._joined([*(m.span() for m in secrets.IDENTIFIER.finditer(text)), *((s, e) for k, s, e in base if k == "access")])
    found = [("linked", *m.span()) for m in secrets.OPAQUE.finditer(text) if secrets._mixed(m.group())]
    over = lambda x, p: p[0] < x[2] and p[1] > x[1]
    found = [x for x in found if not any(over(x, s[1:]) for s in base) and not any(over(x, p) for p in ids) and (not any(over(x, p) for p in ends) or text[x[1] - 1 : x[1]] == "=")]
    found += [x for x in base if x[0] != "access"]
    away = lambda x, p: x[1] - p[1] if p[1] <= x[1] else p[0] - x[2]
    out = []
    for x in found:
        a = sorted((away(x, p), p) for p in ids if not over(x, p) and away(x, p) <= scope)
        b = sorted((-1 if over(x, p) else away(x, p), p) for p in ends if over(x, p) or away(x, p) <= scope)
        if a and b:
            out.append((x, a[0][1], b[0][1]))
    return sorted(out, key=lambda x: (x[0][1:], x[0]))


def test_secrets_equal_brute_force():
    rng = random.Random(6)
    bits = ["password", "Secret", "api_key", "apikey", "token", " = ", ": ", "=", '"', "'", " ", "  " * 6, "abc123", "AKIA", "A1B2" * 5, "ab12" * 7, "deadbeef" * 3, "client_id=", "account name: ", "aws_access_key_id = ", "host=db.example.com", "https://x.example.com/a?k=", "aB3xYz9Qw2Lk8Mn4Pq7Rs", "wJalrXUtnFEMI/K7MDENG/bPx", "zz", "\n", "é", "x" * 30]
    links = 0
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        base, spans, got = secrets.found(text, 40)
        assert base == brute_base(text), text
        want = brute_links(text, base, 40)
        assert sorted(got, key=lambda x: (x[0][1:], x[0])) == want, text
        assert set(spans) == set(base) | {x for x, _, _ in want if x[0] == "linked"} and spans == sorted(spans, key=lambda s: (s[1], (*secrets.KINDS, "linked").index(s[0])))
        links += len(want)
    assert links > 200


def test_parts_of_any_length(spark):
    token = "aB3xYz9Qw2" * 40
    text = f"client_id{' ' * 30}={' ' * 30}{'n' * 300}\nkey {token}\nhttps://{'h' * 500}.example.com/"
    ((kind, s, e),) = secrets.spans_of(text)[1]
    assert (kind, text[s:e]) == ("linked", token)
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    link = got["links"][0]
    assert text[link["identifier"]["start"] : link["identifier"]["end"]].endswith("n" * 300) and text[link["endpoint"]["start"] : link["endpoint"]["end"]].startswith("https://hh")
    with pytest.raises(ValueError):
        secrets.scan(spark.createDataFrame([(1, text)], "links long, text string"), keep=["links"])


# --- the others -------------------------------------------------------------------------------------------------------


def test_toxicity_sample_is_bounded_by_bytes_and_ids(spark):
    texts = [(i, ("vermin scum " if i % 4 == 0 else "plain words ") * 30) for i in range(400)]
    docs = spark.createDataFrame(texts + [(0, "other text of the same id")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    whole = toxicity.trained(docs, labels)
    few = toxicity.trained(docs, labels, most_bytes=(4000, 6000))
    assert len(whole.keys) and len(few.keys) and few.prior == whole.prior == -1.0
    assert toxicity.trained(docs, labels, most_bytes=(0, 0)).prior == 0.0
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs.filter("doc_id > 0"), few).collect()}
    assert min(score[i] for i in range(4, 400, 4)) > max(score[i] for i in range(1, 400, 4))
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("score", F.lit(1)), few, keep=["score"])


def test_windows_are_drawn_evenly(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_WINDOWS", 500)
    seen = []
    monkeypatch.setattr(toxicity, "_fit_chain", lambda f, t, m, n: seen.append(len(f)) or (np.zeros(n), np.zeros(4)))
    toxicity.fit(pa.array(["vermin " * 2000] * 35 + ["plain words " * 20] * 105), np.arange(140) < 35)
    assert 400 < seen[0] < 600


def test_top_k_of_equal_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (None, [1.0, 1.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")), F.col("vec_id") == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 8192), (0, 2, 1, 4096), (0, 3, 1, 4096)]


def test_top_k_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "PART_BUCKETS", 1)
    monkeypatch.setattr(topk, "TILE_PARTS", 2)
    monkeypatch.setattr(topk, "TILE_BLOCKS", 2)
    monkeypatch.setattr(topk, "SEED_EACH", 5)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(600, 6)) * rng.lognormal(0, 1, (600, 1))).astype(np.float32)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()}
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 600, 20):
        s = v @ v[q]
        want = sorted((-s[i], i) for i in range(600) if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, -n) for n, i in want]


def test_url_filter_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    labels = ["a", "b", "com", "org", "x"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = {(host(rng.randint(1, 3)), "/" * rng.randint(0, 1) + "".join(rng.choice("pq/") for _ in range(rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(60)}
    listed = {h + p: (h, p, v) for (h, p), v in rules.items() if p == "" or p[0] == "/"}
    urls = [f"http://{host(rng.randint(1, 4))}/{''.join(rng.choice('pq/') for _ in range(rng.randint(0, 4)))}" for _ in range(400)]
    urls += urls[:20]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, labels string")
    table = url_filter.rules_frame(spark, [(v, r) for r, (_, _, v) in listed.items()])
    for most in (url_filter.MAX_BROADCAST_RULES, 1):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, table).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            h, p = re.match(r"http://([^/]*)(.*)$", u).groups()
            fits = [(len(r), r, v) for r, (rh, rp, v) in listed.items() if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
            assert got[i] == (max(fits)[1:] if fits else (None, "allow"))
    with pytest.raises(ValueError):
        url_filter.filter_urls(df.withColumn("host", F.lit("x")), table, keep=["host"])


def test_quality_refuses_clashing_columns(spark):
    with pytest.raises(ValueError):
        quality.quality(spark.createDataFrame([(1, "x")], "kept long, text string"), keep=["kept"])


def unigram_model(path, pieces):
    """A model file by hand: no bytes, no normalisation, a mark before each text."""
    field = lambda n, raw: bytes([n << 3 | 2, len(raw)]) + raw
    out = b""
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, s, 1) for p, s in pieces)]:
        out += field(1, field(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + bytes([3 << 3, kind]))
    out += field(2, bytes([3 << 3, 1]))
    out += field(3, field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    path.write_bytes(out)


def test_unigram_equals_the_library(tmp_path):
    library = pytest.importorskip("sentencepiece")
    mark = sentencepiece.MARK
    # sums that tie, in quarters so that they are exact in any precision
    pieces = [(mark, -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -1.5), ("aba", -3.0), (mark + "a", -2.25), (mark + "ab", -3.0), ("c", -4.0), ("bc", -2.75), ("aa", -2.0), ("bb", -2.25)]
    unigram_model(tmp_path / "u.model", pieces)
    lib, rng = library.SentencePieceProcessor(model_file=str(tmp_path / "u.model")), random.Random(7)
    enc = sentencepiece.PieceEncoder(str(tmp_path / "u.model"))
    texts = ["".join(rng.choice("aaabbbc  é中") for _ in range(rng.randint(0, 20))) for _ in range(1500)] + ["", " ", "éé é", "abababab" * 50]
    for a, b, ids, off in enc.encode(pa.array(texts)):
        want = lib.encode(texts[a:b])
        for i in range(b - a):
            assert ids[off[i] : off[i + 1]].tolist() == want[i], texts[a + i]


def test_pipeline_keeps_the_texts_of_one_id(spark, tmp_path):
    import corpus_pipeline

    prose = lambda seed: " ".join(w for k in range(60) for w in ("the", f"w{k}x{seed}"))
    rows = [(1, prose(1), "en", "b", 5), (1, prose(1), "en", "a", 5), (1, prose(2), "en", "s", 5), (2, prose(3), "en", "s", 5), (3, prose(3), "en", "s", 5), (None, prose(4), "en", "s", 5), (None, prose(4), "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(corpus_pipeline.near_dup_stage(spark, docs, "").select("doc_id", "text", "source").collect(), key=repr)
    assert sorted((r["doc_id"], r["text"] == prose(1), r["source"]) for r in kept if r["doc_id"]) == [(1, False, "s"), (1, True, "a"), (2, False, "s")]
    assert sum(r["doc_id"] is None for r in kept) == 2
    docs.limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
