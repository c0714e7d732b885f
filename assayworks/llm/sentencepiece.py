"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are cut into marked words (white space marks and what follows them; no piece crosses such a border). The distinct
words of a run of texts are sorted, which is the depth-first order of their trie, and for each word the forward states of
the prefix that it shares with the word before are reused: a state is the best last piece of a prefix, with its score.

For a unigram model the state is Viterbi's: the piece with the highest sum of scores. For a merge (BPE) model sums of scores
do not give the model's own segmentation, so there the state is the one last piece that the merges give this prefix: of the
pieces that end there, the one that stays apart from the last piece before it when the two are merged alone. Both are exact.

Characters without a piece become their bytes' pieces, or, where the model has none, one unknown piece for each run of them
in a word. Defined results: null and empty texts have no ids; repeated rows are encoded one by one; of sums that are equal the
one whose last piece is longest wins; a text longer than a slice is encoded in parts cut before blanks; a word of any length
is encoded whole, in time and memory linear in its length; an empty table gives an empty table; other columns are not looked
at. U+2581 in a text is white space to the model and is decoded as a blank.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import text_bytes
from .tokens import Encoder, encoded

MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, MERGES = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else (8 if kind == 1 else 4, i)
            v = b[i : i + n]
            i += n
        yield key >> 3, v


class Model:
    """Pieces, scores and kinds of a model file, and what its settings ask of the text."""

    def __init__(self, path: str):
        self.pieces, self.scores, self.kinds = [], [], []
        self.type, self.dummy_prefix = UNIGRAM, True
        with open(path, "rb") as f:
            raw = f.read()
        for n, v in _fields(raw):
            if n == 1:
                d = dict(_fields(v))
                self.pieces.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.kinds.append(d.get(3, NORMAL))
            elif n == 2:
                self.type = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3:
                d = dict(_fields(v))
                self.dummy_prefix = bool(d.get(3, 1))
                if d.get(2) or d.get(4, 1):
                    raise ValueError("a model that normalises its text is not supported")
        self.index = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.longest = max(map(len, self.index))
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.floor = min(self.scores) - 10.0  # what a character without a piece scores
        self.has_bytes = len(self.byte_ids) == 256
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._apart: dict[tuple[str, str], bool] = {}
        self._flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merged(self, text: str) -> list[str]:
        """The merge model's pieces of a short text, merge by merge: the highest score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.index.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: str, b: str) -> bool:
        """Whether a and b stay two pieces when merged alone; a == "": whether b is a piece that merges make."""
        got = self._apart.get((a, b))
        if got is None:
            if len(self._apart) > 4_000_000:
                self._apart.clear()
            got = self._apart[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def segmented(self, words: list[str]) -> list[list[str]]:
        """Pieces of each word. words: sorted."""
        out, before, states = [], "", [(0.0, 0, "")]
        for word in words:
            same = 0
            for x, y in zip(word, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            del states[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                states.append(self._unigram(word, end, states) if self.type == UNIGRAM else self._by_merges(word, end, states))
            parts, at = [], len(word)
            while at:
                _, start, piece = states[at]
                parts.append(piece)
                at = start
            out.append(parts[::-1])
            before = word
        return out

    def _unigram(self, word: str, end: int, states: list) -> tuple[float, int, str]:
        best = None
        for start in range(max(0, end - self.longest), end):
            k = self.index.get(word[start:end])
            if k is not None and (best is None or states[start][0] + self.scores[k] > best[0]):
                best = (states[start][0] + self.scores[k], start, word[start:end])
        if best is None or (word[end - 1] not in self.index and states[end - 1][0] + self.floor > best[0]):
            best = (states[end - 1][0] + self.floor, end - 1, word[end - 1])
        return best

    def _by_merges(self, word: str, end: int, states: list) -> tuple[float, int, str]:
        for start in range(max(0, end - self.longest), end - 1):
            piece = word[start:end]
            if piece in self.index and self.apart(states[start][2], piece):
                return 0.0, start, piece
        return 0.0, end - 1, word[end - 1]

    def ids(self, parts: list[str]) -> list[int]:
        """The ids of a word's pieces."""
        out: list[int] = []
        for piece in parts:
            k = self.index.get(piece)
            if k is not None:
                out.append(k)
            elif self.has_bytes:
                out += [self.byte_ids[b] for b in piece.encode()]
            elif out[-1:] != [self.unknown]:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.raw[i] for i in ids])
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def spells(self, ids: np.ndarray, off: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each text's ids decode to its marked bytes. off, ends: the texts' offsets among ids and bytes."""
        if self._flat is None:
            n = np.array([len(r) for r in self.raw], np.int64)
            self._flat = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(n) - n, n
        flat, at, n = self._flat
        right = np.zeros(len(off) - 1, bool)
        for i in range(len(right)) if len(ids) > 1 << 20 else ():  # long texts one by one, in runs of ids
            x, e, ok = off[i], ends[i], True
            while ok and x < off[i + 1]:
                run = ids[x : min(x + (1 << 17), off[i + 1])]
                made = self._bytes(run)
                ok = np.array_equal(made, data[e : min(e + len(made), ends[i + 1])])
                x, e = x + len(run), e + len(made)
            right[i] = ok and e == ends[i + 1]
        if len(ids) > 1 << 20:
            return right
        places = np.concatenate([[0], np.cumsum(n[ids])])[off]
        same = np.diff(places) == np.diff(ends)
        made = self._bytes(ids)
        if same.all():
            right[:] = True
            right[np.searchsorted(ends, np.flatnonzero(made != data), "right") - 1] = False
            return right
        return np.array([bool(ok) and np.array_equal(made[places[i] : places[i + 1]], data[ends[i] : ends[i + 1]]) for i, ok in enumerate(same)])

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        flat, at, n = self._flat
        size = n[ids]
        made = np.cumsum(size)
        return flat[np.repeat(at[ids] - (made - size), size) + np.arange(made[-1] if len(made) else 0)]


def marked_places(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut between marked words."""
    blank = data == 0x20
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def marked_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of runs of blanks with what follows them, and their offsets by text."""
    blank = data == 0x20
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    heads = off[:-1][np.diff(off) > 0]
    start[heads] = True
    s = np.flatnonzero(start)
    return s, np.append(s[1:], len(data))[: len(s)], np.searchsorted(s, off), np.zeros(0, np.int64)


class PieceEncoder(Encoder):
    """Learns each distinct marked word once, in sorted order."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.forget()

    cut = staticmethod(marked_words)
    places = staticmethod(marked_places)

    def whole(self, texts: list[str]) -> list[list[int]]:
        words = [t.replace(" ", MARK) for t in texts]
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list = [None] * len(words)
        for i, parts in zip(order, self.model.segmented([words[i] for i in order]), strict=True):
            out[i] = self.model.ids(parts)
        return out

    def marked(self, texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        if not self.model.dummy_prefix:
            return texts
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        yield from encoded(self, self.marked(texts))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """key, n_ids, ids_crc32 and either the ids, or (check) whether they decode to the text."""
    src = docs.select(docs[key], docs[text].alias("_text"))
    last = T.StructField("round_trip", T.BooleanType()) if check else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([src.schema[key], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            marked = enc.marked(batch.column("_text"))
            ends, data = text_bytes(marked)
            for a, b, ids, off in encoded(enc, marked):
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                if check:
                    got = pa.array(enc.model.spells(ids, off, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]))
                else:
                    got = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), pa.array(np.diff(off)), pa.array(crc, pa.int64()), got], names=schema.names)

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """df with the text of its ids."""
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path).model
        for batch in batches:
            texts = [model.decode(x) if x is not None else None for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), check=True)
