"""Byte-level BPE ids in bulk.

The ids come from the tokenizers library. A text's pretokens (the pieces that the vocabulary's own pattern cuts it into) are
found for a whole slice of texts at once with array operations, and the library encodes each distinct pretoken once; ids of
repeated pretokens are copied. A pretoken encodes alike alone and in its text, since the pattern cuts it into itself and
merges never cross pretokens. Texts with code points outside the range that the array form covers go to the library whole.

A text longer than a slice is encoded in parts, cut only where the pattern always cuts, whatever stands before and after: the
parts' ids one after another are the text's. So the arrays of the work do not grow with a text, only its ids do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SLICE_BYTES, span_hashes, text_parts, text_slices

#: Code points up to here are cut by arrays.
COVERED = 0x250
SPACE, LETTER, DIGIT, OTHER, FAR = range(5)
_KIND = np.full(COVERED + 1, FAR, np.uint8)
for _c in range(COVERED):
    _g = unicodedata.category(chr(_c))
    _KIND[_c] = LETTER if _g[0] == "L" else DIGIT if _g[0] == "N" else SPACE if _c in (0x85, 0xA0, *range(9, 14), 32) else FAR if _g == "Cn" else OTHER
_CONTRACTED = ("s", "d", "m", "t", "ll", "ve", "re")
#: Distinct pretokens remembered by a worker; beyond, the memory is emptied.
MOST_KNOWN = 1 << 21


class Encoder:
    """One tokenizer file, with the pretokens met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # where in self.ids each key's ids begin
        self.n = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return pretokens(data, off)

    def places(self, data: np.ndarray) -> np.ndarray:
        return sure_cuts(data)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """keys: sorted and new."""
        got = self.whole(pieces)
        n = np.fromiter(map(len, got), np.int32, len(got))
        ids = np.fromiter((i for g in got for i in g), np.uint32, int(n.sum()))
        if len(ids) and ids.max() > 0xFFFF and self.ids.dtype != np.uint32:
            self.ids = self.ids.astype(np.uint32)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])

    def slice_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and the texts' offsets among them."""
        s, e, first, far = self.cut(data, off)
        h = span_hashes(data, s, e)
        keys, where, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MOST_KNOWN:
            self.forget()
        k = np.searchsorted(self.keys, keys)
        if len(self.keys):
            new = self.keys[np.minimum(k, len(self.keys) - 1)] != keys
        else:
            new = np.ones(len(keys), bool)
        if new.any():
            raw = data.tobytes()
            w = where[new]
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(s[w].tolist(), e[w].tolist(), strict=True)])
            k = np.searchsorted(self.keys, keys)
        k = k[inv] if len(keys) else k
        n = self.n[k].astype(np.int64) if len(k) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        # the ids of every pretoken, copied from where they are kept
        take = np.arange(ends[-1]) - np.repeat(ends[:-1] - (self.at[k] if len(k) else 0), n)
        ids = self.ids[take].astype(np.uint32)
        bounds = ends[first]
        if len(far):
            raw, parts, counts = data.tobytes(), [], np.diff(bounds)
            whole = dict(zip(far.tolist(), self.whole([raw[off[i] : off[i + 1]].decode() for i in far.tolist()]), strict=True))
            for i in range(len(off) - 1):
                parts.append(np.array(whole[i], np.uint32) if i in whole else ids[bounds[i] : bounds[i + 1]])
                counts[i] = len(parts[-1])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        return ids, bounds


# ASCII by kind, all else apart; the last bytes of full stops and commas that stand between letters without blanks.
_ASCII = np.full(256, FAR, np.uint8)
_ASCII[:128] = _KIND[:128]


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Places where the pattern cuts whatever surrounds them: after an ASCII letter or digit before ASCII of another kind,
    after other ASCII before white space, and after a CJK full stop or comma before a CJK letter."""
    a, b = _ASCII[data[:-1]], _ASCII[data[1:]]
    word = ((a == LETTER) | (a == DIGIT)) & (b != a) & (b != FAR)
    ok = word | ((a == OTHER) & (b == SPACE))
    if len(data) > 3:
        last, middle, first = data[2:-1], data[1:-2], data[:-3]
        stop = ((first == 0xE3) & (middle == 0x80) & (last == 0x82)) | ((first == 0xEF) & (middle == 0xBC) & (last == 0x8C))
        ok[2:] |= stop & (data[3:] >= 0xE5) & (data[3:] <= 0xE8)  # U+5000 to U+8FFF, letters without a gap
    return np.flatnonzero(ok) + 1


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the pretokens, their offsets by text, and the texts that arrays do not cover (these get no spans)."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)  # where each code point begins
    b = data[at].astype(np.uint32)
    two = np.flatnonzero((b >= 0xC0) & (b < 0xE0))
    code = b.copy()
    code[two] = ((b[two] & 0x1F) << 6) | (data[at[two] + 1] & 0x3F)
    code[b >= 0xE0] = COVERED
    kind = _KIND[np.minimum(code, COVERED)]
    n = len(kind)
    doc = np.searchsorted(at, off)  # texts' first code points
    far = np.unique(np.searchsorted(doc, np.flatnonzero(kind == FAR), "right") - 1)
    # Code points of FAR texts are left out altogether.
    first = np.zeros(n + 1, bool)
    first[doc] = True
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    is_space = kind == SPACE
    ends_run = np.ones(n, bool)  # the last code point of a run of one kind within its text
    ends_run[:-1] = start[1:]
    ends_text = first[1:]
    # A run of white space before something else gives up its last code point: a blank joins what follows, another stands alone.
    last = np.flatnonzero(is_space & ends_run & ~ends_text)
    start[last] = True
    joins = last[code[last] == 32]
    start[joins + 1] = False
    # 's and the like: an apostrophe alone in its run, not joined by a blank, with the letters that follow it.
    apo = np.flatnonzero((code == 39) & ends_run & ~ends_text & start)
    if len(apo):
        apo = apo[(kind[apo + 1] == LETTER)]
        nxt, nxt2 = code[apo + 1], np.where(apo + 2 < n, code[np.minimum(apo + 2, n - 1)], 0)
        same = (apo + 2 < n) & ~first[np.minimum(apo + 2, n)]
        size = np.zeros(len(apo), np.int64)
        for c in _CONTRACTED:
            ok = (nxt == ord(c[0])) if len(c) == 1 else (nxt == ord(c[0])) & (nxt2 == ord(c[1])) & same
            size[ok] = len(c)
        apo, size = apo[size > 0], size[size > 0]
        start[apo + 1] = False
        rest = apo + 1 + size
        rest = rest[rest < n]
        start[rest] = True
    if len(far):
        gone = np.zeros(n, bool)
        for i in far.tolist():
            gone[doc[i] : doc[i + 1]] = True
        start &= ~gone
        keep_start = start.copy()
        follows = np.zeros(n + 1, bool)
        follows[doc] = True
        marks = np.flatnonzero(start | (gone & follows[:-1]))
        ends = np.append(marks[1:], n)
        ok = keep_start[marks]
        s, e = marks[ok], ends[ok]
    else:
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)[: len(s)]
    at = np.append(at, len(data))
    return at[s], at[e], np.searchsorted(s, doc), far


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; what it has learned stays from task to task."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(enc: Encoder, texts: pa.Array, end_id: int | None = None, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) by slice; with the end id after each text, where there is one."""
    for a, b, data, off in text_slices(texts, most):
        if b - a == 1 and len(data) > most:
            got = [enc.slice_ids(part, np.array([0, len(part)]))[0] for part in text_parts(data, enc.places, most)]
            ids = np.concatenate(got)
            bounds = np.array([0, len(ids)])
        else:
            ids, bounds = enc.slice_ids(data, off)
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
        yield a, b, ids, bounds


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
