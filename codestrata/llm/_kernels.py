"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, one
bounded chunk at a time, so a Python worker never holds more than a few dozen
megabytes of scratch whatever the batch size: a chunk ends at ``CHUNK_BYTES``
of text, and a single longer text is a chunk of its own (texts are never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_POWER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n + 1:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for name, base in (("up", _POWER), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offs[0]) if len(offs) else 0
    return raw[first : int(offs[-1])] if len(offs) else raw[:0], offs - first


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column whose texts together stay under the limit."""
    if not len(column):
        return
    _, offs = utf8_parts(column)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    sums = (total[ends] - total[starts]) * down[starts]
    return mix64(sums + (ends - starts).astype(np.uint64) * _BASE)


class Words:
    """The words of a chunk of texts: lower-cased maximal runs of ASCII letters,
    ASCII digits and non-ASCII characters.

    ``hash``: one 64-bit hash a word; ``first``: offsets of each text's words.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        if lower:
            texts = pc.utf8_lower(texts)
        self.texts = texts
        self.data, self.offs = utf8_parts(texts)
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _WORD[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.hash = span_hash(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offs)

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text its sorted distinct word n-gram hashes.

    A text of fewer than ``n`` words has one gram, all its words; a text without
    words has its own bytes for one gram, unless it is blank: then the set is empty.
    """
    w = Words(texts)
    out = []
    h = w.hash
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            g = mix64(g * _BASE + h[k : len(h) - n + 1 + k])
    else:
        g = np.zeros(0, np.uint64)
    for i in range(len(w.offs) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif b > a:
            g1 = np.zeros(1, np.uint64)
            for k in range(a, b):
                g1 = mix64(g1 * _BASE + h[k])
            out.append(mix64(g1 + np.uint64(b - a)))
        else:
            raw = w.data[w.offs[i] : w.offs[i + 1]].tobytes().strip()
            if raw:
                piece = np.frombuffer(raw, np.uint8)
                out.append(mix64(span_hash(piece, np.zeros(1, np.int64), np.full(1, len(piece)))))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
