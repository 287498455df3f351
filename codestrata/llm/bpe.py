"""Operator 1: byte-level BPE encoding and decoding.

Every chunk of texts is cut into pre-tokens with class tables over its code points
(the public pattern of the rank files), equal pre-tokens are found by hash, and only
those not met before by this worker are merged. Merging runs on length-bucketed
padded matrices: each round looks up the rank of every adjacent pair in a hash table,
every row merges its leftmost pair of minimum rank, finished rows leave the matrix and
its width is compacted. A pre-token over ``LONG`` bytes is merged with a heap instead,
since a row of a matrix needs as many rounds as it has bytes.

Ids are decoded again and compared with the text's bytes. A text that differs (two
pre-tokens with one 64-bit hash) is encoded anew, pre-token by pre-token, so the result
never depends on hashes being distinct.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._frames import batched, id_text, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 256
"""Bytes over which a pre-token is merged with a heap."""
CACHE_WORDS = 400_000
"""Pre-tokens a worker remembers; beyond it the memory starts afresh. Speed only."""
DECODE_IDS = 1 << 20
"""Token ids that are decoded at once."""
SCHEMA = "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean"

_NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_models: dict[str, Bpe] = {}
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                run = np.frombuffer(m.group().encode("utf-32-le"), np.uint32)
                kinds[run] = kind
        _classes.append(kinds)
    return _classes[0]


def pretoken_starts(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Code-point offsets at which a pre-token begins; ``cuts``: text starts and the end."""
    n = len(points)
    kinds = _class_table()[points]
    border = np.zeros(n + 1, bool)
    border[cuts] = True
    change = border.copy()
    change[1:n] |= kinds[1:] != kinds[:-1]
    change[n] = True
    begin = np.flatnonzero(change[:n])
    if not len(begin):
        return begin
    end = np.append(begin[1:], n)
    kind = kinds[begin]
    start = np.zeros(n, bool)
    # white space: all but the last character, then the last, unless it is a blank that the next pre-token takes
    ws = kind == _SPACE
    a, b = begin[ws], end[ws]
    last = border[b]
    start[a[last]] = True
    a, b = a[~last], b[~last]
    blank = points[b - 1] == 32
    start[a[b - a > 1]] = True
    start[b[~blank] - 1] = True
    # other runs
    a, b, k = begin[~ws], end[~ws], kind[~ws]
    lead = np.zeros(len(a), bool)
    inner = a > 0
    lead[inner] = ~border[a[inner]] & (points[a[inner] - 1] == 32)
    start[a - lead] = True
    # contractions: an apostrophe alone, without a blank before it, and letters after it in the same text
    apos = (k == _OTHER) & (b - a == 1) & ~lead & (points[a] == 39)
    apos[apos] = ~border[b[apos]]
    at = np.flatnonzero(apos)
    at = at[at + 1 < len(a)]
    at = at[(k[at + 1] == _LETTER) & (a[at + 1] == b[at])]
    if len(at):
        s, e = a[at + 1], b[at + 1]
        one = points[s]
        two = np.where(e - s > 1, points[np.minimum(s + 1, n - 1)], 0)
        size = np.where(np.isin(one, [115, 100, 109, 116]), 1, 0)
        for x, y in ("ll", "ve", "re"):
            size[(one == ord(x)) & (two == ord(y))] = 2
        hit = size > 0
        s, e, size = s[hit], e[hit], size[hit]
        start[s] = False
        rest = s + size < e
        start[(s + size)[rest]] = True
    return np.flatnonzero(start)


class Bpe:
    """A rank vocabulary: encodes byte strings to ids and ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        parts = [b""] * self.size
        for word, i in ranks.items():
            parts[i] = word
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for word, i in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        self._build(np.array(keys, np.uint64), np.array(merged, np.int32))
        self.pairs = dict(zip(keys, merged, strict=True))
        self._forget()

    @classmethod
    def load(cls, path: str) -> Bpe:
        if path not in _models:
            with open(path, "rb") as f:
                _models[path] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        return _models[path]

    # -- pair table: open addressing, probed for whole matrices at once

    def _build(self, keys: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.merged = np.full(1 << bits, _NONE, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            mine, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[mine], self.merged[mine] = keys[put], merged[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, ``_NONE`` where there is none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        flat = keys.ravel()
        slot = self._slot(flat)
        found = self.keys[slot]
        out = np.where(found == flat, self.merged[slot], _NONE)
        open_ = np.flatnonzero((found != flat) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == flat[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(keys.shape)

    # -- merging

    def merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of padded rows of bytes: (flat ids, ids of each row), in row order."""
        ids = self.single[rows]
        count = lengths.astype(np.int64).copy()
        done = np.full(ids.shape, -1, np.int32)
        live = np.arange(len(ids))
        cell = np.arange(ids.shape[1])
        while len(live):
            width = ids.shape[1]
            if width < 2:
                done[live, :width] = ids
                break
            rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
            rank[cell[None, 1:width] >= count[live][:, None]] = _NONE
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), at]
            over = best == _NONE
            if over.any():
                done[live[over], :width] = ids[over]
                keep = ~over
                ids, live, at, best = ids[keep], live[keep], at[keep], best[keep]
                if not len(live):
                    break
            ids = np.take_along_axis(ids, cell[None, : width - 1] + (cell[None, : width - 1] > at[:, None]), axis=1)
            ids[np.arange(len(live)), at] = best
            count[live] -= 1
            ids = ids[:, : max(1, int(count[live].max()))]
        return done[cell[None, :] < count[:, None]], count

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long pre-token: a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or pairs.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := pairs.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many byte spans: (flat ids, ids of each span), in span order."""
        pieces: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 48, 64, 128, LONG):
            pick = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for part in np.array_split(pick, max(1, len(pick) * high // (1 << 20))) if len(pick) else ():
                width = int(lengths[part].max())
                cells = np.arange(width)
                inside = cells[None, :] < lengths[part][:, None]
                rows = np.where(inside, data[np.minimum(starts[part][:, None] + cells[None, :], len(data) - 1)], 0)
                flat, count = self.merge_rows(rows, lengths[part])
                for i, x in zip(part.tolist(), np.split(flat, np.cumsum(count)[:-1]), strict=True):
                    pieces[i] = x
        for i in np.flatnonzero(lengths > LONG).tolist():
            pieces[i] = self.merge_long(data[starts[i] : starts[i] + lengths[i]].tobytes())
        count = np.array([len(x) for x in pieces], np.int64)
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.int32)), count

    # -- remembered pre-tokens

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_n = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self._forget()
        at = len(self.known_ids) + np.cumsum(count) - count
        self.known_ids = np.concatenate((self.known_ids, flat))
        order = np.argsort(np.concatenate((self.known, hashes)), kind="stable")
        self.known_at = np.concatenate((self.known_at, at))[order]
        self.known_n = np.concatenate((self.known_n, count))[order]
        self.known = np.concatenate((self.known, hashes))[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, offsets of each text's ids, whether it decodes to its bytes)."""
        data, offs = K.utf8_parts(texts)
        string = data.tobytes().decode("utf-8", "surrogatepass")
        points = np.frombuffer(string.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        cuts = np.searchsorted(byte_at, offs)
        starts = byte_at[pretoken_starts(points, cuts)]
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        hashes = K.span_hash(data, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = (at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != unique) if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE_WORDS:
                self._forget()
                new[:] = True
            flat, count = self.merge_words(data, starts[first[new]], lengths[first[new]])
            self._learn(unique[new], flat, count)
            at = np.searchsorted(self.known, unique)
        word_at, word_n = self.known_at[at][inverse], self.known_n[at][inverse]
        ids = self.known_ids[K.ragged(word_at, word_n)]
        per_word = np.concatenate(([0], np.cumsum(word_n)))
        bounds = per_word[np.searchsorted(starts, offs)]
        ok = self._same(ids, bounds, data, offs)
        if not ok.all():
            ids, bounds = self._again(ids, bounds, ok, texts)
            ok = self._same(ids, bounds, data, offs)
        return ids, bounds, ok

    def _same(self, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        decoded, lengths = self.decode_flat(ids)
        ends = np.concatenate(([0], np.cumsum(lengths)))[bounds]
        if len(decoded) == len(data) and (ends == offs).all() and (decoded == data).all():
            return np.ones(len(offs) - 1, bool)
        return np.array([decoded[ends[i] : ends[i + 1]].tobytes() == data[offs[i] : offs[i + 1]].tobytes() for i in range(len(offs) - 1)], bool)

    def _again(self, ids: np.ndarray, bounds: np.ndarray, ok: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i, fine in enumerate(ok.tolist()):
            parts.append(ids[bounds[i] : bounds[i + 1]] if fine else self.encode_one(texts[i].as_py() or ""))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def encode_one(self, text: str) -> np.ndarray:
        """Ids of one text, pre-token by pre-token with the pattern itself."""
        words = [w.encode("utf-8", "surrogatepass") for w in regex.findall(PATTERN, text)]
        return np.concatenate([np.zeros(0, np.int32), *(self.merge_long(w) for w in words)])

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, bytes of each)."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.lengths)):
            raise ValueError(f"a token id is outside the vocabulary of {len(self.lengths)}")
        lengths = self.lengths[ids]
        return self.blob[K.ragged(self.offsets[ids], lengths)], lengths

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_flat(np.asarray(list(ids), np.int64))[0].tobytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every text.

    Returns (doc_id, n_tokens, tokens, round_trip), one row for each input row, also
    for repeated rows and ids; other columns are not read, so their names can't clash.
    A null text gives null tokens, null n_tokens and null round_trip; an empty one an
    empty list. A null id stays null. Texts of any length are encoded whole.
    No shuffle: one scan of two columns and one Arrow pass.
    """

    def one(batch: pa.RecordBatch):
        model = Bpe.load(vocabulary)
        for a, b in K.chunks(batch.column(1)):
            texts = batch.column(1).slice(a, b - a)
            null = texts.is_null()
            ids, bounds, ok = model.encode(texts)
            n = np.diff(bounds).astype(np.int32)
            mask = null.to_numpy(zero_copy_only=False)
            # a null list keeps its place in the offsets with no values of its own
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(mask) if mask.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, mask=mask), tokens, pa.array(ok, mask=mask)], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return id_text(docs, id_col, text_col).mapInArrow(batched(one), SCHEMA)


def decode(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of token ids: (doc_id, text), one row for each input row. Null tokens give a
    null text, an empty list an empty one; lists of any length are decoded whole. Bytes that
    are not UTF-8 are replaced. An id outside the vocabulary, a negative one included, or a
    null in a list is an error. A null id stays null, repeated rows are decoded alike, and
    other columns are not read. No shuffle: the ids of a batch are decoded together."""

    def one(batch: pa.RecordBatch):
        model = Bpe.load(vocabulary)
        lists = batch.column(1)
        null = lists.is_null().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # lists are decoded together up to a bounded number of ids; a longer one by itself
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + DECODE_IDS, side="right")))
            flat = lists.slice(start, stop - start).flatten()
            if flat.null_count:
                raise ValueError("a list of token ids holds a null")
            data, lengths = model.decode_flat(flat.to_numpy())
            bounds = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes[start:stop])))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), _strings(data, bounds, null[start:stop])], ["doc_id", "text"])
            start = stop

    picked = tokens.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{tokens_col}`").cast("array<int>").alias("ids"))
    return picked.mapInArrow(batched(one), "doc_id bigint, text string")


def _strings(data: np.ndarray, bounds: np.ndarray, null: np.ndarray) -> pa.Array:
    """Byte ranges as a column of texts."""
    raw = pa.Array.from_buffers(pa.large_binary(), len(null), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    try:
        out = raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out) if null.any() else out


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
