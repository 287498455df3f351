"""Operator 10: licence scans by conditional compression.

A line with a licence keyword opens a candidate block, which takes in nearby keyword
lines; a long line counts as one line for each of its sentences. For each template a block
reaches as many words further, to both sides, as the template and its allowed edits have,
since wordings go on past their last keyword. The block and that stretch are compressed
alone and with the template as a zstandard raw-content dictionary; the bytes it saves, of
the one or the other, rank the templates. Those that save a fair part
of what the template itself takes are confirmed in that order by wording: the least
word-level edit distance between the template and any stretch of the block must be
within a tenth of the template's words. A confirmed stretch is spent, so a block can
hold several licences and a notice within a longer one is not reported twice.
"""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ._frames import batched, id_text, table
from .license_texts import TEMPLATES

KEYWORDS = "licen[sc]|copyright|permission|redistribut|warrant|public domain|endorse"
JOIN_LINES = 8
"""Keyword lines at most this far apart make one block."""
LONG_LINE = 240
"""Characters over which a line is cut into sentences."""
SMALLEST_REACH = 16
"""Reaches are rounded up to this times a power of two, so that templates share what is compressed alone."""
SAVED = 0.2
"""A candidate must save this part of the template's own compressed size, ..."""
OVERHEAD = 9
"""... less these bytes, which a match costs in a frame however short it is."""
TOLERANCE = 0.1
"""Edits allowed for each word of a template, rounded down."""
LEVEL = 9
SCHEMA = "doc_id bigint, block int, license string, saved_bytes int, saved_share double, word_edits int, template_words int, exact boolean, differences string"

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_LINE = re.compile(KEYWORDS, re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """(words, candidate blocks) of a text; a block is a range of words, from its first keyword line to its last."""
    lines = [part for x in text.splitlines() for part in ([x] if len(x) <= LONG_LINE else _SENTENCE.split(x))]
    words: list[str] = []
    out: list[list[int]] = []
    last = 0
    for i, x in enumerate(lines):
        start = len(words)
        words += words_of(x)
        if _LINE.search(x):
            if out and i - last <= JOIN_LINES:
                out[-1][1] = len(words)
            else:
                out.append([start, len(words)])
            last = i
    return words, [(a, b) for a, b in out]


def nearest_stretch(template: np.ndarray, block: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``block`` nearest to ``template`` in word edits."""

    def last_row(t: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for w in t:
            best = np.empty_like(row)
            best[0] = row[0] + 1
            best[1:] = np.minimum(row[:-1] + (b != w), row[1:] + 1)
            row = np.minimum.accumulate(best - steps) + steps
        return row

    row = last_row(template, block, True)
    end = int(row.argmin())
    low = max(0, end - len(template) - int(row[end]))
    back = last_row(template[::-1], block[low:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


def regions(template: np.ndarray, block: np.ndarray, allowed: int) -> list[tuple[int, int]]:
    """Ranges of ``block`` that hold every stretch within ``allowed`` edits of ``template``.

    Such a stretch has at most so many words more than the template, and at most so many
    of the template's are missing; what no window with that many of its words covers is left out.
    """
    width = min(len(template) + allowed, len(block))
    known = np.concatenate(([0], np.cumsum(np.isin(block, template))))
    good = np.flatnonzero(known[width:] - known[: len(known) - width] >= len(template) - allowed)
    if not len(good):
        return []
    cuts = np.flatnonzero(np.diff(good) > width)
    return [(int(a), int(b) + width) for a, b in zip(good[np.append(0, cuts + 1)], good[np.append(cuts, len(good) - 1)], strict=True)]


class Scanner:
    """Templates with their compressors."""

    def __init__(self, templates: Mapping[str, str]):
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, **options)
        self.empty = len(self.plain.compress(b""))
        self.templates = []
        for name, text in sorted(templates.items()):
            words = words_of(text)
            data = " ".join(words).encode()
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            need = len(words) + int(TOLERANCE * len(words))
            reach = SMALLEST_REACH
            while reach < need:
                reach *= 2
            self.templates.append((name, words, reach, len(self.plain.compress(data)) - self.empty, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **options)))

    def ranked(self, words: list[str], a: int, b: int) -> list[tuple[int, float, str, list[str], int]]:
        """(bytes saved, share of the template's size, name, words, reach), the best first, for the block from ``a`` to ``b``."""
        alone: dict[tuple[int, int], tuple[bytes, int]] = {}
        out = []
        for name, template, reach, own, with_it in self.templates:
            saved: float = -math.inf
            for span in ((a, b), (max(0, a - reach), min(len(words), b + reach))):
                if span not in alone:
                    data = " ".join(words[span[0] : span[1]]).encode()
                    alone[span] = data, len(self.plain.compress(data))
                data, size = alone[span]
                # no template saves more than there is
                if size - self.empty >= SAVED * own - OVERHEAD:
                    saved = max(saved, size - len(with_it.compress(data)))
            if saved >= SAVED * own - OVERHEAD:
                out.append((saved, saved / own, name, template, reach))
        return sorted(out, key=lambda x: (-x[0], -x[1], x[2]))

    def confirm(self, words: list[str], blocks: list[tuple[int, int]]) -> list[tuple]:
        """Licences of a text: (block, name, saved bytes, share, edits, template words, differences)."""
        found = []
        codes: dict[str, int] = {}
        every = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
        for k, (first, last) in enumerate(blocks):
            for saved, share, name, template, reach in self.ranked(words, first, last):
                target = np.array([codes.get(w, -2) for w in template], np.int64)
                allowed = int(TOLERANCE * len(template))
                start = max(0, first - reach)
                block = every[start : last + reach]
                while True:
                    near = [(e, p + a, p + b) for p, q in regions(target, block, allowed) for e, a, b in [nearest_stretch(target, block[p:q])]]
                    edits, a, b = min(near, default=(allowed + 1, 0, 0))
                    if edits > allowed:
                        break
                    there = [words[start + i] if block[i] >= 0 else "" for i in range(a, b)]
                    # a stretch met from an earlier block counts for the one it lies in
                    home = next((j for j in range(k, len(blocks)) if blocks[j][1] > start + a and blocks[j][0] < start + b), k)
                    found.append((home, name, saved, share, edits, len(template), differences(template, there)))
                    block[a:b] = -1
        return found


def differences(template: list[str], text: list[str]) -> str:
    """The exact differences of wording: ``-template words +text words``, by position."""
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, template, text, autojunk=False).get_opcodes():
        if kind != "equal":
            out.append(f"@{a}" + (f" -{' '.join(template[a:b])}" if b > a else "") + (f" +{' '.join(text[c:d])}" if d > c else ""))
    return "; ".join(out)


_scanners: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each licence confirmed in a block of a text.

    (doc_id, block, license, saved_bytes, saved_share, word_edits, template_words, exact,
    differences); ``block`` counts from 0 within a text. A template is reported for
    each stretch of a block that is near enough. Null, blank and keyword-free texts give no rows; repeated rows give
    their rows again; a null id stays null; templates that save equally much are tried by
    share, then by name. Other columns are not read. No shuffle; the keyword test runs on
    whole Arrow columns, and only texts that pass it are looked at one by one.
    """
    chosen = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def one(batch: pa.RecordBatch):
        if chosen not in _scanners:
            _scanners.clear()
            _scanners[chosen] = Scanner(dict(chosen))
        scanner = _scanners[chosen]
        hit = pc.fill_null(pc.match_substring_regex(batch.column(1), KEYWORDS, ignore_case=True), False)
        ids, texts = batch.column(0).filter(hit).to_pylist(), batch.column(1).filter(hit)
        rows = []
        for i, text in zip(ids, texts, strict=True):
            for k, name, saved, share, edits, n, diff in scanner.confirm(*blocks_of(text.as_py())):
                rows.append((i, k, name, saved, round(share, 4), edits, n, edits == 0, diff))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(batched(one), SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
