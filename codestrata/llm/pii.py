"""Operator 6: PII, by information-theoretic sanitisation.

Protected entities (addresses, numbers, secrets) are found by their form and replaced
by their class. What stands around them can still give them away, so the corpus tells
how much: with ``p(c)`` the share of documents that hold an entity of class ``c`` and
``p(c|t)`` the share of those with term ``t`` that have it near such an entity, the term
discloses ``log(p(c|t) / p(c))`` of the ``-log p(c)`` there is to know. In documents that
hold an entity of the class, terms are removed or replaced by a general one as that part
exceeds thresholds. The same is done with every single entity in place of a class, so that
a name which only ever stands beside one address goes where that address is. Documents
without entities are not touched.

A term is generalised to the kind of word it is: a name, a number, a code or a plain term.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize
from . import _kernels as K
from ._frames import id_text, numbered, table, tidy
from ._vocab import term_df

WINDOW = 5
"""Words on each side of an entity that count as near it."""
MIN_VALUES = 5
"""Different values of a class that a term must have stood near, so that copies of one document prove nothing."""
MIN_TEXTS = 2
"""Different texts in which a term must have stood near one entity, for the same reason."""
GENERALISE = 0.8
REMOVE = 0.95
"""Parts of a class's or an entity's information from which a term is generalised, or removed."""
TERMS_AT_ONCE = 200_000
"""Disclosing terms of classes that may be broadcast, checked by a count; more are joined to the words of the texts that hold entities."""
TEXT_ROWS = 20_000
"""Texts whose own terms may be broadcast; checked by a count."""
GENERAL = {"name": "<NAME>", "number": "<NUMBER>", "code": "<CODE>", "term": "<TERM>"}
"""What a term of each kind is generalised to; see ``kind_of``."""

_RULES = (
    ("SECRET", r"(?i:\b(?:\w{0,32}token|\w{0,32}secret|api[_-]?key|password|passwd|pwd|access[_-]?key)\b[\"']?\s{0,8}[:=]\s{0,8}[\"']?)(?P<SECRET>[^\s\"']{8,})"),
    ("SECRET", r"(?P<SECRET2>\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9_-]{20,}|(?<![0-9a-zA-Z])(?=[a-f]{0,64}[0-9])[0-9a-f]{32,}(?![0-9a-zA-Z]))"),
    ("IBAN", r"(?P<IBAN>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"),
    ("CARD", r"(?P<CARD>(?<![\w.])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7})(?!\w))"),
    ("SSN", r"(?P<SSN>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"),
    ("IP", r"(?P<IP>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)|(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:]))"),
    ("PHONE", r"(?P<PHONE>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})[ .-]?\d{2,4}[ .-]?\d{2,4}(?:[ .-]?\d{1,4})?|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"),
)
CLASSES = ("EMAIL", "SECRET", "IBAN", "CARD", "SSN", "IP", "PHONE")
_FORM = re.compile("|".join(r for _, r in _RULES))


def _candidate() -> str:
    """What a text needs for any rule to match, in the syntax of Arrow's regular expressions.

    Each part is a stretch that its rule can't match without, or less. The rules' ``\\d`` takes
    digits of all scripts, the parts only ASCII ones, so any other digit makes a candidate;
    and ``i`` also stands for its dotted and dotless kin, which the rules take for it too.
    """
    other = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    runs = [c for c in other if c - 1 not in other]
    ends = [c for c in other if c + 1 not in other]
    digits = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(runs, ends, strict=True))
    parts = (
        "@",
        f"[{digits}]",
        "(?i:token|secret|ap[iıİ][_-]?key|passw|pwd|access[_-]?key)",
        "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20}|sk-[A-Za-z0-9_-]{20}|[0-9a-f]{32}",
        "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
        "[0-9]{13}|[0-9]{4}[ -][0-9]{4}",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|(?:[0-9a-fA-F]{1,4}:){7}",
        r"\+[0-9]{1,3}[ .-]?[(0-9]|\([0-9]{3}\)[ .-]?[0-9]{3}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    )
    return "|".join(parts)


CANDIDATE = _candidate()
_LOCAL = re.compile(r"[\w.%+-]")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_WORD = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the protected entities of a text, in order, without overlaps.

    Every pattern scans in time proportional to the text, however long its words are.
    """
    found = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1)
        if m and start < at:
            found.append((start, m.end(), "EMAIL"))
        at = text.find("@", at + 1)
    for m in _FORM.finditer(text):
        kind = m.lastgroup if m.lastgroup != "sep" else "CARD"
        a, b = m.span(kind)
        found.append((a, b, "SECRET" if kind == "SECRET2" else kind))
    found.sort()
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2])
            continue
        out.append((a, b, kind))
    return out


def _near(text: str, spans: list[tuple[int, int, str]]) -> set[tuple[str, str, str]]:
    """(class, term, value) for the terms near each entity."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    ranges = [(bisect_right(ends, a), bisect_left(starts, b)) for a, b, _ in spans]
    inside = {i for (p, q), (a, b, _) in zip(ranges, spans, strict=True) for i in range(max(p - 1, 0), min(q + 1, len(words))) if starts[i] < b and ends[i] > a}
    out = set()
    for (p, q), (a, b, kind) in zip(ranges, spans, strict=True):
        for i in (*range(max(0, p - WINDOW), p), *range(q, min(len(words), q + WINDOW))):
            if i not in inside:
                out.add((kind, text[starts[i] : ends[i]].lower(), text[a:b]))
    return out


def _hits(column: pa.Array) -> np.ndarray:
    """Which texts can hold an entity: a superset of those that do."""
    return pc.fill_null(pc.match_substring_regex(column, CANDIDATE), False).to_numpy(zero_copy_only=False)


def kind_of(word: str) -> str:
    """The kind of a word as it stands: number, code (digits among letters), name (a capital first) or term."""
    if word.isdigit():
        return "number"
    if any(c.isdigit() for c in word):
        return "code"
    return "name" if word[:1].isupper() else "term"


def _value(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _contexts(batches):
    """Rows (class, term, value, text, first, docs): see ``disclosure``; a null term counts documents, of the value where there is one."""
    for batch in batches:
        rows = [(None, None, None, None, batch.num_rows - batch.column(1).null_count, 0)]
        for i in np.flatnonzero(_hits(batch.column(1))).tolist():
            text, key = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            spans = entities(text)
            if not spans:
                continue
            rows += [(kind, None, None, None, 1, 0) for kind in {k for _, _, k in spans}]
            rows += [(kind, None, _value(value), key, 0, 1) for kind, value in sorted({(k, text[a:b]) for a, b, k in spans})]
            seen = set()
            for kind, term, value in sorted(_near(text, spans)):
                rows.append((kind, term, _value(value), key, int((kind, term) not in seen), 1))
                seen.add((kind, term))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["class", "term", "value", "text", "first", "docs"])


def contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What stands near the entities of each text, counted; ``text`` is the text's ``xxhash64``."""
    picked = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    return materialize(picked.mapInArrow(tidy(_contexts), "class string, term string, value bigint, text bigint, first bigint, docs bigint").groupBy("class", "term", "value", "text").agg(F.sum("first").alias("first"), F.sum("docs").alias("docs")), "pii-contexts")


def disclosure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(class, value, term, near, df, part): how much of the information on a class, or on
    one entity of it, a term gives.

    ``value`` is null for the class as a whole, else the hash of the entity. ``near``:
    documents with the term near it; ``df``: documents with the term; ``part``: disclosed
    information over all there is. Left out are terms near fewer than ``MIN_VALUES``
    different values of a class, or near an entity in fewer than ``MIN_TEXTS`` different
    texts. Counted over all documents; repeated rows count each time, on both sides of the
    ratio. ``found``: the ``contexts`` of the documents.
    """
    rows = contexts(docs, id_col, text_col) if found is None else found
    totals = {r["class"]: r["n"] for r in rows.where("term IS NULL AND value IS NULL").groupBy("class").agg(F.sum("first").alias("n")).collect()}
    n_docs = max(1, totals.pop(None, 0) or 0)
    by_value = rows.where("term IS NOT NULL").groupBy("class", "term", "value").agg(F.sum("first").alias("first"), F.sum("docs").alias("docs"), F.count("*").alias("n_texts"))
    share = F.create_map(*[F.lit(x) for kv in sorted((k, v / n_docs) for k, v in totals.items()) for x in kv])[F.col("class")] if totals else F.lit(1.0)
    classes = by_value.groupBy("class", "term").agg(F.sum("first").alias("near"), F.count("*").alias("n_values")).where(F.col("n_values") >= MIN_VALUES)
    classes = classes.select("class", F.lit(None).cast("bigint").alias("value"), "term", "near", share.alias("share"))
    held = rows.where("term IS NULL AND value IS NOT NULL").groupBy("class", "value").agg((F.sum("docs") / n_docs).alias("share"))
    single = by_value.where(F.col("n_texts") >= MIN_TEXTS).join(held, ["class", "value"]).select("class", "value", "term", F.col("docs").alias("near"), "share")

    def hashed(batches):
        for batch in batches:
            data, offs = K.utf8_parts(batch.column(2))
            h = K.span_hash(data, offs[:-1], offs[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], ["class", "value", "term", "near", "share", "hash"])

    near = classes.union(single).mapInArrow(hashed, "class string, value bigint, term string, near bigint, share double, hash bigint")
    joined = near.join(term_df(id_text(docs, id_col, text_col)).withColumnRenamed("term", "hash"), "hash")
    given = F.least(F.lit(1.0), F.col("near") / F.greatest("df", F.lit(1)))
    part = F.when(F.col("share") >= 1.0, F.lit(0.0)).otherwise(F.log(given / F.col("share")) / -F.log("share"))
    return joined.select("class", "value", "term", "near", "df", part.alias("part"))


def _rewrite(text: str, terms: dict[str, dict[str, bool]], own: dict[str, bool] | None = None) -> tuple[str, int, int]:
    """(sanitised text, entities, terms). ``terms``: class -> term -> whether it is removed; ``own``: those of the text's entities."""
    spans = entities(text)
    if not spans:
        return text, 0, 0
    active = [own or {}, *(terms[k] for k in {k for _, _, k in spans} if k in terms)]
    out, at, n_terms = [], 0, 0

    def plain(piece: str) -> str:
        nonlocal n_terms
        parts, pos = [], 0
        for m in _WORD.finditer(piece):
            said = [a[w] for w in (m.group().lower(),) for a in active if w in a]
            if not said:
                continue
            n_terms += 1
            parts.append(piece[pos : m.start()])
            pos = m.end()
            if not any(said):
                parts.append(GENERAL[kind_of(m.group())])
            elif piece[pos : pos + 1] == " ":
                pos += 1
        return "".join([*parts, piece[pos:]])

    for a, b, kind in spans:
        out += [plain(text[at:a]), f"<{kind}>"]
        at = b
    return "".join([*out, plain(text[at:])]), len(spans), n_terms


def _holding_words(batches):
    """(class, term, text): the distinct words of each text that holds an entity of the class."""
    for batch in batches:
        rows = set()
        for i in np.flatnonzero(_hits(batch.column(1))).tolist():
            text, key = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            kinds = {k for _, _, k in entities(text)}
            if kinds:
                words = {m.group().lower() for m in _WORD.finditer(text)}
                rows |= {(kind, w, key) for kind in kinds for w in words}
        got = sorted(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["class", "term", "text"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, counts: tuple[str, str] = ("pii_entities", "pii_terms")) -> DataFrame:
    """The rows of ``docs`` with sanitised texts, and two counts, of entities and of terms.

    All columns are kept, in order; ``length_col`` is set to the new text's characters
    where it is a column. Existing columns named like ``counts`` are
    replaced; names beginning with ``__pii`` are reserved here. Null texts stay null with
    counts 0; empty texts, texts without entities and repeated rows come out as they went
    in, each once. Texts are scanned whole; the test that comes before the rules lets
    every text pass that a rule can match. A placeholder such as ``<EMAIL>`` that a text
    already has is a word like others. A term at a threshold exactly counts as beyond it;
    one that is generalised by one class or entity and removed by another is removed.

    Only counts are shuffled, and the terms of classes are broadcast, if they are
    ``TERMS_AT_ONCE`` or fewer; more are joined to the words of the texts that hold
    entities, with the same result. The terms of single entities are joined to the texts
    that hold them: by broadcast if ``TEXT_ROWS`` or fewer texts have any, else texts are
    shuffled.
    """
    docs = docs.drop(*counts)
    found = contexts(docs, id_col, text_col)
    every = materialize(disclosure(docs, id_col, text_col, found).where(F.col("part") >= GENERALISE), "pii-terms")
    terms = every.where("value IS NULL").groupBy("class", "term").agg(F.max("part").alias("part"))
    n_terms = terms.count()
    holding = found.where("term IS NULL AND value IS NOT NULL").select("class", "value", "text")
    own = holding.join(every.where("value IS NOT NULL"), ["class", "value"]).select("text", "term", "part")
    chosen: dict[str, dict[str, bool]] = {}
    if n_terms <= TERMS_AT_ONCE:
        for r in terms.collect():
            chosen.setdefault(r["class"], {})[r["term"]] = r["part"] >= REMOVE
    else:
        words = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text")).mapInArrow(tidy(_holding_words), "class string, term string, text bigint")
        own = own.union(words.join(terms, ["class", "term"]).select("text", "term", "part"))
    own = own.groupBy("text", "term").agg((F.max("part") >= REMOVE).alias("gone")).groupBy(F.col("text").alias("__pii_key")).agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("__pii_own"))
    own = materialize(own, "pii-own")
    out = docs.withColumn(text_col, F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")))
    out = out.withColumn("__pii_key", F.xxhash64(F.col(f"`{text_col}`"))).join(F.broadcast(own) if own.count() <= TEXT_ROWS else own, "__pii_key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__pii_own")
    return _apply(out, docs.columns, text_col, length_col, chosen, counts)


def _apply(docs: DataFrame, names: list[str], text_col: str, length_col: str | None, chosen: dict[str, dict[str, bool]], counts: tuple[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    at = names.index(text_col)
    long_at = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            found = np.zeros((2, n), np.int32)
            column = batch.column(at)
            hits = np.flatnonzero(_hits(column))
            columns = list(batch.columns[: len(names)])
            if len(hits):
                take = np.arange(n)
                texts = []
                for j, i in enumerate(hits.tolist()):
                    text, found[0, i], found[1, i] = _rewrite(column[i].as_py(), shared.value, dict(batch.column(len(names))[i].as_py() or []))
                    texts.append(text)
                    take[i] = n + j
                columns[at] = pa.concat_arrays([column, pa.array(texts, column.type)]).take(pa.array(take))
                if long_at is not None:
                    changed = found.sum(axis=0) > 0
                    columns[long_at] = pc.if_else(pa.array(changed), pc.utf8_length(columns[at]).cast(columns[long_at].type), columns[long_at])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[0]), pa.array(found[1])], [f"c{k}" for k in range(len(names) + 2)])

    inner = numbered(docs)
    n = len(names)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields[:n])
    return inner.mapInArrow(tidy(run), f"{fields}, c{n} int, c{n + 1} int").toDF(*names, *counts)


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
