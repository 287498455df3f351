"""Operator 5: toxicity, by lexicon induction.

Terms whose documents are labelled toxic far more often than chance allows are the toxic
seeds; terms seen often enough that are not nearly so are the clean ones. Over all
documents, terms that stand within a window of each other are counted, and positive
pointwise mutual information makes them a word graph. Two random walks with restart, one
from each kind of seed, give every term two visiting rates. The logarithm of their ratio,
less that of the clean seeds around the term, is its polarity: without that, a language
with many toxic seeds would colour all of its terms. The toxic lexicon has the toxic seeds
and the terms of no label that stand out, unless labelled documents that a threshold was
not fitted on are told apart the worse for these. A document scores by the polarity of its
toxic terms, and the threshold is the one that separates the labelled documents best.

Graph terms are those in a share of the documents between ``NODE_SHARE`` and ``STOP_SHARE``:
less frequent ones tell too little of what stands around them, and stop words stand around
everything. There are at most (words of a document / ``NODE_SHARE``) of them, so neither the
vectors of the walk nor what is broadcast grows with the corpus. Pairs are counted in slices
of their own, which stream through a task, and totals in ranges of terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, slices
from . import _kernels as K
from ._frames import batched, id_text, numbered, release, table, tidy
from ._vocab import distinct_words, sum_by_key, term_df

LABEL_SAMPLE = 20_000
"""Labelled documents that seeds and threshold are fitted on, the first by hash of the id."""
SEED_CHANCE = 0.05
"""Chance that any seed of a sample is one by accident (Bonferroni over the terms tested)."""
SEED_ODDS = 20.0
"""The odds that a toxic seed's document is toxic are this many times those of documents in general."""
CLEAN_SEED_DOCS = 5
"""Labelled documents a clean seed is in, at least; their odds are under the toxic seeds'."""
NODE_DOCS = 10
NODE_SHARE = 0.0002
STOP_SHARE = 0.05
"""Graph terms occur in a share of the documents between these, and in ``NODE_DOCS`` at least; seeds always belong."""
REACH = 2
"""Graph terms on each side of a graph term, in the sequence of graph terms of a text, that count as near."""
BLOCK_PAIRS = 3_000_000
"""Pairs a task gathers before it counts and sends them."""
PAIR_BYTES = 16 << 20
"""Text bytes that make a slice of pairs ..."""
PAIR_SLICES = 16_384
"""... up to so many slices: their pairs are bounded by the graph's, and they are streamed."""
TOTAL_TERMS = 1024
"""Graph terms whose totals are added up together."""
VECTOR_TERMS = 65_536
"""Entries of a vector that are added up together."""
MIN_PAIRS = 3
"""Pairs met less often are no edges."""
RESTART = 0.3
STEPS = 8
MARGIN = math.log(2)
"""Polarity from which a term without a label belongs to the toxic lexicon, ..."""
SPREAD = 5.0
"""... and at least this many standard deviations of the clean seeds' polarity."""
SCHEMA = "doc_id bigint, score double, n_toxic_terms int, toxic boolean"


# -- labels and seeds


def labelled(docs: DataFrame, labels: DataFrame, sample: int = LABEL_SAMPLE) -> DataFrame:
    """(id, text, toxic, fold) of at most ``sample`` labelled documents, copies once; conflicting labels count as toxic."""
    clean = labels.select(F.col("doc_id").cast("bigint").alias("lid"), F.col("toxic").cast("int").alias("toxic")).where("lid IS NOT NULL AND toxic IS NOT NULL")
    chosen = clean.groupBy("lid").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("lid"), "lid").limit(sample)
    # bounded by ``sample`` rows of two numbers
    rows = docs.where("text IS NOT NULL").join(F.broadcast(materialize(chosen, "toxicity-labels")), F.col("id") == F.col("lid"))
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    return rows.groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")).select("id", "text", "toxic", fold.alias("fold"))


def _label_counts(batch: pa.RecordBatch):
    toxic = batch.column(2).to_numpy(zero_copy_only=False)
    for a, b in K.chunks(batch.column(1)):
        words = K.Words(batch.column(1).slice(a, b - a))
        h, owner = distinct_words(words)
        h, n, t = sum_by_key(h, np.ones(len(h), np.int64), toxic[a:b][owner].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(t)], ["term", "n", "t"])


def binomial_tail(n: np.ndarray, k: np.ndarray, p: float) -> np.ndarray:
    """P(X >= k) of binomial counts, from the exact sum of its terms."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    out = np.zeros(len(n))
    for i, (m, j) in enumerate(zip(n.tolist(), k.tolist(), strict=True)):
        x = np.arange(j, m + 1)
        logs = math.lgamma(m + 1) - lgamma(x + 1.0) - lgamma(m - x + 1.0) + x * math.log(p) + (m - x) * math.log1p(-p)
        out[i] = min(1.0, float(np.exp(logs).sum()))
    return out


def seeds(sample: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Toxic and clean seeds, each as (hashes in order, labelled documents that make it one)."""
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not 0 < t < n:
        return none, none
    p = t / n
    counts = materialize(sample.mapInArrow(batched(_label_counts), "term bigint, n bigint, t bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("n >= 5"), "toxicity-terms")
    tested = counts.count()
    odds = SEED_ODDS * p / (1 - p)
    lifted = F.col("t") >= F.lit(odds / (1 + odds)) * F.col("n")
    likely = counts.where((F.col("t") >= 5) & lifted).orderBy("term").toArrow()
    found = binomial_tail(likely.column("n").to_numpy(), likely.column("t").to_numpy(), p) <= SEED_CHANCE / max(1, tested)
    plain = counts.where((F.col("n") >= CLEAN_SEED_DOCS) & ~lifted).orderBy("term").toArrow()
    return _ordered(likely.column("term").to_numpy()[found], likely.column("t").to_numpy()[found]), _ordered(plain.column("term").to_numpy(), plain.column("n").to_numpy())


def _ordered(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = terms.view(np.uint64)
    order = np.argsort(terms)
    return terms[order], counts[order]


# -- the graph


def graph_terms(picked: DataFrame, toxic: np.ndarray) -> np.ndarray:
    """Hashes of the graph's terms, in order."""
    df = materialize(term_df(picked), "toxicity-df")
    n_docs = max(1, picked.where("text IS NOT NULL").count())
    middle = df.where((F.col("df") >= max(NODE_DOCS, math.ceil(NODE_SHARE * n_docs))) & (F.col("df") <= STOP_SHARE * n_docs)).select("term").toArrow()
    return np.unique(np.concatenate((middle.column("term").to_numpy().view(np.uint64), toxic)))


def _send_pairs(terms: np.ndarray, slices_: int):
    def run(batches):
        size = np.uint64(len(terms))
        held: list[np.ndarray] = []
        totals = np.zeros(len(terms), np.int64)
        waiting = 0

        def packed(where: np.ndarray, code: np.ndarray, count: np.ndarray):
            """Rows (slice, codes, counts); all arrays are in the order of ``code``, in which ``where`` rises too."""
            used, first = np.unique(where, return_index=True)
            cuts = np.append(first, len(where)).tolist()
            for low in range(0, len(used), 512):
                rows: list[list] = [[], [], []]
                for k in range(low, min(low + 512, len(used))):
                    a, b = cuts[k], cuts[k + 1]
                    rows[0].append(int(used[k]))
                    rows[1].append(_pack(np.diff(code[a:b], prepend=np.uint64(0))))
                    rows[2].append(_pack(count[a:b].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["slice", "codes", "counts"])

        def flush():
            code, count = np.unique(np.concatenate(held), return_counts=True)
            return packed((code // size * np.uint64(slices_) // size).astype(np.int64), code, count)

        for batch in batches:
            for a, b in K.chunks(batch.column(1)):
                words = K.Words(batch.column(1).slice(a, b - a))
                at = np.searchsorted(terms, words.hash)
                node = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == words.hash)
                ids = at[node].astype(np.uint64)
                text = np.searchsorted(words.first, node, side="right")
                totals += np.bincount(at[node], minlength=len(terms))
                for step in range(1, REACH + 1):
                    same = text[:-step] == text[step:] if len(ids) > step else np.zeros(0, bool)
                    x, y = ids[:-step][same], ids[step:][same]
                    low, high = np.minimum(x, y), np.maximum(x, y)
                    # which of the two leads depends on both, so that slices are of one size
                    even = (low + high) % np.uint64(2) == 0
                    held.append(np.where(even, low, high) * size + np.where(even, high, low))
                    waiting += len(x)
                if waiting > BLOCK_PAIRS:
                    yield from flush()
                    held, waiting = [], 0
        if waiting:
            yield from flush()
        there = np.flatnonzero(totals)
        # totals of a range of terms go to a slice under 0
        yield from _below(packed(there // TOTAL_TERMS, there.astype(np.uint64), totals[there]))

    return run


def _below(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pc.subtract(pa.scalar(-1, pa.int32()), batch.column(0)), *batch.columns[1:]], batch.schema.names)


def _pack(x: np.ndarray) -> bytes:
    top = int(x.max())
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    # the first gap is large; it alone must not widen the rest
    rest = int(x[1:].max()) if len(x) > 1 else 0
    width = next(w for w in (1, 2, 4, 8) if rest < 1 << (8 * w))
    return bytes([width]) + int(x[0]).to_bytes(8, "little") + x[1:].astype(f"<u{width}").tobytes()


def _unpack(raw) -> np.ndarray:
    view = memoryview(raw)
    return np.concatenate((np.frombuffer(view, "<u8", 1, 1), np.frombuffer(view, f"<u{view[0]}", offset=9).astype(np.uint64)))


def _add_pairs(n_terms: int):
    schema = pa.schema([("slice", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        code, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts: list = []
        waiting = 0
        for batch in batches:
            s = batch.column(0)[0].as_py()
            for c, k in zip(batch.column(1), batch.column(2), strict=True):
                parts.append((np.cumsum(_unpack(c.as_buffer())), _unpack(k.as_buffer()).astype(np.int64)))
                waiting += len(parts[-1][0])
                if waiting > max(1_000_000, len(code)):
                    code, count = sum_by_key(np.concatenate([code, *(x for x, _ in parts)]), np.concatenate([count, *(x for _, x in parts)]))
                    parts, waiting = [], 0
        code, count = sum_by_key(np.concatenate([code, *(x for x, _ in parts)]), np.concatenate([count, *(x for _, x in parts)]))
        if s < 0:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([code.astype("<u8").tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([count.astype("<i8").tobytes()], pa.binary())], schema=schema)
        else:
            code, count = code[count >= MIN_PAIRS], count[count >= MIN_PAIRS]
            a, b = (code // np.uint64(n_terms)).astype("<u4"), (code % np.uint64(n_terms)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([np.minimum(count, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], schema=schema)
        release()

    return run


def _edges(rows, totals: np.ndarray):
    """(a, b, weight) of the edges of an Arrow batch of slices."""
    whole = max(1, int(totals.sum()))
    for i in range(rows.num_rows):
        a, b, n = (np.frombuffer(rows.column(k)[i].as_buffer(), "<u4").astype(np.int64) for k in (1, 2, 3))
        # a term has 2 * REACH places around each of its occurrences; a pair is met from either end
        weight = np.log(n * (whole / REACH) / (2.0 * totals[a] * totals[b]))
        weight[a == b] = 0
        hold = weight > 0
        yield a[hold], b[hold], weight[hold] * (n[hold] / (n[hold] + 1.0))


def walk(pairs: DataFrame, terms: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], clean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(polarity, standard deviation of the clean seeds' polarity) of the graph's terms."""
    spark = pairs.sparkSession
    size = len(terms)
    totals = np.ones(size, np.int64)
    for r in pairs.where("slice < 0").select("a", "n").collect():
        totals[np.frombuffer(bytes(r["a"]), "<u8").astype(np.int64)] = np.frombuffer(bytes(r["n"]), "<i8")
    edges = pairs.where("slice >= 0")
    starts = np.zeros((2, size))
    for k, (seed, mass) in enumerate((toxic, clean)):
        _, mine, theirs = np.intersect1d(terms, seed, assume_unique=True, return_indices=True)
        starts[k, mine] = mass[theirs] / max(1, mass[theirs].sum())
    neutral = starts[1] > 0

    def spread(vectors: np.ndarray) -> np.ndarray:
        """Sum over edges of weight x the vector at the other end, for each row of ``vectors``."""
        sent = spark.sparkContext.broadcast((vectors, totals))

        def run(batches):
            v, tot = sent.value
            out = np.zeros(v.shape)
            for batch in batches:
                for a, b, w in _edges(batch, tot):
                    for k in range(len(v)):
                        out[k] += np.bincount(b, w * v[k][a], size) + np.bincount(a, w * v[k][b], size)
            for at in range(0, size, VECTOR_TERMS):
                yield pa.RecordBatch.from_arrays([pa.array([at // VECTOR_TERMS], pa.int32()), pa.array([out[:, at : at + VECTOR_TERMS].tobytes()], pa.binary())], ["block", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, total = 0, None
            for batch in batches:
                block = batch.column(0)[0].as_py()
                for p in batch.column(1):
                    x = np.frombuffer(p.as_buffer())
                    total = x.copy() if total is None else total + x
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "part"])

        # the parts of all tasks are added up before the driver gets the sum
        parts = edges.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").collect()
        sent.destroy()
        total = np.zeros(vectors.shape)
        for r in parts:
            x = np.frombuffer(bytes(r["part"])).reshape(len(vectors), -1)
            total[:, r["block"] * VECTOR_TERMS :][:, : x.shape[1]] = x
        return total

    degree = spread(np.ones((1, size)))[0]
    now = starts.copy()
    for _ in range(STEPS):
        flow = spread(np.where(degree > 0, now / np.maximum(degree, 1e-300), 0.0))
        lost = (now * (degree <= 0)).sum(axis=1, keepdims=True)
        now = RESTART * starts + (1 - RESTART) * (flow + lost * starts)
    floor = 0.01 / max(1, size)
    ratio = np.log((now[0] + floor) / (now[1] + floor))
    near = spread(np.stack((ratio * neutral, neutral.astype(float))))
    level = float(ratio[neutral].mean()) if neutral.any() else 0.0
    polarity = ratio - np.where(near[1] > 0, near[0] / np.maximum(near[1], 1e-300), level)
    # what neither walk reaches, or no clean seed is near, tells nothing
    polarity[(now.max(axis=0) <= floor) | (near[1] <= 0)] = 0.0
    return polarity, float(polarity[neutral].std()) if neutral.any() else 0.0


def lexicon(docs: DataFrame, labels: DataFrame, sample: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes in order, polarity, whether a seed) of the toxic terms of a corpus."""
    picked = id_text(docs, id_col, text_col)
    sample = materialize(labelled(picked, labels), "toxicity-sample") if sample is None else sample
    toxic, clean = seeds(sample)
    if not len(toxic[0]):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)
    terms = graph_terms(picked, toxic[0])
    n_slices = min(PAIR_SLICES, slices(docs, text_col, PAIR_BYTES))
    sent = picked.mapInArrow(tidy(_send_pairs(terms, n_slices)), "slice int, codes binary, counts binary")
    pairs = materialize(sent.groupBy("slice").applyInArrow(_add_pairs(len(terms)), "slice int, a binary, b binary, n binary"), "toxicity-pairs")
    polarity, deviation = walk(pairs, terms, toxic, clean)
    is_seed, is_clean = np.isin(terms, toxic[0]), np.isin(terms, clean[0])
    keep = is_seed | (~is_clean & (polarity >= max(MARGIN, SPREAD * deviation)))
    return terms[keep], np.maximum(polarity[keep], MARGIN), is_seed[keep]


# -- scores


def _scores(texts: pa.Array, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, distinct toxic terms) of each text: the weights of its toxic terms, each times one
    and the logarithm of its count, over the logarithm of the text's words."""
    words = K.Words(texts)
    n = len(words.offs) - 1
    if not len(terms):
        return np.zeros(n), np.zeros(n, np.int64)
    at = np.searchsorted(terms, words.hash)
    hit = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == words.hash)
    owner = np.searchsorted(words.first, hit, side="right") - 1
    code, count = np.unique(owner * np.int64(len(terms)) + at[hit], return_counts=True)
    owner, term = code // len(terms), code % len(terms)
    score = np.bincount(owner, weights[term] * (1 + np.log(count)), n) / np.log2(2 + np.diff(words.first))
    return score, np.bincount(owner, minlength=n)


def _cut(score: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
    """The score from which documents are best called toxic, by F1: halfway to the next lower one; ties go to the highest."""
    order = np.argsort(-score)
    score, t, n = score[order], np.cumsum(t[order]), np.cumsum(n[order])
    if not len(score) or not t[-1]:
        return math.inf
    f1 = np.where(score > 0, 2 * t / (n + t[-1]), 0)
    best = int(f1.argmax())
    return float(score[best] + (score[best + 1] if best + 1 < len(score) else 0.0)) / 2 if f1[best] > 0 else math.inf


def threshold(sample: DataFrame, terms: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(score from which labelled documents are best called toxic, held-out F1).

    For the F1 each half of the documents is judged by the threshold of the other half.
    """

    def run(batch: pa.RecordBatch):
        for a, b in K.chunks(batch.column(1)):
            score, _ = _scores(batch.column(1).slice(a, b - a), terms, weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(score, 9)), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)], ["score", "toxic", "fold"])

    rows = sample.select("id", "text", "toxic", "fold").mapInArrow(batched(run), "score double, toxic int, fold int").groupBy("fold", "score").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).toArrow()
    score, t, n, fold = (rows.column(c).to_numpy() for c in ("score", "t", "n", "fold"))
    right = called = 0
    for k in (0, 1):
        cut = _cut(score[fold != k], t[fold != k], n[fold != k])
        right += int(t[(fold == k) & (score >= cut)].sum())
        called += int(n[(fold == k) & (score >= cut)].sum())
    return _cut(*_by_score(score, t, n)), 2 * right / max(1, called + int(t.sum()))


def _by_score(score: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    every, at = np.unique(score, return_inverse=True)
    return every, np.bincount(at, t, len(every)), np.bincount(at, n, len(every))


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """(terms, weights, threshold) fitted on a corpus and its labels."""
    sample = materialize(labelled(id_text(docs, id_col, text_col), labels), "toxicity-sample")
    terms, weights, is_seed = lexicon(docs, labels, sample, id_col, text_col)
    # terms that only the walk found go if held-out labelled documents are told apart the worse for them
    whole, f1 = threshold(sample, terms, weights)
    if is_seed.all():
        return terms, weights, whole
    part, seeds_f1 = threshold(sample, terms[is_seed], weights[is_seed])
    return (terms, weights, whole) if f1 >= seeds_f1 else (terms[is_seed], weights[is_seed], part)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_toxic_terms, toxic), one row for each input row.

    Null and empty texts score 0 and are not toxic; repeated rows score alike; a null id
    stays null. Without labels of both kinds, or without any seed, every score is 0 and
    nothing is toxic. Equal scores fall on one side of the threshold; a term in as many
    documents as a bound of the graph's terms belongs to it. A toxic term in fewer documents
    than the graph's least counts if it is a seed, which takes 5 labelled documents. Other columns, of
    documents and labels, are not read. Statistics are over all documents; only seeds and
    threshold are fitted, on ``LABEL_SAMPLE`` labelled ones at most.
    """
    terms, weights, cut = model(docs, labels, id_col, text_col)

    def run(batch: pa.RecordBatch):
        for a, b in K.chunks(batch.column(1)):
            s, n = _scores(batch.column(1).slice(a, b - a), terms, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array(n.astype(np.int32)), pa.array(s >= cut)], ["doc_id", "score", "n_toxic_terms", "toxic"])

    return id_text(docs, id_col, text_col).mapInArrow(batched(run), SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns and as often as they come, that are not toxic."""
    terms, weights, cut = model(docs, labels, id_col, text_col)
    docs = docs.withColumn(text_col, F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        for a, b in K.chunks(batch.column(at)):
            part = batch.slice(a, b - a)
            s, _ = _scores(part.column(at), terms, weights)
            yield part.filter(pa.array(s < cut))

    inner = numbered(docs)
    return inner.mapInArrow(batched(run), inner.schema).toDF(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
