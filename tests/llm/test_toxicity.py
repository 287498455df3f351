import math
import random

import numpy as np
import pyarrow as pa
import pytest

from codestrata.llm import _kernels as K
from codestrata.llm import toxicity
from codestrata.llm._frames import id_text

from .test_operators import docs, toxic_corpus


def hash_of(word):
    return int(K.Words(pa.array([word])).hash[0])


def brute_polarity(texts, nodes, toxic, clean):
    """{node: polarity} with plain counts and dense matrices."""
    nodes = sorted(nodes, key=hash_of)
    at = {w: i for i, w in enumerate(nodes)}
    size = len(nodes)
    pairs = np.zeros((size, size))
    totals = np.zeros(size)
    for t in texts:
        seq = [at[w] for w in t.split() if w in at]
        for i in seq:
            totals[i] += 1
        for step in range(1, toxicity.REACH + 1):
            for x, y in zip(seq, seq[step:]):
                pairs[min(x, y), max(x, y)] += 1
    weight = np.zeros((size, size))
    for a in range(size):
        for b in range(a + 1, size):
            n = pairs[a, b]
            if n >= toxicity.MIN_PAIRS:
                pmi = math.log(n * (max(1, totals.sum()) / toxicity.REACH) / (2 * max(1, totals[a]) * max(1, totals[b])))
                weight[a, b] = weight[b, a] = max(0.0, pmi) * n / (n + 1)
    degree = weight.sum(axis=1)
    rates = []
    for seeds in (toxic, clean):
        start = np.zeros(size)
        for w, mass in seeds.items():
            if w in at:
                start[at[w]] = mass / sum(m for x, m in seeds.items() if x in at)
        now = start.copy()
        for _ in range(toxicity.STEPS):
            move = weight @ np.where(degree > 0, now / np.maximum(degree, 1e-300), 0)
            now = toxicity.RESTART * start + (1 - toxicity.RESTART) * (move + (now * (degree <= 0)).sum() * start)
        rates.append(now)
    floor = 0.01 / size
    ratio = np.log((rates[0] + floor) / (rates[1] + floor))
    out = {}
    for w, i in at.items():
        near = [(weight[i, at[c]], ratio[at[c]]) for c in clean if c in at]
        total = sum(x for x, _ in near)
        out[w] = 0.0 if max(rates[0][i], rates[1][i]) <= floor or total <= 0 else ratio[i] - sum(x * r for x, r in near) / total
    return out


@pytest.mark.parametrize("seed,slices", [(1, 1), (2, 5), (3, 40)])
def test_graph_and_walk_are_the_brute_force_ones(spark, monkeypatch, seed, slices):
    monkeypatch.setattr(toxicity, "BLOCK_PAIRS", 300)
    monkeypatch.setattr(toxicity, "TOTAL_TERMS", 4)
    monkeypatch.setattr(toxicity, "VECTOR_TERMS", 7)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["bad0", "bad1", "sly"]
    texts = [" ".join(rng.choice(vocabulary[:25]) if rng.random() < 0.8 else rng.choice(vocabulary) + " bad0 sly" for _ in range(rng.randint(0, 40))) for _ in range(60)]
    nodes = [w for w in vocabulary if w != "w7"]
    terms = np.array(sorted(map(hash_of, nodes)), np.uint64)
    toxic, clean = {"bad0": 9, "bad1": 5}, {f"w{i}": 6 + i for i in range(9) if i != 7}

    def ordered(seeds):
        got = sorted((hash_of(w), m) for w, m in seeds.items())
        return np.array([h for h, _ in got], np.uint64), np.array([m for _, m in got])

    picked = id_text(docs(spark, list(enumerate(texts))).repartition(3))
    sent = picked.mapInArrow(toxicity._send_pairs(terms, slices), "slice int, codes binary, counts binary")
    pairs = sent.groupBy("slice").applyInArrow(toxicity._add_pairs(len(terms)), "slice int, a binary, b binary, n binary").cache()
    polarity, deviation = toxicity.walk(pairs, terms, ordered(toxic), ordered(clean))
    want = brute_polarity(texts, nodes, toxic, clean)
    assert {w: polarity[np.searchsorted(terms, np.uint64(hash_of(w)))] for w in nodes} == pytest.approx(want)
    assert deviation == pytest.approx(np.std([want[w] for w in clean]))
    pairs.unpersist()


def test_a_term_of_no_label_beside_toxic_seeds_is_induced(spark):
    """It stands where seeds do, in documents that no label covers; those with it and no seed are toxic."""
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(3000)]
    texts, labels, clean = [], [], []
    for i in range(1600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(2, 6) if toxic else 0):
            at = rng.randrange(len(words))
            words[at:at] = [f"bad{rng.randrange(8)}", "slyword"] if i % 4 == 0 else [f"bad{rng.randrange(8)}"]
        texts.append((i, " ".join(words)))
        if not toxic:
            clean.append(i)
        if i % 4:
            labels.append((i, 1, int(toxic)))
    alone = [(5000 + i, " ".join([*(rng.choice(plain) for _ in range(10)), "slyword", "slyword", "slyword"])) for i in range(5)]
    frame = docs(spark, texts + alone)
    label_frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    terms, _, is_seed = toxicity.lexicon(frame, label_frame)
    at = int(np.searchsorted(terms, np.uint64(hash_of("slyword"))))
    assert terms[at] == hash_of("slyword") and not is_seed[at]
    flags = {r["doc_id"]: r["toxic"] for r in toxicity.score(frame, label_frame).collect()}
    assert all(flags[5000 + i] for i in range(5))
    assert sum(flags[i] for i in clean) <= 0.01 * len(clean)


def test_rare_and_common_terms_ties_and_copies(spark):
    rng = random.Random(6)
    rows = toxic_corpus(rng, 900)
    # a word that is everywhere, and a toxic one that five labelled documents have
    texts = [(i, t + " everyword" + (" rarebad rarebad" if x and i in [r[0] for r in rows if r[2]][:6] else "")) for i, t, x in rows]
    same = [(3000 + k, texts[0][1]) for k in range(30)] + [(4000, "everyword " * 50), (4001, None), (4002, "")]
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: (r["score"], r["toxic"]) for r in toxicity.score(docs(spark, texts + same), labels).collect()}
    assert {got[3000 + k] for k in range(30)} == {got[texts[0][0]]}
    assert not got[4000][1] and not got[4001][1] and not got[4002][1]
