import base64
import itertools
import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from codestrata.llm import _kernels as K
from codestrata.llm import bpe, jaccard, licenses, mixing, pii, registry, sharding, toxicity, transport, vptree, wrappers
from codestrata.llm._components import components
from codestrata.llm.license_texts import TEMPLATES

from ..parity import rows_of_query, rows_of_sql

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, tokens string, slice string"


def docs(spark, texts, source="s"):
    """Documents with columns whose names clash with those used inside operators."""
    rows = [(i, t, "en", source, None if t is None else len(t), "x", "y", "z", "w") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, "   \n"), (None, "a b c d"), (5, "same text here now"), (5, "same text here now"), (6, "same text here now"), (7, "x" * 50_000), (8, "word " * 20_000), (9, "\U0001f600 é!?")]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, small, name):
    assert rows_of_query(registry.QUERIES[name](spark, small)) == rows_of_sql(registry.ORACLES[name], small)


# -- 1


@pytest.fixture(scope="module")
def encoding():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_that_of_the_vocabulary(encoding):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab'sltrevdm  \n\t é1 2.,!\U0001f600日") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["don't I'll've 's\n's ''ll", "a" * 2000, None, "", " ", "\n \n", "x'"]
    ids, bounds, ok = bpe.Bpe.load(bpe.VOCABULARY).encode(pa.array(texts))
    assert ok.all()
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoding.encode_ordinary(t or ""), t


def test_bpe_frames(spark, encoding):
    got = bpe.encode(docs(spark, ODD))
    rows = got.collect()
    assert len(rows) == len(ODD) and got.columns == ["doc_id", "n_tokens", "tokens", "round_trip"]
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert r["doc_id"] == i and (r["tokens"] == (None if t is None else encoding.encode_ordinary(t))) and r["round_trip"] == (None if t is None else True)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(got).collect()}
    assert back[1] is None and back[2] == "" and back[9] == ODD[-1][1]
    assert bpe.encode(docs(spark, [])).count() == 0


# -- 2


def brute_neighbors(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return {(int(ids[i]), int(j)) for i in range(len(ids)) for j in [ids[j] for j in sorted(range(len(ids)), key=lambda j: (round(d[i, j], 9), ids[j])) if j != i][:k]}


def test_neighbors_exact_and_recall(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 150)
    monkeypatch.setattr(vptree, "QUERY_ROWS", 100)
    monkeypatch.setattr(vptree, "LEAF", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12)) + 4 * rng.integers(0, 3, (400, 1))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = brute_neighbors(x, np.arange(400), 5)
    exact = {(r["vec_id"], r["neighbor_id"]) for r in vptree.neighbors(frame, k=5, factor=1.0).collect()}
    assert exact == want
    near = {(r["vec_id"], r["neighbor_id"]) for r in vptree.neighbors(frame, k=5).collect()}
    assert len(near & want) >= 0.9 * len(want)


@pytest.mark.parametrize("dim,rank", [(4, 4), (8, 8), (16, 16), (64, 6), (64, 16)])
def test_neighbors_recall_on_few_dimensions(spark, monkeypatch, dim, rank):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 2500)
    rng = np.random.default_rng(dim + rank)
    x = rng.normal(size=(5000, rank))
    if rank < dim:
        x = x @ rng.normal(size=(rank, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}).to_pandas())
    near = {(r["vec_id"], r["neighbor_id"]) for r in vptree.neighbors(frame).where("vec_id < 300").collect()}
    d = vptree.distances(x[:300], x)
    d[np.arange(300), np.arange(300)] = np.inf
    want = {(i, int(j)) for i, row in enumerate(np.argsort(d, axis=1)[:, :10]) for j in row}
    assert len(near & want) >= 0.9 * len(want)


def test_neighbors_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = {(r["vec_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in vptree.neighbors(frame).collect()}
    assert got == {(1, 1, 2, 0.0), (1, 2, 3, 5.0), (2, 1, 1, 0.0), (2, 2, 3, 5.0), (3, 1, 1, 5.0), (3, 2, 2, 5.0)}
    assert vptree.neighbors(frame.limit(0)).count() == 0


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
    frame = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    rows = vptree.neighbors(frame, k=3, factor=1.0).collect()
    assert len(rows) == 900 and all(r["distance"] == 0 for r in rows)


# -- 3


def brute_mix(rows, targets, total):
    """rows: (id, source, key, tokens)."""
    out = []
    shares = {s: w for s, w in targets.items() if any(r[1] == s for r in rows)}
    for s in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        have = sum(r[3] for r in mine)
        budget = int(total * shares.get(s, 0) / sum(shares.values())) if sum(shares.values()) else 0
        epochs, rest = divmod(budget, have) if have else (int(budget > 0), 0)
        run = 0
        for r in mine:
            run += r[3]
            out += [(r[0], s, e + 1) for e in range(epochs + (rest > 0 and run <= rest))]
    return sorted(out)


def test_mixing_is_the_brute_force_mix(spark):
    rng = random.Random(5)
    texts = [(i, "w" * rng.randint(1, 900)) for i in range(300)]
    frame = docs(spark, texts).withColumn("source", F.concat(F.lit("s"), F.expr("cast(doc_id % 4 as string)")))
    targets = {"s0": 3.0, "s1": 1.0, "s2": 0.2}
    keyed = frame.select("doc_id", "source", mixing.sample_key(F.col("doc_id"), mixing.quality_of(F.col("text")), mixing.SEED).alias("k"), mixing.tokens_of(F.col("text")).alias("t")).collect()
    got = sorted((r["doc_id"], r["source"], r["epoch"]) for r in mixing.sampled(frame, targets=targets, total=40_000).collect())
    assert got == brute_mix([tuple(r) for r in keyed], targets, 40_000)
    assert mixing.mix(frame, targets=targets, total=40_000).columns == [*frame.columns, "__epoch"]
    assert mixing.mix(frame, targets={}, total=40_000).count() == 0


def test_mixing_odd_rows(spark):
    frame = docs(spark, ODD).withColumn("source", F.when(F.col("doc_id") < 6, F.lit(None).cast("string")).otherwise("s"))
    rows = mixing.mix(frame, total=10**7, targets={"s": 1.0, mixing.NO_SOURCE: 1.0}).collect()
    ids = [r["doc_id"] for r in rows]
    assert {1, 2, 3, 5, 6, 7, 8, 9, None} == set(ids) and ids.count(5) == 2 * ids.count(2)
    assert mixing.mix(docs(spark, [])).count() == 0


# -- 4

PAGE = "<html><head><script>x<y</script></head><body><div class='nav'>Home</div>{ad}<h1>{title}</h1>{items}<p>{body}</p></body></html>"


def page(title, items, body, ad=""):
    return PAGE.format(title=title, items="".join(f"<li>{x}</li>" for x in items), body=body, ad=ad)


def test_wrappers(spark):
    rows = [(1, "http://h.com/1", page("A", ["x", "y"], "b &amp; c")), (2, "https://u@H.com:80/2", page("B", ["z"], "d", "<aside>ad</aside>")), (3, "http://h.com/3", page("C", ["p", "q", "r"], "e")), (4, "http://other/1", "<p>only"), (5, "http://h.com/5", None), (6, None, ""), (3, "http://h.com/3", page("C", ["p", "q", "r"], "e")), (None, "http://bad/9", "< broken <p <<>>")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = wrappers.extract(frame).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert [f["text"] for f in by[1]["fields"]][:1] == ["A"] and by[1]["content"].split("\n")[-1] == "b & c"
    assert {"x", "y"} <= set(by[1]["content"].split("\n"))
    assert by[5]["fields"] is None and by[6]["fields"] == [] and by[4]["content"] == "only"
    slots = {r["page_id"]: {f["text"]: f["slot"] for f in r["fields"] or []} for r in got}
    assert slots[1]["A"] == slots[2]["B"] == slots[3]["C"] >= 0
    patterns = {r["host"]: r["pattern"] for r in wrappers.infer(frame).collect()}
    assert "|" not in patterns["h.com"] and ")?" in patterns["h.com"]
    assert wrappers.extract(frame.limit(0)).count() == 0


def test_wrappers_constant_text(spark):
    rows = [(i, "http://h/x", f"<div>Menu</div><p>body {i}</p>") for i in range(5)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["content"] for r in got} == {f"body {i}" for i in range(5)}


def test_fold_repeats():
    assert wrappers.shape(wrappers.fold_repeats("ul li # /li li # /li li # /li /ul".split())) == ["ul", ["*", ["li", "#", "/li"]], "/ul"]
    assert wrappers.shape(wrappers.fold_repeats([])) == []


def test_long_records_are_repeated_groups(spark):
    def record(k):
        return "<div class='card'>" + "".join(f"<p class='c{j}'>v{k}-{j}</p>" for j in range(20)) + "</div>"

    assert len(wrappers.tokens(record(0))) > 60
    rows = [(n, f"http://h/{n}", "<html><h1>x</h1>" + "".join(record(10 * n + k) for k in range(n)) + "</html>") for n in (2, 3)]
    keys = {n: wrappers.shape(wrappers.fold_repeats([k for k, _ in wrappers.tokens(html)])) for n, _, html in rows}
    assert keys[2] == keys[3] and keys[2][-2][0] == "*"
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    slots = {}
    for r in got:
        for f in r["fields"]:
            if f["text"].startswith("v"):
                slots.setdefault(f["text"].split("-")[1], set()).add(f["slot"])
    assert len(slots) == 20 and all(len(s) == 1 and min(s) >= 0 for s in slots.values())


# -- 5


def toxic_corpus(rng, n):
    plain = [f"w{i}" for i in range(300)]
    bad = [f"bad{i}" for i in range(8)]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    rows = toxic_corpus(rng, 1500)
    frame = docs(spark, [(i, t) for i, t, _ in rows] + [(None, "bad1 bad2 bad3"), (2000, None), (2001, ""), (2002, "bad1 " * 30_000)])
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows if i % 2] + [(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(frame, labels).collect()
    assert len(got) == 1504
    flag = {r["doc_id"]: r["toxic"] for r in got}
    held = [(flag[i], bool(x)) for i, _, x in rows if not i % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not flag[2000] and not flag[2001] and flag[None] and flag[2002]
    kept = toxicity.drop_toxic(frame, labels)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, f in flag.items() if not f}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert not any(r["toxic"] for r in toxicity.score(docs(spark, ODD), none).collect())
    assert toxicity.score(docs(spark, []), none).count() == 0


def test_binomial_tail():
    assert toxicity.binomial_tail(np.array([3, 3]), np.array([0, 3]), 0.5).tolist() == pytest.approx([1.0, 0.125])


# -- 6


def test_pii_forms():
    cases = {"a b.c+d@x-y.example.com.": "a <EMAIL>.", "ip 10.0.0.255, v 1.2.3": "ip <IP>, v 1.2.3", "+1 (017) 555-7713 x": "<PHONE> x", "1234-5678-9012-3456": "<CARD>", 'token = "0123456789abcdef"': 'token = "<SECRET>"', "123-45-6789": "<SSN>", "DE89 3704 0044 0532 0130 00": "<IBAN>", "Version 2.0. in 1999-2000": "Version 2.0. in 1999-2000", "@ at @@ x@y": "@ at @@ x@y"}
    for text, want in cases.items():
        assert pii._rewrite(text, {})[0] == want


def test_pii_terms_and_odd_rows(spark):
    near = [(100 + i, f"alpha beta contactline person{i}@mail.example.com gamma delta") for i in range(12)]
    clean = [(200 + i, "alpha beta gamma delta words only") for i in range(60)]
    frame = docs(spark, ODD + near + clean)
    out = pii.sanitise(frame, length_col="n_chars")
    assert out.columns == [*frame.columns, "pii_entities", "pii_terms"]
    rows = out.collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD + near + clean)
    assert got[100]["text"] == "alpha beta <EMAIL> gamma delta" and got[100]["n_chars"] == len(got[100]["text"])
    assert all(got[i]["text"] == t and got[i]["pii_terms"] == 0 for i, t in clean + [x for x in ODD if x[0] not in (None,)])
    assert got[1]["text"] is None and got[1]["pii_entities"] == 0
    assert pii.sanitise(docs(spark, [])).count() == 0


def test_pii_terms_of_one_entity(spark):
    own = [(i, f"note {i} from Zebulon at one@mail.example.com about w{i} things") for i in range(4)]
    copies = [(10 + i, "letter by Quentin at two@mail.example.com about things") for i in range(3)]
    other = [(20 + i, f"note {i} from someone at p{i}@mail.example.com about things") for i in range(3)]
    clean = [(100 + i, f"note {i} from someone at home about w{i} things by letter") for i in range(40)]
    for limit in (pii.TEXT_ROWS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(pii, "TEXT_ROWS", limit)
            got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, own + copies + other + clean)).collect()}
        assert all("Zebulon" not in got[i] and "note" in got[i] and "<EMAIL>" in got[i] for i, _ in own)
        assert all("Quentin" in got[i] for i, _ in copies)
        assert all(got[i] == t for i, t in clean) and all("someone" in got[i] for i, _ in other)


# -- 7


def test_transport_round_trip(spark):
    rng = random.Random(2)
    texts = [(0, "é" * 4000), (3, "".join(rng.choice("abc \n") for _ in range(20_000))), (5, "z" * 9000), (17, None), (18, ""), (None, "q" * 100)]
    rows = transport.parse(transport.muxed(docs(spark, texts))).collect()
    by = {i: sorted((r for r in rows if r["media_id"] == i), key=lambda r: r["pts"]) for i, _ in texts}
    assert b"".join(r["payload"] for r in by[0]).decode() == texts[0][1] and all(r["complete"] for r in by[0])
    assert sum(r["lost"] for r in by[3]) == 1 and sum(not r["complete"] for r in by[3]) == 1
    assert sum(r["repeated"] for r in by[5]) == 1 and b"".join(r["payload"] for r in by[5]).decode() == texts[2][1]
    assert not by[17] and not by[18] and len(by[None]) == 1
    assert [r["pts"] for r in by[0]] == [126_000 + 3_600 * u for u in range(len(by[0]))]
    assert [r["random_access"] for r in by[0]] == [u % 8 == 0 for u in range(len(by[0]))]
    assert {(r["pid"], r["stream_type"]) for r in by[0]} == {(0x100, 0x1B), (0x101, 0x0F)}


def test_transport_bad_streams():
    whole = transport.mux(0, b"x" * 5000)
    units = lambda raw: transport.units(np.frombuffer(raw, np.uint8))
    assert units(b"") == [] and units(b"junk" * 500) == [] and units(whole[188:376]) == []
    assert b"".join(u[-1] for u in sorted(units(b"ab" + whole[: 188 * 10] + b"cde" + whole[188 * 10 :] + b"f"), key=lambda u: u[5])) == b"x" * 5000


# -- 8


def brute_pairs(texts, n, threshold):
    import re

    sets = {}
    for i, t in texts:
        if i is None or t is None:
            continue
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())
        g = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else {t.lower().strip()} if t.strip() else set()
        sets[i] = g
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def near_corpus(rng):
    vocab = [f"v{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 80))] for _ in range(40)]
    out = []
    for i in range(200):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("n,threshold", [(3, 0.5), (1, 0.7), (2, 0.9)])
def test_jaccard_is_brute_force(spark, monkeypatch, n, threshold):
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 4000)
    monkeypatch.setattr(jaccard, "BIN_PAIRS", 50)
    texts = near_corpus(random.Random(n)) + [(i or None, t) if i is None else (1000 + i, t) for i, t in ODD]
    frame = docs(spark, texts).repartition(3)
    got = {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in jaccard.join(frame, n=n, threshold=threshold).collect()}
    assert got == brute_pairs(texts, n, threshold)


def test_cells_split_by_hash(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_PAIRS", 20)
    texts = near_corpus(random.Random(9))
    got = {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == brute_pairs(texts, 3, 0.5)


def test_one_of_each_group_stays(spark):
    texts = near_corpus(random.Random(4)) + [(1001, None), (1002, ""), (None, "v1 v2 v3 v4"), (1003, "unique words stand here"), (1003, "unique words stand here")]
    frame = docs(spark, texts)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(texts, 3, 0.5):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted({find(i) for i, _ in texts if i is not None})
    kept = jaccard.keep_one_of_each_group(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 1
    assert jaccard.join(docs(spark, [])).count() == 0 and jaccard.keep_one_of_each_group(docs(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14] + [(5, 5), (3, 1)], "x bigint, y bigint")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {i: 0 if i < 15 else 15 for i in range(31)}


def test_words_kernel():
    w = K.Words(pa.array(["Éa b", None, "", "c-d", "x"]))
    assert [w.text(i) for i in range(len(w.hash))] == ["éa", "b", "c", "d", "x"] and w.first.tolist() == [0, 2, 2, 2, 4, 5]
    assert K.Words(pa.array(["zz éa"])).hash[1] == w.hash[0]


# -- 9


def test_weights_move_keys_within_their_subtree(spark):
    frame = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("region", F.lit("clash"))
    before = {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in sharding.assign(frame).collect()}
    east = sharding.TOPOLOGY["east"]
    changed = dict(sharding.TOPOLOGY) | {"east": (east[0], dict(east[1]) | {"r1": (4.0, east[1]["r1"][1])})}
    after = {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in sharding.assign(frame, topology=changed).collect()}
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(before[k][0] == after[k][0] == "east" and before[k][1] == "r2" and after[k][1] == "r1" for k in moved)
    share = sum(v[0] == "east" for v in before.values()) / len(before)
    assert abs(share - 0.5) < 0.03
    odd = sharding.assign(spark.createDataFrame([(None,), (1,), (1,)], "doc_id bigint")).collect()
    assert len(odd) == 3 and all(r["shard"] for r in odd)
    assert sharding.assign(frame, topology={"a": (1.0, {})}).first()["rack"] is None
    assert sharding.assign(frame.limit(0)).count() == 0


# -- 10


def test_every_license_is_found(spark):
    texts = [(i, f"intro words\nCopyright 2020 Someone\n{t}\nclosing words here") for i, (_, t) in enumerate(sorted(TEMPLATES.items()))]
    got = licenses.scan(docs(spark, texts + ODD)).collect()
    names = sorted(TEMPLATES)
    assert {i for i, _ in texts} == {r["doc_id"] for r in got}
    assert all(any(r["license"] == names[i] and r["exact"] for r in got if r["doc_id"] == i) for i in range(len(names)))


@pytest.mark.parametrize("width", [60, 72, 80])
@pytest.mark.parametrize("mark", ["", " * "])
def test_wrapped_licenses_are_found(width, mark):
    scanner = licenses.Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        lines = textwrap.wrap(" ".join(text.split()), width, break_on_hyphens=False, break_long_words=False)
        whole = "\n".join(mark + x for x in ["some words first", "", *lines, "", "int main() { return 0; }"])
        got = scanner.confirm(*licenses.blocks_of(whole))
        assert any(r[1] == name and r[4] == 0 for r in got), name


def test_second_notice_in_a_block():
    text = TEMPLATES["mit"]
    both = text + "\n\nsome other part\n\n" + text.replace("free of charge", "without charge")
    got = licenses.Scanner(TEMPLATES).confirm(*licenses.blocks_of(both))
    assert [(r[0], r[1], r[4]) for r in got] == [(0, "mit", 0), (0, "mit", 2)]


def test_license_differences(spark):
    text = TEMPLATES["mit"].replace("free of charge", "without charge")
    row = licenses.scan(docs(spark, [(1, text), (1, text), (2, "a licence to krill")])).collect()
    assert len(row) == 2 and row[0]["license"] == "mit" and row[0]["word_edits"] == 2 and "without" in row[0]["differences"]
    assert licenses.scan(docs(spark, [])).count() == 0


# -- pipeline


def test_pipeline(spark, small, encoding):
    import corpus_pipeline
    from codestrata.plans.shared import materialize

    frame = spark.read.parquet(f"{small}/documents.parquet")
    seen = [frame]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], small), name))
    flagged = {r["doc_id"] for r in toxicity.score(frame, spark.read.parquet(f"{small}/labels.parquet")).where("toxic").collect()}
    ids = [[r["doc_id"] for r in s.select("doc_id").collect()] for s in seen]
    assert sorted(ids[1]) == sorted(set(ids[0]) - flagged)
    left = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    pairs = brute_pairs(sorted(left.items()), 3, 0.5)
    gone = set(ids[1]) - set(ids[2])
    assert gone == {b for b in left if any(b in p for p in pairs)} - set(ids[2]) and not any(a in ids[2] and b in ids[2] for a, b in pairs)
    assert sorted(ids[2]) == sorted(ids[3]) and set(ids[4]) <= set(ids[3])
    text = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    final = seen[5].collect()
    assert len(final) == len(ids[4]) and all(r["tokens"] == encoding.encode_ordinary(text[r["doc_id"]]) and r["round_trip"] for r in final)
    assert all(s.columns == frame.columns for s in seen[:5])
