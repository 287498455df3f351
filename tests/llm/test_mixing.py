import random

from pyspark.sql import functions as F

from codestrata.llm import mixing

from .test_operators import brute_mix, docs

NAMES = ["cut", "room", "epochs", "last", "run", "r", "t", "have", "share", "__epoch"]


def test_columns_of_any_name_are_carried_along(spark):
    rng = random.Random(8)
    texts = [(i, "w" * rng.randint(1, 900)) for i in range(120)]
    frame = docs(spark, texts).withColumn("source", F.concat(F.lit("s"), F.expr("cast(doc_id % 3 as string)")))
    clashing = frame.withColumns({n: F.lit(n) for n in NAMES})
    want = sorted(tuple(r) for r in mixing.sampled(frame, total=9_000).collect())
    assert want and sorted(tuple(r) for r in mixing.sampled(clashing, total=9_000).collect()) == want
    out = mixing.mix(clashing, total=9_000)
    assert out.columns == [*clashing.columns[:-1], "__epoch"] and out.first()["cut"] == "cut"
    kept = mixing.mix(clashing, total=9_000, epoch_col="turn")
    assert kept.columns == [*clashing.columns, "turn"] and kept.first()["__epoch"] == "__epoch"


def test_poor_rows_are_sampled_in_key_order(spark):
    # weights under the least one give keys far beyond those of good documents
    texts = [(i, "##" * 200) for i in range(400)]
    frame = docs(spark, texts)
    keyed = [tuple(r) for r in frame.select("doc_id", "source", mixing.sample_key(F.col("doc_id"), mixing.quality_of(F.col("text")), mixing.SEED), mixing.tokens_of(F.col("text"))).collect()]
    assert max(r[2] for r in keyed) > 64
    got = sorted(tuple(r) for r in mixing.sampled(frame, targets={"s": 1.0}, total=39_000).collect())
    assert got == brute_mix(keyed, {"s": 1.0}, 39_000) and 300 < len(got) < 400


def test_rows_equal_in_key_id_and_tokens_stay_together(spark):
    frame = docs(spark, [(1, "a" * 400), (1, "b" * 400), (2, "c" * 400)])
    ids = sorted(r["doc_id"] for r in mixing.sampled(frame, targets={"s": 1.0}, total=200).collect())
    assert ids in ([1, 1], [2])
