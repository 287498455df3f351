import random

import pytest
from pyspark.errors import PythonException

from codestrata.llm import bpe, sharding


def frame_of(spark, lists):
    return spark.createDataFrame([(i, t, "clash") for i, t in lists], "doc_id bigint, tokens array<int>, text string")


def test_lists_of_all_kinds_are_decoded(spark, monkeypatch):
    model = bpe.Bpe.load(bpe.VOCABULARY)
    rng = random.Random(1)
    lists = [(i, [rng.randrange(len(model.lengths)) for _ in range(rng.randint(0, 60))]) for i in range(400)] + [(None, [1]), (401, None), (402, []), (1, [5, 6])]
    want = sorted(((i, None if t is None else model.decode(t).decode("utf-8", "replace")) for i, t in lists), key=str)
    frame = frame_of(spark, lists)
    assert sorted(map(tuple, bpe.decode(frame).collect()), key=str) == want
    assert bpe._strings(*model_ranges(model, [0, 2**0])) is not None
    long = [i % 50_000 for i in range(1_500_000)]
    assert bpe.decode(frame_of(spark, [(1, long)])).first()["text"] == model.decode(long).decode("utf-8", "replace")
    assert bpe.decode(frame_of(spark, [])).count() == 0


def model_ranges(model, ids):
    import numpy as np

    data, lengths = model.decode_flat(np.array(ids))
    return data, np.concatenate(([0], np.cumsum(lengths))), np.zeros(len(ids), bool)


@pytest.mark.parametrize("ids", [[-3], [-100], [10**9], [1, None]])
def test_ids_outside_the_vocabulary_are_errors(spark, ids):
    with pytest.raises(PythonException, match="outside the vocabulary|holds a null"):
        bpe.decode(frame_of(spark, [(1, ids)])).collect()


@pytest.mark.parametrize("level", sharding.LEVELS)
def test_sharding_by_a_key_named_like_a_level(spark, level):
    frame = spark.range(50).withColumnRenamed("id", level)
    plain = {r[0]: tuple(r)[1:] for r in sharding.assign(spark.range(50), key_col="id").collect()}
    out = sharding.assign(frame, key_col=level)
    assert out.columns == ["key", *sharding.LEVELS] and {r[0]: tuple(r)[1:] for r in out.collect()} == plain
