"""Document frequencies of all words of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._frames import tidy

MERGE_AT = 1_500_000
"""Entries a task gathers before it adds them up."""


def distinct_words(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document index) of each text's distinct words."""
    parts, sizes = [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        x = np.sort(words.hash[a:b])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        parts.append(x)
        sizes.append(len(x))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sizes)), sizes)


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(keys) else v for v in values)


def term_df(picked: DataFrame) -> DataFrame:
    """(term, df) over (id, text): the hash of each word and the number of texts that have it.

    A task adds up its own texts first, so the shuffle grows with the vocabulary of the
    tasks and not with the text.
    """

    def run(batches):
        terms, counts, waiting = [], [], 0
        for batch in batches:
            for a, b in K.chunks(batch.column(1)):
                h, _ = distinct_words(K.Words(batch.column(1).slice(a, b - a)))
                terms.append(h)
                counts.append(np.ones(len(h), np.int64))
                waiting += len(h)
                if waiting > MERGE_AT:
                    h, c = sum_by_key(np.concatenate(terms), np.concatenate(counts))
                    terms, counts, waiting = [h], [c], min(len(h), MERGE_AT // 2)
        if terms:
            h, c = sum_by_key(np.concatenate(terms), np.concatenate(counts))
            for a in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 50_000].view(np.int64)), pa.array(c[a : a + 50_000])], ["term", "df"])

    return picked.mapInArrow(tidy(run), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
