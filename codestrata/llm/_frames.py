"""Small helpers for operators that run Arrow kernels over DataFrames."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SAFE_ROWS = 1_000_000
"""Rows of at most two numbers that may be broadcast; checked by a count before."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever dots or case variants stand beside it."""
    return F.col(f"`{name}`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators work on, as (id bigint, text string).

    Bytes that are not UTF-8 become U+FFFD here, so that no kernel meets them.
    """
    return docs.select(col(docs, id_col).cast("bigint").alias("id"), F.make_valid_utf8(col(docs, text_col).cast("string")).alias("text"))


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1 ...: mapInArrow can't take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def release() -> None:
    """Give a worker's free memory back. Workers live on between tasks, and what one
    stage needed for a while would otherwise stay with the executor for all that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run):
    """An iterator function for mapInArrow that releases memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(fn):
    """Likewise a function of one table, for applyInArrow."""

    def wrapped(rows):
        try:
            return fn(rows)
        finally:
            release()

    return wrapped


def tidy_cogroup(fn):
    """Likewise a function of two tables."""

    def wrapped(left, right):
        try:
            return fn(left, right)
        finally:
            release()

    return wrapped


def batched(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """An iterator function for mapInArrow from a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return tidy(run)
