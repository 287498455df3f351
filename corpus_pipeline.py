"""The corpus pipeline: five operators, each working on all that its predecessor kept.

Every stage but the last returns the columns of its input, in order, whatever they are named;
names beginning with ``__`` are reserved. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import bpe, jaccard, mixing, pii, toxicity
from codestrata.plans.shared import drop, scratch, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that score as toxic; a lexicon is induced from the documents given.

    Null and empty texts and rows with a null id are scored like others, and stay unless
    toxic. Repeated rows stay or go together. A score at the threshold is toxic. Texts of
    any length are scored whole. Without labels of both kinds all rows stay.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates.

    Rows with a null id and null or blank texts are in no group and stay. Of rows with
    equal id and text one stays. A coefficient at the threshold exactly makes a pair.
    """
    return jaccard.keep_one_of_each_group(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with sanitised texts and their lengths in ``n_chars``.

    Null, empty and clean texts come out as they are, with the length that came in.
    Repeated rows come out alike, as often as they came.
    """
    return pii.sanitise(docs, length_col="n_chars", counts=("__pii_entities", "__pii_terms")).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of their sources, once for each epoch.

    A null source is a source of its own. Null and empty texts cost no tokens and are drawn
    by their ids like others. Rows equal in key, id and tokens are taken or left together.
    """
    return mixing.mix(docs, epoch_col="__mix_turn").drop("__mix_turn")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, n_tokens, tokens, round_trip), one row for each row.

    A null text has null tokens, an empty one none; null ids and repeated rows stay.
    """
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Toxicity, PII and BPE have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage writes for itself goes with its end, and its result with the next one's.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(spark, before)
        before = path
    return docs
