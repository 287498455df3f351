"""Operator 3: mixing sources to target weights.

Efraimidis-Spirakis sampling: a document draws the exponential key ``-ln(u) / q`` with
``u`` hashed from its id and ``q`` its quality weight, and a source is taken in key
order. Each source has a token budget; as many complete epochs as fit come first, and
the prefix of the key order whose running token sum fits the remainder follows.

The order is never sorted as a whole. Keys are cut into slices of fixed width, whose
token sums are small; their running sum tells for every source the one slice in which
the budget ends. Documents of earlier slices are taken, those of later ones are not, and
only the slice between is sorted. Documents are read three times, for the sums, for the
slice between and for the result, and not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize, maybe_broadcast
from ._frames import MAX_SAFE_ROWS, col, table

SEED = 17
TEMPERATURE = 0.7
"""Default targets: a source's share of all tokens to this power, normalised."""
SIZE = 1.0
"""Default total: this many times the tokens there are."""
SLICES = 131_072
"""Key slices for each unit of ``log(1 + key)``: 13,000 a unit of key where keys are 9, at most 870,000 in all."""
SPAN = 1 << 52
MARKS = "0123456789|#*{}<>=_~\\/^@$%&+[]"
NO_SOURCE = "(none)"
EPOCH = "__epoch"


def tokens_of(text: Column) -> Column:
    """The token estimate that budgets are counted in: a quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("bigint")


def quality_of(text: Column) -> Column:
    """A weight in [0.05, 1]: the share of characters that are no digits or marks, less for short texts."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    clean = F.length(F.translate(text, MARKS, "")) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.05), clean * F.least(F.lit(1.0), n / F.lit(400.0)))


def sample_key(id_: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(SPAN))
    return -F.log(u) / weight


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = SEED, epoch_col: str = EPOCH) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns and ``epoch_col``, once for each epoch.

    ``targets``: source -> weight, normalised over the sources there are; a source that
    it does not name gets nothing, and none given means tempered shares. ``total``: the
    token budget, by default ``SIZE`` times all tokens. ``weight_col``: a column of quality
    weights in place of ``quality_of``; null or under 0.05 counts as 0.05.

    Rows, not ids, are sampled: repeated rows draw the same key and are taken in turn, the
    order of ties being the id's, then the token count's; rows equal in all three fall
    together and are all left out where they don't all fit. A null source is the source
    ``(none)``; a null id draws as the empty string and sorts first. Null and empty texts
    cost no tokens. A source without tokens keeps its rows for one epoch if it has a
    budget. Extra columns are carried along; names beginning with ``__mix_`` are reserved
    here, and an incoming column named like ``epoch_col`` is replaced. An empty table gives an empty result.
    """
    weight = quality_of(col(docs, text_col)) if weight_col is None else F.greatest(F.lit(0.05), F.coalesce(col(docs, weight_col).cast("double"), F.lit(0.05)))
    key = sample_key(col(docs, id_col), weight, seed)
    keyed = docs.select("*", F.coalesce(col(docs, source_col).cast("string"), F.lit(NO_SOURCE)).alias("__mix_source"), tokens_of(col(docs, text_col)).alias("__mix_tokens"), key.alias("__mix_key"))
    keyed = keyed.withColumn("__mix_slice", F.floor(F.log1p("__mix_key") * SLICES).cast("int"))
    sums = materialize(keyed.groupBy("__mix_source", "__mix_slice").agg(F.sum("__mix_tokens").alias("t")), "mix-slices")
    source = materialize(plan(sums, targets, total), "mix-plan")
    n_sources = source.count()
    rows = keyed.join(maybe_broadcast(source, n_sources, MAX_SAFE_ROWS // 10), "__mix_source")
    here = F.struct("__mix_key", F.col(f"`{id_col}`").alias("__mix_id"), "__mix_tokens")
    inside = F.col("__mix_slice") < F.col("__mix_cut")
    at_cut = rows.where(F.col("__mix_slice") == F.col("__mix_cut")).select("__mix_source", here.alias("__mix_here"), "__mix_tokens", "__mix_room")
    # a cut slice holds few rows; the order by several columns needs dense ranks for a range frame
    ranked = at_cut.withColumn("__mix_rank", F.dense_rank().over(Window.partitionBy("__mix_source").orderBy("__mix_here")))
    order = Window.partitionBy("__mix_source").orderBy("__mix_rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = ranked.withColumn("__mix_run", F.sum("__mix_tokens").over(order)).where("__mix_run <= __mix_room")
    last = materialize(taken.groupBy("__mix_source").agg(F.max("__mix_here").alias("__mix_last")), "mix-last")
    rows = rows.join(maybe_broadcast(last, n_sources, MAX_SAFE_ROWS // 10), "__mix_source", "left")
    extra = (inside | ((F.col("__mix_slice") == F.col("__mix_cut")) & F.coalesce(here <= F.col("__mix_last"), F.lit(False)))).cast("int")
    copies = (F.col("__mix_epochs") + extra).cast("int")
    out = rows.where(copies > 0).withColumn("__mix_epoch", F.explode(F.sequence(F.lit(1), copies)))
    return out.select(*[col(docs, c) for c in docs.columns if c != epoch_col], F.col("__mix_epoch").alias(epoch_col))


def plan(sums: DataFrame, targets: Mapping[str, float] | None, total: int | None) -> DataFrame:
    """For each source its complete epochs, the slice in which the rest ends and the room left there."""
    per = sums.groupBy("__mix_source").agg(F.sum("t").alias("have"))
    everything = Window.partitionBy(F.lit(1))
    if targets is None:
        share = F.pow(F.col("have") / F.greatest(F.sum("have").over(everything), F.lit(1)), F.lit(TEMPERATURE))
    elif targets:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("__mix_source")].cast("double"), F.lit(0.0))
    else:
        share = F.lit(0.0)
    per = per.withColumn("share", share).withColumn("all", F.sum("have").over(everything)).withColumn("shares", F.sum("share").over(everything))
    wanted = F.lit(total) if total is not None else F.col("all") * F.lit(SIZE)
    per = per.withColumn("budget", F.when(F.col("shares") > 0, F.floor(wanted * F.col("share") / F.col("shares"))).otherwise(F.lit(0)).cast("bigint"))
    per = per.withColumn("epochs", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.greatest(F.col("have"), F.lit(1)))).otherwise(F.when(F.col("budget") > 0, 1).otherwise(0)).cast("bigint"))
    per = per.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have")).select("__mix_source", "epochs", "rest")
    run = sums.withColumn("run", F.sum("t").over(Window.partitionBy("__mix_source").orderBy("__mix_slice")))
    cut = run.join(per, "__mix_source").groupBy("__mix_source", "epochs", "rest").agg(
        F.min(F.when(F.col("run") > F.col("rest"), F.col("__mix_slice"))).alias("cut"), F.max(F.when(F.col("run") <= F.col("rest"), F.col("run"))).alias("before")
    )
    ends = F.when(F.col("rest") > 0, F.coalesce(F.col("cut"), F.lit(2**31 - 1))).otherwise(F.lit(-1))
    return cut.select("__mix_source", F.col("epochs").alias("__mix_epochs"), ends.alias("__mix_cut"), (F.col("rest") - F.coalesce(F.col("before"), F.lit(0))).alias("__mix_room"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, epoch) of the mix."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    return mix(docs, **options).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(EPOCH).alias("epoch"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


_MARKS_SQL = MARKS.replace("'", "''")
SQL = f"""WITH d AS (
  SELECT doc_id, source, coalesce(source, '{NO_SOURCE}') AS s, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents),
k AS (
  SELECT doc_id, source, s, ceil(n / 4.0)::BIGINT AS t,
    -ln((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / {SPAN}.0)
    / greatest(0.05, (length(translate(x, '{_MARKS_SQL}', '')) / greatest(n, 1)::DOUBLE) * least(1.0::DOUBLE, n / 400.0::DOUBLE)) AS key
  FROM d),
p AS (SELECT s, sum(t)::BIGINT AS have FROM k GROUP BY s),
q AS (SELECT s, have, sum(have) OVER ()::DOUBLE AS total, pow(have / greatest(sum(have) OVER (), 1)::DOUBLE, {TEMPERATURE}::DOUBLE) AS share FROM p),
b AS (SELECT s, have, floor(total * {SIZE}::DOUBLE * share / sum(share) OVER ())::BIGINT AS budget FROM q),
e AS (SELECT s, have, budget, CASE WHEN have > 0 THEN budget // greatest(have, 1) ELSE (budget > 0)::BIGINT END AS epochs FROM b),
r AS (SELECT k.*, e.epochs, budget - epochs * have AS rest, sum(t) OVER (PARTITION BY k.s ORDER BY key, doc_id, t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k JOIN e USING (s))
SELECT doc_id, source, unnest(generate_series(1, (epochs + (rest > 0 AND run <= rest)::BIGINT)::BIGINT))::INT AS epoch FROM r"""
