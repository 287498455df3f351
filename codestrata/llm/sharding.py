"""Operator 9: sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's path, and the
smallest draw wins, so a child gets keys in proportion to its weight. A changed weight
alters one draw of one level: keys move only to or from that child, within its parent.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import col, table

LEVELS = ("region", "rack", "shard")
#: name -> (weight, children); shards have no children.
TOPOLOGY: Mapping = {
    "east": (3.0, {"r1": (2.0, {"s1": (1.0, {}), "s2": (1.0, {}), "s3": (2.0, {})}), "r2": (1.0, {"s1": (1.0, {}), "s2": (1.0, {})})}),
    "west": (2.0, {"r1": (1.0, {"s1": (1.0, {}), "s2": (3.0, {})}), "r2": (1.0, {"s1": (1.0, {}), "s2": (1.0, {}), "s3": (1.0, {})}), "r3": (2.0, {"s1": (1.0, {})})}),
    "south": (1.0, {"r1": (1.0, {"s1": (1.0, {}), "s2": (0.5, {})}), "r2": (0.5, {"s1": (1.0, {}), "s2": (1.0, {})})}),
}
SPAN = 1 << 52


def _unit(key: Column, path: str) -> Column:
    digest = F.md5(F.concat(key, F.lit("|" + path)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(SPAN))


def _pick(key: Column, prefix: str, children: Mapping) -> Column:
    live = {name: w for name, (w, _) in children.items() if w > 0}
    if not live:
        return F.lit(None).cast("string")
    if len(live) == 1:
        return F.lit(next(iter(live)))
    draws = [F.struct((-F.log(_unit(key, prefix + name)) / F.lit(float(w))).alias("d"), F.lit(name).alias("n")) for name, w in sorted(live.items())]
    return F.least(*draws)["n"]


def _by(column: Column, options: list[tuple[str, Column]]) -> Column:
    if not options:
        return F.lit(None).cast("string")
    return reduce(lambda acc, o: acc.when(column == o[0], o[1]), options[1:], F.when(column == options[0][0], options[0][1]))


def assign(df: DataFrame, key_col: str = "doc_id", topology: Mapping = TOPOLOGY) -> DataFrame:
    """(key, region, rack, shard) for every row, under the key column's own name, or as
    ``key`` where the key column is named like a level.

    One row for each input row: repeated keys get the same place; a null key is placed
    as the empty string. Children of weight 0 or less get nothing, and where no child is
    left the level and those below are null. Other columns are not read. A narrow
    projection: no shuffle, evaluated in generated code.
    """
    key = F.coalesce(col(df, key_col).cast("string"), F.lit(""))
    out = df.select(col(df, key_col).alias("__key"), key.alias("__text"))
    out = out.withColumn("region", _pick(F.col("__text"), "", topology))
    racks = [(r, _pick(F.col("__text"), f"{r}/", kids)) for r, (w, kids) in sorted(topology.items()) if w > 0]
    out = out.withColumn("rack", _by(F.col("region"), racks))
    shards = [(f"{r}/{k}", _pick(F.col("__text"), f"{r}/{k}/", leaves)) for r, (w, kids) in sorted(topology.items()) if w > 0 for k, (v, leaves) in sorted(kids.items()) if v > 0]
    out = out.withColumn("shard", _by(F.concat("region", F.lit("/"), "rack"), shards))
    return out.select(F.col("__key").alias("key" if key_col in LEVELS else key_col), *LEVELS)


def _sql_pick(prefix: str, children: Mapping) -> str:
    live = {n: w for n, (w, _) in children.items() if w > 0}
    if len(live) == 1:
        return f"'{next(iter(live))}'"
    draw = "{{'d': -ln((('0x' || substr(md5(k || '|{path}'), 1, 13))::BIGINT + 0.5) / {span}.0) / {w}, 'n': '{n}'}}"
    return "least(" + ", ".join(draw.format(path=prefix + n, span=SPAN, w=float(w), n=n) for n, w in sorted(live.items())) + ").n"


def _sql(topology: Mapping) -> str:
    racks = " ".join(f"WHEN region = '{r}' THEN {_sql_pick(r + '/', kids)}" for r, (_, kids) in sorted(topology.items()))
    shards = " ".join(f"WHEN region = '{r}' AND rack = '{k}' THEN {_sql_pick(f'{r}/{k}/', leaves)}" for r, (_, kids) in sorted(topology.items()) for k, (_, leaves) in sorted(kids.items()))
    return f"""WITH a AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
b AS (SELECT *, {_sql_pick("", topology)} AS region FROM a),
c AS (SELECT *, CASE {racks} END AS rack FROM b)
SELECT doc_id, region, rack, CASE {shards} END AS shard FROM c"""


SQL = _sql(TOPOLOGY)


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
