"""Small keyed stores as tables: memory, tasks, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MEMORY_ENTRIES = 500
SNAPSHOT_BYTES = 10 << 20


def memory_upsert(writes: DataFrame, seq: str = "seq") -> DataFrame:
    """memory(namespace, key, value, tags, created_at, updated_at, first_seq): the last write of each key, at the place of its first."""
    return writes.groupBy("namespace", "key").agg(F.max_by("value", seq).alias("value"), F.max_by("tags", seq).alias("tags"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.min(seq).alias("first_seq"))


def memory_cap(memory: DataFrame, most: int = MEMORY_ENTRIES) -> DataFrame:
    """The entries written first latest, so many at most over all namespaces."""
    return memory.orderBy(F.desc("first_seq")).limit(most)


def memory_search(memory: DataFrame, text: str | None = None, tags: list[str] | None = None, namespace: str | None = None, limit: int | None = None) -> DataFrame:
    out = memory
    if namespace is not None:
        out = out.where(F.col("namespace") == namespace)
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if text:
        out = out.where(T.contains_ignoring_case(F.col("key"), text) | T.contains_ignoring_case(F.col("value"), text))
    return out.orderBy(F.desc("first_seq")).limit(limit) if limit is not None else out


def memory_forget(memory: DataFrame, what: str) -> DataFrame:
    """The entries left when those with a part of key or value, or all of the id, are forgotten."""
    gone = F.contains("key", F.lit(what)) | F.contains("value", F.lit(what))
    if "id" in memory.columns:
        gone = gone | (F.col("id") == what)
    return memory.where(~gone)


def forgotten(memory: DataFrame, what: str) -> DataFrame:
    """One row: how many entries ``memory_forget`` removes."""
    return memory.agg(F.count("*").alias("a")).crossJoin(memory_forget(memory, what).agg(F.count("*").alias("b"))).select((F.col("a") - F.col("b")).alias("removed"))


def save(store: DataFrame, path: str) -> None:
    """Write a store under a path, whole or not at all."""
    from .index import save as saved

    saved(store, path, "store")


def load(spark, path: str, schema: str) -> DataFrame:
    """The store saved under a path; an empty one where there is none or it can't be read."""
    from .index import load as loaded

    rows = loaded(spark, path, "store")
    return spark.createDataFrame([], schema) if rows is None else rows


def task_status(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, state): pending tasks are ready if all they depend on is completed, else blocked."""
    done = tasks.select(F.col("id").alias("depends_on"), (F.col("status") == "completed").alias("done"))
    open_ = deps.join(done, "depends_on", "left").groupBy("id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("free"))
    state = F.when(F.col("status") != "pending", F.col("status")).when(F.coalesce("free", F.lit(True)), "ready").otherwise("blocked")
    return tasks.join(open_, "id", "left").select("id", state.alias("state"))


def next_task(tasks: DataFrame, deps: DataFrame, order: str = "id") -> DataFrame:
    """The ready task that comes first in an order, as one row or none."""
    return task_status(tasks, deps).where("state = 'ready'").join(tasks.select("id", F.col(order).alias("__order")), "id").agg(F.min_by("id", F.struct("__order", "id")).alias("id")).where("id IS NOT NULL")


def task_counts(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    return task_status(tasks, deps).groupBy("state").agg(F.count("*").alias("tasks"))


def task_update(tasks: DataFrame, deps: DataFrame, task: str, status: str) -> DataFrame:
    """Tasks after one changes its status: completion frees dependents, failure blocks direct pending ones."""
    now = tasks.withColumn("status", F.when(F.col("id") == task, status).otherwise(F.col("status")))
    if status == "completed":
        states = task_status(now.withColumn("status", F.when(F.col("status") == "blocked", "pending").otherwise(F.col("status"))), deps)
        free = states.where("state = 'ready'").select("id", F.lit(True).alias("free"))
        return now.join(free, "id", "left").withColumn("status", F.when((F.col("status") == "blocked") & F.coalesce("free", F.lit(False)), "pending").otherwise(F.col("status"))).drop("free")
    if status == "failed":
        hit = deps.where(F.col("depends_on") == task).select("id", F.lit(True).alias("hit")).distinct()
        return now.join(hit, "id", "left").withColumn("status", F.when((F.col("status") == "pending") & F.coalesce("hit", F.lit(False)), "blocked").otherwise(F.col("status"))).drop("hit")
    return now


def task_problems(new: DataFrame, deps: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(id, problem) that keep tasks from being submitted: duplicate, unknown dependency, cycle."""
    from . import graph

    twice = new.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    known = new.select(F.col("id").alias("depends_on"))
    if stored is not None:
        twice = twice.union(new.select("id").join(stored.select("id"), "id", "left_semi").select("id", F.lit("duplicate").alias("problem"))).distinct()
        known = known.union(stored.select(F.col("id").alias("depends_on")))
    unknown = deps.join(known.distinct(), "depends_on", "left_anti").select("id", F.lit("unknown dependency").alias("problem")).distinct()
    nodes, edges = graph.build(deps.select(F.col("id").alias("src"), F.col("depends_on").alias("dst")), new)
    parts = graph.strongly_connected(nodes, edges)
    large = parts.groupBy("component").count().where("count > 1").select("component")
    cyclic = parts.join(large, "component", "left_semi").select("id").union(edges.where("src = dst").select(F.col("src").alias("id"))).distinct()
    return twice.union(unknown).union(cyclic.select("id", F.lit("cycle").alias("problem")))


def snapshot(files: DataFrame, snapshot_id: str, at: Column, most_bytes: int = SNAPSHOT_BYTES) -> DataFrame:
    """(snapshot_id, created_at, path, content, size_bytes) of files in order of path until the bytes before reach a cap.

    Only paths and sizes are put in order, and of these only as many as the cap may take:
    no path beyond the first whose bytes, added up over coarse ranges of paths, reach it.
    """
    sizes = files.select("path", "size_bytes")
    near = F.left("path", F.lit(3))
    coarse = sizes.groupBy(near.alias("range")).agg(F.sum("size_bytes").alias("b"))
    run = coarse.select("range", F.coalesce(F.sum("b").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    some = sizes.withColumn("range", near).join(run.where(F.col("before") < most_bytes), "range")
    inner = F.coalesce(F.sum("size_bytes").over(Window.partitionBy("range").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = some.withColumn("all", F.col("before") + inner).where(F.col("all") < most_bytes).select("path")
    return files.join(chosen, "path", "left_semi").select(F.lit(snapshot_id).alias("snapshot_id"), at.alias("created_at"), "path", "content", "size_bytes")


def snapshots(store: DataFrame) -> DataFrame:
    return store.groupBy("snapshot_id").agg(F.max("created_at").alias("created_at"), F.count("*").alias("files"))


def restore(store: DataFrame, snapshot_id: str) -> DataFrame:
    return store.where(F.col("snapshot_id") == snapshot_id).select("path", "content")


def difference(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, change): added, removed and changed rows of two snapshots; equal ones are left out."""
    a = before.select(*key, F.col(value).alias("__a"), F.lit(True).alias("__ina"))
    b = after.select(*key, F.col(value).alias("__b"), F.lit(True).alias("__inb"))
    change = F.when(F.col("__ina").isNull(), "added").when(F.col("__inb").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, key, "full").select(*key, change.alias("change")).where("change IS NOT NULL")
