"""The code index: one row a file with its symbols, imports and calls; built, refreshed, kept and asked.

index(path, language, size_bytes, mtime, head_hash, symbols, imports, calls, parse_errors, skipped, skip_reason)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.shared import drop, materialize
from . import extract, graph, retrieve, security

VERSION = 1
GUIDES = {
    "default": ("build the index", "read the map", "find symbols", "look at the impact before a change", "take a snapshot", "run the tests", "remember what was decided"),
    "debug": ("read the diagnostics", "parse the test run", "search for the message", "walk the callers", "remember the cause"),
    "new-feature": ("look at the overview", "read the map", "pack the context of the files in focus", "list dependencies", "take a snapshot", "scan for secrets"),
    "refactor": ("build the index", "find the symbol", "look at its impact", "take a snapshot", "preview the renaming", "run the tests"),
}


def build(texts: DataFrame) -> DataFrame:
    """The index of texts(path, language, text, size_bytes, mtime[, head_hash, is_binary, error]).

    Files of no known language are left out. Binary files, files without a text and those
    with an ``error`` are rows that are skipped, with the reason, and have no symbols.
    """
    has = set(texts.columns)
    reason = F.coalesce(F.col("error"), F.lit(None)) if "error" in has else F.lit(None).cast("string")
    binary = F.col("is_binary") if "is_binary" in has else F.lit(False)
    reason = F.when(reason.isNotNull(), reason).when(binary, "binary").when(F.col("text").isNull(), "unreadable")
    known = texts.where(F.col("language").isNotNull()).select("path", "language", "size_bytes", "mtime", F.col("head_hash") if "head_hash" in has else F.lit("").alias("head_hash"), F.when(reason.isNull(), F.col("text")).alias("text"), reason.alias("skip_reason"))
    # parsed once: symbols, calls and the rows themselves all read it
    parsed = materialize(extract.parse(known), "index-parsed")
    imports = extract.imports(parsed).groupBy(F.col("from").alias("path")).agg(F.array_sort(F.collect_list(F.struct("ord", "line", "specifier", "names", "is_type_only", "is_dynamic"))).alias("imports"))
    calls = extract.calls(parsed).groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("ord", "line", "callee_text", "caller_id", "caller_name", "callee_id", "dynamic"))).alias("calls"))
    out = parsed.drop("text", "stripped").join(imports, "path", "left").join(calls, "path", "left")
    skipped = F.col("skip_reason").isNotNull()
    return out.select("path", "language", "size_bytes", "mtime", "head_hash", F.coalesce("symbols", F.array()).alias("symbols"), "imports", "calls", F.when(skipped & (F.col("skip_reason") != "binary"), 1).otherwise(0).alias("parse_errors"), skipped.alias("skipped"), "skip_reason")


def refresh(texts: DataFrame, before: DataFrame | None, force: bool = False) -> DataFrame:
    """The index of texts in which files of the same size and time are taken over as they were; files that are gone are gone."""
    if before is None or force:
        return build(texts)
    keys = ["path", "size_bytes", "mtime"]
    return before.join(texts.select(*keys), keys, "left_semi").unionByName(build(extract.changed(texts, before)))


def symbols(index: DataFrame) -> DataFrame:
    return extract.symbols(index)


def imports(index: DataFrame) -> DataFrame:
    """The imports of an index, resolved against all of its files."""
    rows = index.select(F.col("path").alias("from"), F.explode("imports").alias("i")).select("from", "i.specifier", "i.names", "i.is_type_only", "i.is_dynamic", "i.line", "i.ord")
    return extract.resolve_imports(rows, index)


def calls(index: DataFrame) -> DataFrame:
    return index.select(F.col("path").alias("file"), F.explode("calls").alias("c")).select("c.caller_id", "c.caller_name", "file", "c.line", "c.callee_text", "c.callee_id", "c.dynamic", "c.ord")


def stats(index: DataFrame) -> DataFrame:
    """One row: files, indexed, skipped, symbols, edges (imports and calls)."""
    edges = F.coalesce(F.size("imports"), F.lit(0)) + F.coalesce(F.size("calls"), F.lit(0))
    return index.agg(F.count("*").alias("files"), F.count_if(~F.col("skipped")).alias("indexed"), F.count_if(F.col("skipped")).alias("skipped"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).cast("bigint").alias("symbols"), F.coalesce(F.sum(F.when(edges > 0, edges)), F.lit(0)).cast("bigint").alias("edges"))


def save(index: DataFrame, path: str, root: str) -> None:
    """Write an index under a path, whole or not at all: it is written beside and then moved into place."""
    spark = index.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    drop(spark, new, old)
    index.withColumn("__version", F.lit(VERSION)).withColumn("__root", F.lit(root)).write.parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(new), at(path)):
        raise EngineError("INTERNAL_ERROR", f"the index can't be moved to {path}")
    drop(spark, old)


def load(spark: SparkSession, path: str, root: str) -> DataFrame | None:
    """The index saved under a path; None where there is none, or one of another version or root."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    try:
        rows = spark.read.parquet(path)
        head = rows.select("__version", "__root").first()
    except Exception:  # noqa: BLE001 - an unreadable index counts as none
        return None
    if head is not None and (head["__version"], head["__root"]) != (VERSION, root):
        return None
    return rows.drop("__version", "__root")


def file_symbols(index: DataFrame, path: str) -> DataFrame:
    """(line, exported, kind, qualname, parse_errors) of a file's symbols in order; no rows for a file not in the index."""
    return index.where(F.col("path") == path).select("parse_errors", F.explode("symbols").alias("s")).select(F.col("s.start_line").alias("line"), "s.exported", "s.kind", "s.qualname", "parse_errors")


def matching(ids: DataFrame, text: str) -> DataFrame:
    """The least id that holds a text in any case, as one row or none."""
    return ids.where(F.contains(F.lower("id"), F.lit(text.lower()))).agg(F.min("id").alias("id")).where("id IS NOT NULL")


def call_walk(index: DataFrame, symbol: str, direction: str = "callees", depth: int | None = None) -> DataFrame:
    """(start, id): the functions that the first one matching a name calls, or that call it, up to a depth."""
    if direction not in ("callers", "callees"):
        raise EngineError("VALIDATION", f"unknown direction {direction}", "callers or callees")
    nodes, edges = graph.call_graph(symbols(index), calls(index))
    return graph.reach(edges, matching(nodes, symbol), backward=direction == "callers", depth=depth)


def impact(index: DataFrame, target: str, mode: str = "file") -> DataFrame:
    """(start, affected, tests, ids): what a change of a file, or of the first matching function, reaches against the edges."""
    if mode == "file":
        nodes, edges = graph.file_graph(index, imports(index))
        start = nodes.where(F.col("id") == target)
    elif mode == "symbol":
        nodes, edges = graph.call_graph(symbols(index), calls(index))
        start = matching(nodes, target)
    else:
        raise EngineError("VALIDATION", f"unknown mode {mode}", "file or symbol")
    found = graph.impact(edges, start).groupBy("start").agg(F.count("*").alias("affected"), F.count_if("is_test").alias("tests"), F.array_sort(F.collect_list("id")).alias("ids"))
    none = F.array().cast("array<string>")
    return start.select(F.col("id").alias("start")).join(found, "start", "left").select("start", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("tests", F.lit(0)).alias("tests"), F.coalesce("ids", none).alias("ids"))


def overview(index: DataFrame, paths: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """One row: indexed, symbols, languages (the ten with the most bytes), entry_points, branch."""
    from ..sources.files import entry_points
    from .logs import repository_state

    top = retrieve.language_overview(index, "language", "size_bytes", 10).agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "language", "files", "bytes"))).alias("l"))
    top = top.select(F.transform("l", lambda x: F.struct(x["language"].alias("language"), x["files"].alias("files"), x["bytes"].alias("bytes"))).alias("languages"))
    entries = entry_points(paths).agg(F.array_sort(F.collect_set("path")).alias("entry_points"))
    branch = repository_state(status).agg(F.max("branch").alias("branch")) if status is not None else index.sparkSession.range(1).select(F.lit(None).cast("string").alias("branch"))
    return stats(index).select("indexed", "symbols").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(entries)).crossJoin(F.broadcast(branch))  # one row each


def server_status(index: DataFrame | None, memory: DataFrame, root: str) -> DataFrame:
    """One row: version, root, index_ready, indexed_files, symbol_count, edge_count, memory_count, backend."""
    kept = memory.agg(F.count("*").alias("memory_count"))
    head = [F.lit(VERSION).alias("version"), F.lit(root).alias("root"), F.lit(index is not None).alias("index_ready")]
    if index is None:
        return kept.select(*head, *[F.lit(0).cast("bigint").alias(c) for c in ("indexed_files", "symbol_count", "edge_count")], "memory_count", F.lit("lexical").alias("backend"))
    return stats(index).crossJoin(F.broadcast(kept)).select(*head, F.col("indexed").alias("indexed_files"), F.col("symbols").alias("symbol_count"), F.col("edges").alias("edge_count"), "memory_count", F.lit("lexical").alias("backend"))


def guide(spark: SparkSession, topic: str = "default") -> DataFrame:
    """(topic, step, what) of a way to work; an unknown topic has the default one."""
    steps = GUIDES.get(topic, GUIDES["default"])
    return spark.createDataFrame([(topic, k + 1, s) for k, s in enumerate(steps)], "topic string, step int, what string")


def guarded_span(texts: DataFrame, start: int = 1, end: int = 50, allow_sensitive: bool = False) -> DataFrame:
    """(path, code, span, total_lines, tokens, injections): numbered lines of each text, with an error code in place of the
    lines of sensitive and binary files, and the number of injection phrases in the lines."""
    from ..functions import text as T

    rows = F.slice(F.split("text", "\n"), start, max(0, end - start + 1))
    span = F.array_join(F.transform(rows, lambda line, i: F.concat((i + F.lit(start)).cast("string"), F.lit(": "), line)), "\n")
    code = F.when(T.is_sensitive(F.col("path")) & F.lit(not allow_sensitive), "PATH_SENSITIVE").when(F.col("text").isNull(), "FILE_BINARY")
    out = texts.select("path", code.alias("code"), F.when(code.isNull(), span).alias("span"), F.size(F.split("text", "\n")).cast("bigint").alias("total_lines"))
    hits = sum((F.regexp_count("span", F.lit(p)) for p in security.INJECTION[1:]), F.regexp_count("span", F.lit(security.INJECTION[0])))
    return out.select("path", "code", "span", F.when(F.col("code").isNull(), F.col("total_lines")).alias("total_lines"), T.token_estimate(F.col("span")).alias("tokens"), F.coalesce(hits, F.lit(0)).cast("bigint").alias("injections"))
