"""Search, lookup, references, budgeted maps and previews over files and symbols."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import materialize
from ..sources.files import lines

FIRST_SYMBOLS = 20
MAP_ITERATIONS = 30


SEARCH_LIMIT = 20


def is_pattern(pattern: str, spark) -> bool:
    """Whether the engine takes a pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - any refusal means no
        return False
    return True


def search(texts: DataFrame, pattern: str, literal: bool = False, limit: int | None = None) -> DataFrame:
    """(path, line_no, preview) of the lines that match, in any case; ordered only if limited. A pattern that is none gives no rows."""
    if not literal and not is_pattern(pattern, texts.sparkSession):
        texts, pattern = texts.where(F.lit(False)), ""
    hit = F.contains(F.lower("line"), F.lit(pattern.lower())) if literal else F.col("line").rlike("(?iu)" + pattern)
    # texts without a match are dropped before they are cut into lines; marks of a whole text's ends mean a line's here
    bound = not literal and re.search(r"\\[AzZG]|\(\?[<=!]|\(\?-", pattern)
    whole = F.contains(F.lower("text"), F.lit(pattern.lower())) if literal else F.lit(True) if bound else F.col("text").rlike("(?ium)" + pattern)
    out = lines(texts.where(whole)).where(hit).select("path", "line_no", T.preview(F.col("line")).alias("preview"))
    return out.orderBy("path", "line_no").limit(limit) if limit is not None else out


def glob_search(paths: DataFrame, glob: str) -> DataFrame:
    return paths.where(F.col("path").rlike(T.search_glob(glob))).select("path")


def read_span(texts: DataFrame, start: int, end: int) -> DataFrame:
    """(path, line_no, line, tokens) of the lines from start to end; cut from the split text, not from all lines."""
    part = F.slice(F.split("text", "\n"), start, max(0, end - start + 1))
    rows = texts.select("path", F.posexplode(part).alias("pos", "line"))
    return rows.select("path", (F.col("pos") + start).cast("bigint").alias("line_no"), "line", T.token_estimate(F.col("line")).alias("tokens"))


def line_stats(texts: DataFrame) -> DataFrame:
    return texts.select("path", T.line_count(F.col("text")).alias("lines"), T.line_ending(F.col("text")).alias("line_ending"), F.endswith("text", F.lit("\n")).alias("had_trailing_newline"))


def language_overview(rows: DataFrame, language: str, size: str, top: int | None = 10) -> DataFrame:
    out = rows.where(F.col(language).isNotNull()).groupBy(F.col(language).alias("language")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return out.orderBy(F.desc("bytes"), "language").limit(top) if top else out


def find_symbols(symbols: DataFrame, name: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    out = symbols.where(T.contains_ignoring_case(F.col("name"), name))
    out = out.where(F.col("kind") == kind) if kind else out
    return out.orderBy("name", "file", "ord").limit(limit) if limit is not None else out


def references(calls: DataFrame, imports: DataFrame, symbol: str) -> DataFrame:
    """(file, line, how): calls of a name and imports that bring it in."""
    by_call = calls.where(F.col("callee_text") == symbol).select("file", "line", F.lit("call").alias("how"))
    by_import = imports.where(F.array_contains("names", symbol)).select(F.col("from").alias("file"), "line", F.lit("import").alias("how"))
    return by_call.union(by_import)


def external_packages(imports: DataFrame) -> DataFrame:
    return imports.where(F.col("to").isNull()).select("from", "specifier").distinct()


def within_budget(rows: DataFrame, tokens: str, budget: int, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """The rows whose running token sum in an order stays within the budget; the first always stays.

    Sums of positive numbers never fall, so this stops at the first row that overflows.
    """
    w = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(*order)
    run = rows.withColumn("running_tokens", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(w))
    return run.where((F.col("running_tokens") <= budget) | (F.col("position") == 1))


def outline(symbols: DataFrame, first_symbols: int = FIRST_SYMBOLS) -> DataFrame:
    """(path, outline): the first symbols of each file as ``+Fname`` marks, in order."""
    w = Window.partitionBy("file").orderBy("ord")
    mark = F.concat(F.when(F.col("exported"), "+").otherwise(" "), F.upper(F.left("kind", F.lit(1))), "qualname")
    first = symbols.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first_symbols).select("file", F.struct("rn", mark.alias("mark")).alias("m"))
    return first.groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["mark"]), " ").alias("outline"))


Symbols = DataFrame | Callable[[DataFrame], DataFrame]
"""Symbols, or what makes them of paths(path), so that only files whose symbols are shown are parsed."""


def repo_map(ranks: DataFrame, symbols: Symbols, max_tokens: int = 2048, focus: list[str] | None = None) -> DataFrame:
    """(path, score, entry, tokens, position): files by rank, those in focus first, within a token budget.

    An entry takes a token at least unless its name is empty. So none beyond the first ``max_tokens`` + 1 named
    files by rank can be within the budget, and only these (and those without a name) are outlined and summed.
    """
    score = F.col("score") + (F.col("id").isin(*focus).cast("double") if focus else F.lit(0.0))
    rows = ranks.select(F.col("id").alias("path"), score.alias("score"))
    order = [F.desc("score"), F.asc("path")]
    named = F.coalesce(F.length(T.basename(F.col("path"))) > 0, F.lit(False))
    rows = materialize(rows.where(named).orderBy(*order).limit(max(0, max_tokens) + 1).union(rows.where(~named)), "map-rows")
    shown = symbols(rows.select("path")) if callable(symbols) else symbols.join(rows.select(F.col("path").alias("file")), "file", "left_semi")
    entry = F.concat_ws("  ", T.basename(F.col("path")), "outline")
    rows = rows.join(outline(shown), "path", "left").select("path", "score", entry.alias("entry"), T.token_estimate(entry).alias("tokens"))
    return within_budget(rows, "tokens", max_tokens, order)


def related_files(imports: DataFrame, focus: DataFrame) -> DataFrame:
    """The files in focus, what they import and what imports them."""
    linked = imports.where(F.col("to").isNotNull()).select("from", "to")
    ids = focus.select("path")
    out = linked.join(ids.withColumnRenamed("path", "from"), "from", "left_semi").select(F.col("to").alias("path"))
    back = linked.join(ids.withColumnRenamed("path", "to"), "to", "left_semi").select(F.col("from").alias("path"))
    return ids.union(out).union(back).distinct()


def context_pack(files: DataFrame, imports: DataFrame, symbols: Symbols, focus: DataFrame, max_tokens: int = 8192, iterations: int = MAP_ITERATIONS) -> DataFrame:
    """The map of the files related to a focus, in 30 % of the budget: (path, score, entry, tokens, running_tokens,
    position, all_symbols), the last the list of every symbol of a file in focus.

    Ranks are those of the related files among themselves, over the imports between them. Imports
    are extracted once.
    """
    from . import graph

    imports = materialize(imports.where(F.col("to").isNotNull()).select("from", "to"), "pack-imports")
    related = materialize(files.join(related_files(imports, focus), "path", "left_semi").select("path"), "pack-files")
    inner = imports.join(related.withColumnRenamed("path", "from"), "from", "left_semi").join(related.withColumnRenamed("path", "to"), "to", "left_semi")
    nodes, edges = graph.file_graph(related, inner)
    ranks = graph.pagerank(nodes, edges, iterations)
    marked = focus.select(F.col("path").alias("id"), F.lit(1.0).alias("extra")).distinct()
    ranks = ranks.join(marked, "id", "left").select("id", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
    rows = repo_map(ranks, symbols, int(max_tokens * 0.3))
    named = F.struct("ord", F.concat_ws(" ", "kind", "qualname").alias("s"))
    of_focus = symbols(related.join(focus, "path", "left_semi")) if callable(symbols) else symbols
    whole = of_focus.join(focus.withColumnRenamed("path", "file"), "file", "left_semi").groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["s"]), ", ").alias("all_symbols"))
    return rows.join(whole, "path", "left")


def rename_preview(texts: DataFrame, affected: DataFrame, old: str, new: str) -> DataFrame:
    """(path, line_no, before, after) of the lines of affected files in which a name would change; nothing is written."""
    word = r"(?<![\w$])" + re.escape(old) + r"(?![\w$])"
    rows = lines(texts.join(affected.select("path"), "path", "left_semi").where(F.contains("text", F.lit(old))))
    return rows.where(F.col("line").rlike(word)).select("path", "line_no", T.preview(F.col("line"), 100).alias("before"), T.preview(F.regexp_replace("line", word, re.sub(r"([\\$])", r"\\\1", new)), 100).alias("after"))


def affected_files(symbols: DataFrame, calls: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    where = [symbols.where(F.col("name") == name).select(F.col("file").alias("path")), calls.where(F.col("callee_text") == name).select(F.col("file").alias("path")), imports.where(F.array_contains("names", name)).select(F.col("from").alias("path"))]
    return where[0].union(where[1]).union(where[2]).distinct()


def page(rows: DataFrame, order: list[str], limit: int = 50, cursor: int = 0) -> DataFrame:
    """A page of rows by offset, with ``total`` and ``next_cursor`` (null at the end); the limit is within 1 to 500."""
    limit = min(500, max(1, limit))
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(max(0, cursor)).limit(limit)
    after = F.when(F.col("total") > cursor + limit, F.lit(cursor + limit).cast("bigint"))
    return part.crossJoin(F.broadcast(total)).withColumn("next_cursor", after)  # one row
