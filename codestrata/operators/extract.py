"""Symbols, imports and calls of source texts, and their resolution into edges.

Symbol extraction folds over a file's lines with a scope, so it is one Arrow UDF a file;
all the rest is native: imports and calls are regular expressions over exploded lines,
and resolution is joins within a file or against the set of files.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lang import FAMILIES, FAMILY_OF, KEYWORDS, SCOPE_KINDS, Imports, Rule
from ..functions.strip import strip_code
from ..plans.shared import is_table, materialize
from ..sources.files import lines

END_LINES = 500
IMPORT_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "rb", "php", "c", "h", "json")
SYMBOL = "id string, name string, qualname string, kind string, start_line bigint, end_line bigint, exported boolean, parent string, ord bigint"
CALL_FORM = r"\b([A-Za-z_$][\w$]*)\s*\("


@lru_cache(maxsize=64)
def _compiled(language: str) -> tuple[tuple[Rule, re.Pattern], ...]:
    family = FAMILY_OF.get(language)
    return tuple((r, re.compile(r.pattern, re.ASCII)) for r in family.rules) if family else ()


def _is_name(name: str) -> bool:
    return 0 < len(name) <= 200 and name not in KEYWORDS


def _end_line(rows: list[str], at: int, language: str) -> int:
    if language == "python":
        indent = len(rows[at]) - len(rows[at].lstrip())
        last = at
        for i in range(at + 1, len(rows)):
            if rows[i].strip():
                if len(rows[i]) - len(rows[i].lstrip()) <= indent:
                    break
                last = i
        return last + 1
    depth, opened = 0, False
    for i in range(at, min(len(rows), at + END_LINES)):
        for c in rows[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i + 1
            elif c == ";" and not opened:
                return i + 1
    return at + 1


def symbols_of(path: str, stripped: str, language: str) -> list[tuple]:
    """The declarations of a stripped text, in order; a qualified name counts once."""
    rules = _compiled(language)
    rows = stripped.split("\n")
    out: list[tuple] = []
    seen: set[str] = set()
    scope: str | None = None
    scope_depth, depth = -1, 0

    def add(rule: Rule, name: str, qualname: str, i: int, parent: str | None) -> None:
        ident = f"{path}::{qualname}"
        if ident not in seen:
            seen.add(ident)
            out.append((ident, name, qualname, rule.kind, i + 1, _end_line(rows, i, language), bool(rule.export) and rule.export in rows[i], parent, len(out)))

    for i, row in enumerate(rows):
        opened = False
        for rule, form in rules:
            m = form.match(row) if rule.kind in SCOPE_KINDS else None
            if m and _is_name(m.group(1)):
                scope, scope_depth, opened = m.group(1), depth, True
                add(rule, scope, scope, i, None)
                break
        for rule, form in rules:
            if (rule.kind in SCOPE_KINDS and opened) or (rule.in_class and not scope):
                continue
            m = form.match(row)
            if m and _is_name(m.group(1)):
                add(rule, m.group(1), f"{scope}.{m.group(1)}" if rule.in_class else m.group(1), i, scope)
        depth += row.count("{") - row.count("}")
        if scope and depth <= scope_depth:
            scope, scope_depth = None, -1
    return out


def parse(texts: DataFrame) -> DataFrame:
    """``texts(path, text, language)`` with ``stripped`` and ``symbols``; one Arrow pass."""

    @F.pandas_udf(f"stripped string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>")
    def parsed(path: pd.Series, text: pd.Series, language: pd.Series) -> pd.DataFrame:
        out = []
        names = [f.split()[0] for f in SYMBOL.split(", ")]
        for p, t, x in zip(path, text, language, strict=True):
            if t is None or x not in FAMILY_OF:
                out.append((t, []))
                continue
            s = strip_code(t, x)
            out.append((s, [dict(zip(names, r, strict=True)) for r in symbols_of(p, s, x)]))
        return pd.DataFrame(out, columns=["stripped", "symbols"])

    return texts.withColumn("__p", parsed("path", "text", "language")).select(*texts.columns, "__p.stripped", "__p.symbols")


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file"), F.explode("symbols").alias("s")).select("s.id", "s.name", "s.qualname", "s.kind", "file", "s.start_line", "s.end_line", "s.exported", "s.parent", "s.ord")


def _imported(rule: Imports, rank: int) -> Column:
    """The imports of a line that a rule finds, as an array of structs."""
    names = F.regexp_extract_all("__line", F.lit(rule.pattern), F.lit(2)) if rule.names else None

    def one(spec: Column, at: Column) -> Column:
        parts = F.array().cast("array<string>")
        if names is not None:
            parts = F.filter(F.transform(F.split(F.element_at(names, at + 1), ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")), lambda x: x != "")
        return F.struct(F.trim(spec).alias("specifier"), parts.alias("names"), F.lit(rule.type_only).alias("is_type_only"), F.lit(rule.dynamic).alias("is_dynamic"), F.lit(rank).alias("k"))

    return F.transform(F.regexp_extract_all("__line", F.lit(rule.pattern), F.lit(1)), one)


def imports(texts: DataFrame) -> DataFrame:
    """imports(from, specifier, names, is_type_only, is_dynamic, line, ord), from the unstripped text.

    Names are those of ``from m import a, b as c``. Each (file, line, specifier) counts once.
    """
    found = []
    for family in FAMILIES:
        here = F.col("language").isin(*family.languages)
        for k, rule in enumerate(family.imports):
            every = _imported(rule, k)
            found.append(F.when(here, every).otherwise(F.slice(every, 1, 0)))
    rows = lines(texts.where(F.col("language").isin(*sorted(FAMILY_OF)) & F.col("text").isNotNull()), ("path", "language")).withColumnRenamed("line", "__line")
    # few lines import anything: a plain test first spares the rest the patterns
    rows = rows.where(F.col("__line").rlike(r"import|require|export|\buse\b|using|include|from|source|^\s*\.\s"))
    every = rows.select(F.col("path").alias("from"), F.col("line_no").alias("line"), F.explode(F.concat(*found)).alias("i")).where("i.specifier <> ''")
    return every.select("from", "i.specifier", "i.names", "i.is_type_only", "i.is_dynamic", "line", (F.col("line") * 100 + F.col("i.k")).alias("ord")).dropDuplicates(["from", "line", "specifier"])


def resolve_imports(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with ``to``: the file a relative specifier means, else null.

    Candidates are the specifier as it stands, with each extension in order, and as a
    directory with an index file; the first that exists wins.
    """
    directory = F.regexp_replace("from", "[^/]*$", "")
    bare = F.regexp_replace(T.normalise(F.when(F.startswith("specifier", F.lit("/")), F.col("specifier")).otherwise(F.concat(directory, F.col("specifier")))), r"^/", "")
    stem = F.regexp_replace(bare, r"\.(js|jsx|mjs|cjs)$", "")
    options = F.array(bare, *[F.concat(stem, F.lit("." + e)) for e in IMPORT_EXTENSIONS], *[F.concat(stem, F.lit("/index." + e)) for e in IMPORT_EXTENSIONS])
    local = F.col("specifier").rlike(r"^[./]")
    keyed = imports_.withColumn("__at", F.struct("from", "line", "specifier"))
    tried = keyed.where(local).select("__at", F.posexplode(options).alias("prio", "candidate"))
    hit = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("__at").agg(F.min_by("candidate", "prio").alias("to"))
    return keyed.join(hit, "__at", "left").drop("__at").select("from", "specifier", "to", "names", "is_type_only", "is_dynamic", "line", "ord")


def settled_parse(parsed: DataFrame) -> DataFrame:
    """A parse that is read several times, written once; one that is a table already stays."""
    kept = parsed.select("path", "stripped", "symbols")
    return kept if is_table(parsed) else materialize(kept, "parsed")


def calls(parsed: DataFrame) -> DataFrame:
    """calls(file, line, callee_text, ord, caller_id, caller_name, callee_id, dynamic).

    A call is a name before a parenthesis that is no keyword and not declared on its line;
    its caller is the last function whose span has the line, its callee the last symbol of
    that name in the file.
    """
    parsed = settled_parse(parsed)
    sym = symbols(parsed)
    rows = lines(parsed.where("stripped IS NOT NULL").select("path", F.col("stripped").alias("text")))
    found = rows.select(F.col("path").alias("file"), F.col("line_no").alias("line"), F.posexplode(F.regexp_extract_all("line", F.lit(CALL_FORM), F.lit(1))).alias("pos", "callee_text"))
    found = found.where(~F.col("callee_text").isin(*sorted(KEYWORDS)))
    declared = sym.select("file", F.col("start_line").alias("line"), F.col("name").alias("callee_text")).distinct()
    found = found.join(declared, ["file", "line", "callee_text"], "left_anti").withColumn("ord", F.col("line") * 10_000 + F.col("pos"))
    spans = sym.where("kind IN ('function', 'method')").select("file", "start_line", "end_line", "ord", F.struct("id", "qualname").alias("c"))
    caller = attribute_lines(found, spans, "file", "line", "start_line", "end_line", "ord", "c")
    target = sym.groupBy("file", F.col("name").alias("callee_text")).agg(F.max_by("id", "ord").alias("callee_id"))
    out = caller.join(target, ["file", "callee_text"], "left")
    return out.select(F.col("c.id").alias("caller_id"), F.coalesce("c.qualname", F.lit("<module>")).alias("caller_name"), "file", "line", "callee_text", "callee_id", F.col("callee_id").isNull().alias("dynamic"), "ord")


def attribute_lines(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, order: str, value: str) -> DataFrame:
    """For each point the value of the last span (by ``order``) around it within its key, null where none.

    Positions are whole numbers. A span is cut into aligned blocks of powers of two, two of a size at most,
    and only the last span of a block is kept; a place looks up the one block of each size around it.
    So work grows with points and spans, and not with their pairs. Of equal orders the greatest value counts.
    """
    start, after = F.col(low).cast("bigint"), F.col(high).cast("bigint") + 1
    some = spans.where(F.col(order).isNotNull() & F.col(key).isNotNull() & (F.col(low) <= F.col(high))).select(F.col(key).alias("__k"), start.alias("__a"), after.alias("__b"), F.struct(F.col(order), F.col(value)).alias("__v"))
    sizes = lambda length: F.sequence(F.lit(0), F.ceil(F.log2(length)).cast("int"))
    sized = some.select("__k", "__a", "__b", "__v", F.explode(sizes(F.col("__b") - F.col("__a"))).alias("__n"))
    first, end = F.expr("-shiftright(-__a, __n)"), F.expr("shiftright(__b, __n)")
    cut = sized.select("__k", "__n", "__v", first.alias("f"), end.alias("e")).where("f < e")
    ends = F.array_compact(F.array(F.when(F.expr("f & 1 = 1"), F.col("f")), F.when(F.expr("e & 1 = 1"), F.col("e") - 1)))
    blocks = cut.select("__k", "__n", "__v", F.explode(ends).alias("__i")).groupBy("__k", "__n", "__i").agg(F.max("__v").alias("__v"))
    # one row: the longest span
    longest = some.agg(F.max(F.col("__b") - F.col("__a")).alias("__most"))
    places = points.select(F.col(key).alias("__k"), F.col(at).cast("bigint").alias("__at")).where("__k IS NOT NULL AND __at IS NOT NULL").distinct()
    asked = places.crossJoin(F.broadcast(longest)).select("__k", "__at", F.explode(sizes(F.col("__most"))).alias("__n"))
    found = asked.withColumn("__i", F.expr("shiftright(__at, __n)")).join(blocks, ["__k", "__n", "__i"]).groupBy("__k", "__at").agg(F.max("__v").alias("__v"))
    out = points.distinct().join(found, (F.col(key) == F.col("__k")) & (F.col(at) == F.col("__at")), "left")
    return out.select(*points.columns, F.col("__v")[value].alias(value))


def index_stats(texts: DataFrame, parsed: DataFrame, imports_: DataFrame, calls_: DataFrame) -> DataFrame:
    """One row: files indexed and skipped, symbols, edges (imports and calls)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    known = texts.agg(F.count_if(F.col("language").isNotNull() & F.col("text").isNotNull()).alias("indexed"), F.count_if(F.col("language").isNull() | F.col("text").isNull()).alias("skipped"))
    return known.crossJoin(count(symbols(parsed), "symbols")).crossJoin(count(imports_, "i")).crossJoin(count(calls_, "c")).select("indexed", "skipped", "symbols", (F.col("i") + F.col("c")).alias("edges"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files to be indexed anew: those not in the index with the same size and time."""
    return now.join(before.select("path", "size_bytes", "mtime"), ["path", "size_bytes", "mtime"], "left_anti")


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_$]") & (F.length(name) <= 200) & ~name.isin(*sorted(KEYWORDS))
