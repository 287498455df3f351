"""Parsers of captured tool output: test runs, diagnostics, repository status and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import lines

FRAMEWORK_FILES = {"jest.config.js": "jest", "jest.config.ts": "jest", "vitest.config.ts": "vitest", "vitest.config.js": "vitest", "pytest.ini": "pytest", "conftest.py": "pytest", "go.mod": "go", "Cargo.toml": "cargo", ".mocharc.json": "mocha"}
TSC = r"^(\S[^()]*)\((\d+),(\d+)\):\s+(error|warning)\s+(\w+):\s+(.+)$"
ESLINT = r"^([^:\n]+):(?:(\d+):(\d+)|\s+line\s+(\d+),\s+col\s+(\d+),)\s*:?\s*([Ee]rror|[Ww]arning)(?:\s+-)?\s+(.+?)(?:\s+[\[(]([^\])]+)[\])])?$"
MOST_FAILURES = 50


def _number(text: Column, label: str) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(\d+)\s+{label}", 1), F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(0).cast("bigint"))


def test_counts(runs: DataFrame) -> DataFrame:
    """(run_id, passed, failed, skipped): labelled numbers in any order, or marker counts for Go."""
    summary = F.coalesce(F.nullif(F.regexp_extract("output", r"(?im)^\s*Tests:\s+(.*)$", 1), F.lit("")), F.col("output"))
    go = F.col("framework") == "go"
    marks = {"passed": "--- PASS:", "failed": "--- FAIL:", "skipped": "--- SKIP:"}
    return runs.select("run_id", *[F.when(go, F.regexp_count("output", F.lit(m)).cast("bigint")).otherwise(_number(summary, label)).alias(label) for label, m in marks.items()])


def test_failures(runs: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """(run_id, name, file, message): failed tests of JSON reports, of underlined headings (with what stands under them)
    and of Go markers, at most so many a run; the file only where the report names it, messages up to 500 characters."""
    report = F.from_json("output", "testResults ARRAY<STRUCT<name STRING, assertionResults ARRAY<STRUCT<fullName STRING, title STRING, status STRING, failureMessages ARRAY<STRING>>>>>")
    none = F.lit(None).cast("string")

    def row(name: Column, file: Column, message: Column) -> Column:
        return F.struct(name.alias("name"), file.alias("file"), F.left(message, F.lit(500)).alias("message"))

    def of_file(t: Column) -> Column:
        failed = F.filter(t["assertionResults"], lambda a: a["status"] == "failed")
        return F.transform(failed, lambda a: row(F.coalesce(a["fullName"], a["title"]), t["name"], F.coalesce(F.try_element_at(a["failureMessages"], F.lit(1)), F.lit(""))))

    from_json = F.flatten(F.transform(report["testResults"], of_file))
    heading = r"(?m)^_{2,}\s+(\S.*?)\s+_{2,}\s*$"
    names = F.regexp_extract_all("output", F.lit(heading), F.lit(1))
    # the pieces between headings: what is under the first heading is the second piece
    under = F.slice(F.split("output", r"(?m)^_{2,}\s+\S.*?\s+_{2,}\s*$"), 2, 1_000_000)
    headed = F.transform(F.arrays_zip(names.alias("n"), under.alias("u")), lambda x: row(x["n"], none, F.trim(F.regexp_replace(F.coalesce(x["u"], F.lit("")), r"^\s+|\s+$", ""))))
    marked = F.transform(F.regexp_extract_all("output", F.lit(r"--- FAIL:\s+(\S+)"), F.lit(1)), lambda n: row(n, none, F.lit("")))
    return runs.select("run_id", F.explode(F.slice(F.coalesce(from_json, F.concat(headed, marked)), 1, most)).alias("f")).select("run_id", "f.name", "f.file", "f.message")


def diagnostic_counts(found: DataFrame) -> DataFrame:
    """(source, errors, warnings, files) of diagnostics."""
    return found.groupBy("source").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct("file").alias("files"))


def diagnostics(logs: DataFrame) -> DataFrame:
    """diagnostics(log_id, file, line, col, severity, source, code, message) of compiler and linter lines."""
    rows = lines(logs.withColumnRenamed("output", "text"), ("log_id",))
    g = lambda p, k: F.regexp_extract("line", p, k)
    some = lambda c: F.nullif(c, F.lit(""))
    tsc = rows.where(F.col("line").rlike(TSC)).select("log_id", F.trim(g(TSC, 1)).alias("file"), g(TSC, 2).cast("bigint").alias("l"), g(TSC, 3).cast("bigint").alias("col"), g(TSC, 4).alias("severity"), F.lit("tsc").alias("source"), g(TSC, 5).alias("code"), F.trim(g(TSC, 6)).alias("message"))
    hit = rows.where(F.col("line").rlike(ESLINT) & ~F.col("line").rlike(TSC))
    lint = hit.select(
        "log_id", F.trim(g(ESLINT, 1)).alias("file"), F.coalesce(some(g(ESLINT, 2)), some(g(ESLINT, 4))).cast("bigint").alias("l"), F.coalesce(some(g(ESLINT, 3)), some(g(ESLINT, 5))).cast("bigint").alias("col"),
        F.lower(g(ESLINT, 6)).alias("severity"), F.lit("eslint").alias("source"), some(g(ESLINT, 8)).alias("code"), F.trim(g(ESLINT, 7)).alias("message"),
    )
    return tsc.union(lint).withColumnRenamed("l", "line")


def frameworks(paths: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """The test frameworks that a tree's files and a manifest's test script name."""
    table = F.create_map(*[F.lit(x) for kv in FRAMEWORK_FILES.items() for x in kv])
    out = paths.select(F.try_element_at(table, F.element_at(F.split("path", "/"), -1)).alias("framework")).where("framework IS NOT NULL")
    if scripts is not None:
        names = F.array(*[F.lit(x) for x in ("jest", "mocha", "pytest", "vitest")])
        out = out.union(scripts.select(F.explode(F.filter(names, lambda n: F.contains("script", n)))))
    return out.distinct()


def repository_state(status: DataFrame) -> DataFrame:
    """(repo_id, branch, detached, staged, modified, untracked) of porcelain v2 status texts."""
    rows = lines(status.withColumnRenamed("output", "text"), ("repo_id",))
    head = F.regexp_extract("line", r"^# branch\.head (.+)$", 1)
    code = F.regexp_extract("line", r"^[12] (..)", 1)
    return rows.groupBy("repo_id").agg(
        F.max(F.when((head != "") & (head != "(detached)"), head)).alias("branch"), F.coalesce(F.bool_or(head == "(detached)"), F.lit(False)).alias("detached"),
        F.count_if(code.rlike(r"^[^.]")).alias("staged"), F.count_if(code.rlike(r"^.[^.]") | F.startswith("line", F.lit("u "))).alias("modified"), F.count_if(F.startswith("line", F.lit("? "))).alias("untracked"),
    )


def diff_totals(numstat: DataFrame) -> DataFrame:
    """(repo_id, files, insertions, deletions, binary) of numstat texts; binary files count as files only."""
    rows = lines(numstat.withColumnRenamed("output", "text"), ("repo_id",)).where("line <> ''").select("repo_id", F.split("line", "\t").alias("p"))
    number = lambda k: F.coalesce(F.sum(F.expr(f"try_cast(p[{k}] AS bigint)")), F.lit(0).cast("bigint"))
    return rows.groupBy("repo_id").agg(F.count("*").alias("files"), number(0).alias("insertions"), number(1).alias("deletions"), F.count_if(F.expr("p[0] = '-'")).alias("binary"))


def fan_out(items: DataFrame, fn, result: str = "string", partitions: int | None = None) -> DataFrame:
    """(index, result, error) of a pure function over (index, item), one row's failure its own."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for index, item in zip(batch["index"], batch["item"], strict=True):
                try:
                    rows.append((index, fn(item), None))
                except Exception as e:  # noqa: BLE001 - the contract is to report it in the row
                    rows.append((index, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["index", "result", "error"])

    spread = items.repartition(partitions) if partitions else items
    return spread.select("index", "item").mapInPandas(run, f"index bigint, result {result}, error string")
