import errno
import json

import pytest
from pyspark.sql import functions as F

from codestrata import log
from codestrata.errors import CODES, EngineError, as_error, is_internal
from codestrata.functions import text as T
from codestrata.functions.lang import detect_language
from codestrata.operators import extract, graph, index, retrieve, security, stores


def test_codes():
    assert len(CODES) == 26 and {"VALIDATION", "TASK_CYCLE", "SNAPSHOT_CAP", "INTERNAL_ERROR"} <= CODES
    with pytest.raises(ValueError):
        EngineError("NO_SUCH_CODE", "x")
    assert as_error(PermissionError(errno.EACCES, "x")).code == as_error(OSError(errno.EPERM, "x")).code == "PATH_INVALID"
    assert as_error(OSError(errno.ENOSPC, "x")).code == "INTERNAL_ERROR"
    assert is_internal(ValueError("x")) and not is_internal(EngineError("TASK_STATE", "x"))


def test_log_lines(capsys):
    log.set_level("warn")
    log.emit("info", "left out")
    log.emit("error", "kept", files=3, at={1})
    log.set_level("no such level")
    log.emit("info", "info again")
    rows = [json.loads(x) for x in capsys.readouterr().err.splitlines()]
    assert [(r["level"], r["msg"]) for r in rows] == [("error", "kept"), ("info", "info again")] and rows[0]["files"] == 3 and rows[0]["ts"]


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "path string, text string").withColumn("language", detect_language(F.col("path")))


def test_search_patterns(spark):
    texts = texts_of(spark, [("a", "x\nfoo bar\nbar"), ("b", "foo\nBAR foo\n"), ("c", None)])
    found = lambda p, **o: sorted((r["path"], r["line_no"]) for r in retrieve.search(texts, p, **o).collect())
    assert found(r"\Afoo") == [("a", 2), ("b", 1)] and found(r"foo\z") == [("b", 1), ("b", 2)]
    assert found(r"(?<!x)^bar$") == [("a", 3)] and found("[") == [] and found("[", literal=True) == []
    assert found("^bar") == [("a", 3), ("b", 2)] and found(r"(?!x)foo$") == [("b", 1), ("b", 2)]


def test_rename_to_names_with_marks(spark):
    texts = texts_of(spark, [("a.js", "old(1); older; $old; old")])
    affected = texts.select("path")
    assert retrieve.rename_preview(texts, affected, "old", "$n").first()["after"] == "$n(1); older; $old; $n"
    assert retrieve.rename_preview(texts, affected, "old", "a\\1").first()["after"] == "a\\1(1); older; $old; a\\1"


def test_index_is_kept_by_version_and_root(spark, tmp_path):
    rows = texts_of(spark, [("a.py", "def f():\n    g()\n"), ("b.txtx", "x"), ("c.py", "")]).withColumn("size_bytes", F.lit(1).cast("bigint")).withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    built = index.build(rows)
    path = f"file://{tmp_path}/index"
    assert index.load(spark, path, "r") is None
    index.save(built, path, "r")
    index.save(built, path, "r")
    assert index.load(spark, path, "other") is None
    back = index.load(spark, path, "r")
    assert back.columns == built.columns and sorted(r["path"] for r in back.collect()) == ["a.py", "c.py"]
    assert index.stats(back).first().asDict() == {"files": 2, "indexed": 2, "skipped": 0, "symbols": 1, "edges": 1}
    assert [r["callee_text"] for r in index.calls(back).collect()] == ["g"]
    assert index.refresh(rows, back, force=True).count() == 2 and index.refresh(rows, None).count() == 2
    assert index.build(rows.limit(0)).count() == 0 and index.stats(index.build(rows.limit(0))).first()["edges"] == 0
    with pytest.raises(EngineError):
        index.call_walk(back, "f", "sideways")
    with pytest.raises(EngineError):
        index.impact(back, "f", "line")
    assert index.call_walk(back, "no such name").count() == 0 and index.file_symbols(back, "zz").count() == 0
    assert index.server_status(None, rows, "r").first()["index_ready"] is False
    (tmp_path / "index").rename(tmp_path / "gone")
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "x.parquet").write_text("broken")
    assert index.load(spark, path, "r") is None


def test_a_store_that_is_not_there_is_empty(spark, tmp_path):
    assert stores.load(spark, f"file://{tmp_path}/none", "a int").count() == 0


def test_snapshot_stops_at_the_cap_like_a_plain_running_sum(spark):
    sizes = [(f"{'abcdefgh'[i % 8]}{i // 8}/f{i}", "t", (i * 37) % 11) for i in range(200)]
    frame = spark.createDataFrame(sizes, "path string, content string, size_bytes int")
    for cap in (1, 50, 333, 10_000):
        want, total = [], 0
        for path, _, size in sorted(sizes):
            if total >= cap:
                break
            want.append(path)
            total += size
        assert sorted(r["path"] for r in stores.snapshot(frame, "s", F.lit("2024-01-01").cast("timestamp"), cap).collect()) == want


def test_entropy_words_beside_known_secrets(spark):
    word = "aB3xK9mQ2vT7pL5wZ8cR4nD6"
    texts = texts_of(spark, [("a", f"use {word} here\ntoken = \"{'0123456789abcdef' * 2}\"\nplain words only aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")])
    kinds = sorted((r["line"], r["kind"]) for r in security.scan_secrets(texts, entropy_from=3.5).collect())
    assert kinds == [(1, "high_entropy"), (2, "assigned_secret")]


@pytest.mark.parametrize("name", ["secret_scan", "secret_redact", "high_entropy_words"])
def test_secrets_named_in_capitals_are_as_the_sql_has_them(spark, tmp_path, name):
    import duckdb

    from codestrata import catalog

    value = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    texts = [f'one token = "{value}" here', f'ONE\nTOKEN = "{value.upper()}"!! HERE', f'a token = "{value}" and\ntwo {value[::-1]}']
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES[name]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want and want


def test_secrets_named_in_capitals_are_found_by_default(spark):
    texts = texts_of(spark, [("a", 'TOKEN = "9233A8ECF7C5B09FE594"')])
    assert [r["kind"] for r in security.scan_secrets(texts).collect()] == ["assigned_secret"]
    assert texts.select(security.redact(F.col("text"))).first()[0] == 'TOKEN = "[REDACTED]"'


def test_ranks_equal_a_plain_iteration(spark):
    edges = {(1, 2), (2, 3), (3, 1), (4, 2), (4, 5), (6, 5), (7, 7), (5, 8)}
    ids = range(1, 12)
    nodes, links = graph.build(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"), spark.createDataFrame([(i,) for i in ids], "id bigint"))
    for rounds in (1, 4, 9):
        score = {i: 1 / 11 for i in ids}
        for _ in range(rounds):
            out = {i: sum(a == i for a, _ in edges) for i in ids}
            lost = sum(score[i] for i in ids if not out[i])
            score = {i: 0.15 / 11 + 0.85 * (sum(score[a] / out[a] for a, b in edges if b == i) + lost / 11) for i in ids}
        got = {r["id"]: r["score"] for r in graph.pagerank(nodes, links, rounds, tolerance=0.0).collect()}
        assert got == pytest.approx(score, abs=1e-12)


def test_map_outlines_only_files_that_can_be_in_it(spark):
    ranks = spark.range(500).selectExpr("concat('d/', id, IF(id % 100 = 7, '/', '')) AS id", "1.0D / (1 + id % 250) AS score")
    symbols = spark.range(500).selectExpr("concat('d/', id) AS file", "1 AS ord", "true AS exported", "'function' AS kind", "concat('f', id) AS qualname")
    asked = []

    def of(paths):
        asked.append(paths.count())
        return symbols.join(paths.withColumnRenamed("path", "file"), "file", "left_semi")

    got = sorted((r["position"], r["path"], r["running_tokens"]) for r in retrieve.repo_map(ranks, of, 30).collect())
    rows = sorted((-r["score"], r["id"]) for r in ranks.collect())
    want, total = [], 0
    for i, (_, path) in enumerate(rows):
        name = path.split("/")[-1]
        entry = f"{name}  +Ff{name}" if name else ""
        total += -(-len(entry) // 4)
        want += [(i + 1, path, total)] if total <= 30 or i == 0 else []
    assert got == want
    assert asked == [31 + 5]


def test_context_pack_extracts_imports_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def target(to):
        seen.add(1)
        return to

    texts = texts_of(spark, [("a.ts", "function f() {\n}\n"), ("b.ts", ""), ("c.ts", "")])
    links = spark.createDataFrame([("b.ts", "a.ts"), ("c.ts", "b.ts"), ("c.ts", "d.ts")], "from string, to string")
    imports = links.withColumn("to", F.udf(target, "string").asNondeterministic()("to"))
    out = retrieve.context_pack(texts, imports, extract.symbols(extract.parse(texts)), texts.where("path = 'a.ts'").select("path"), iterations=5).collect()
    assert [(r["path"], r["all_symbols"]) for r in out] == [("a.ts", "function f"), ("b.ts", None)]
    assert seen.value == 3


def test_declarations_of_several_languages(spark):
    rows = texts_of(spark, [("a.sh", "function run {\n  x\n}\ngo-on () {\n y\n}\necho f()\n"), ("b.py", "class A[T](B):\n    async def m[T](self):\n        pass\nfrom . import x\nfrom .a.b import (c, d)\nimport os, sys\n"), ("c.ts", "class C {\n  static async *gen<T>(a: (x: number) => void): T {\n  }\n  #hidden() {\n  }\n}\n")])
    got = {(r["file"], r["kind"], r["name"]) for r in extract.symbols(extract.parse(rows)).collect()}
    assert got == {("a.sh", "function", "run"), ("a.sh", "function", "go-on"), ("b.py", "class", "A"), ("b.py", "function", "m"), ("c.ts", "class", "C"), ("c.ts", "method", "gen"), ("c.ts", "method", "hidden")}
    assert {(r["specifier"], tuple(r["names"])) for r in extract.imports(rows).collect()} == {(".", ("x",)), (".a.b", ("c", "d")), ("os", ())}


def test_null_texts(spark):
    row = spark.createDataFrame([(None,)], "t string").select(T.line_ending(F.col("t")), T.shorten(F.col("t")), T.fold_path(F.col("t"))).first()
    assert tuple(row) == (None, None, None)
