"""Scans: file trees, decoded texts, lines, ignore rules, manifests, repository text output."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lang import detect_language

HEAVY_DIRECTORIES = tuple(
    sorted("__pycache__ build coverage dist env node_modules target vendor venv .cache .eggs .git .gradle .hg .idea .mypy_cache .next .nuxt .nyc_output .parcel-cache .pytest_cache .ruff_cache .sass-cache .svn .tox .turbo .venv .vscode".split())
)
MANIFESTS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile", "composer.json")
SNIFFED = 8192
TEXT_BYTES = 4 << 20


def files(spark: SparkSession, root: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """files(path, content, size_bytes, mtime, language) of a tree, paths relative to ``root``.

    Heavy directories are left out; with ``max_files`` the first by path are kept.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:/*", "/"), "^" + re.escape(base) + "/?", "")
    out = reader.load(root).select(path.alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    heavy = "|".join(re.escape(d) for d in HEAVY_DIRECTORIES)
    out = out.where(~F.col("path").rlike(f"(^|/)({heavy})/")).withColumn("language", detect_language(F.col("path")))
    return out.orderBy("path").limit(max_files) if max_files is not None else out


def is_binary(content) -> F.Column:
    return F.position(F.lit(b"\0"), F.substring(content, 1, SNIFFED)) > 0


def head_hash(content, size) -> F.Column:
    return F.concat(F.sha1(F.substring(content, 1, 4096)), F.lit(":"), size.cast("string"))


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """(text, encoding) by byte order mark, UTF-8 else; never fails."""
    for mark, name in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name
    return raw.decode("utf-8", "replace"), "utf-8"


def texts(files_: DataFrame, max_bytes: int = TEXT_BYTES) -> DataFrame:
    """texts(path, language, text, encoding, is_binary, truncated, lines, had_trailing_newline, line_ending).

    Binary files have null texts. Invalid bytes decode to U+FFFD, which no native function
    does, so decoding is the one Arrow step.
    """

    @F.pandas_udf("text string, encoding string")
    def decoded(parts: pd.Series) -> pd.DataFrame:
        got = [(None, None) if p is None else decode_bytes(bytes(p)) for p in parts]
        return pd.DataFrame(got, columns=["text", "encoding"])

    base = files_.select("path", "language", is_binary(F.col("content")).alias("is_binary"), (F.col("size_bytes") > max_bytes).alias("truncated"), F.substring("content", 1, max_bytes).alias("c"))
    d = base.withColumn("d", decoded(F.when(~F.col("is_binary"), F.col("c")))).select("path", "language", "d.text", "d.encoding", "is_binary", "truncated")
    return d.withColumn("lines", T.line_count(F.col("text"))).withColumn("had_trailing_newline", F.endswith("text", F.lit("\n"))).withColumn("line_ending", T.line_ending(F.col("text")))


def lines(texts_: DataFrame, keep: Iterable[str] = ("path",), text_col: str = "text") -> DataFrame:
    """One row for each line, numbered from 1; a text that ends in a line break has an empty last line."""
    return texts_.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select(*keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def ignore_rules(text: str, base: str = "") -> list[tuple[str, bool, bool]]:
    """(pattern, negated, directories only) of an ignore file's lines, in order."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule
        only_dirs = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        pattern = T.ignore_glob(rule.lstrip("/"), anchored)
        if base:
            pattern = "^" + re.escape(base.rstrip("/")) + "/" + (pattern[1:] if anchored else pattern)
        out.append((pattern, negated, only_dirs))
    return out


def ignored(paths: DataFrame, rules: list[tuple[str, bool, bool]], path_col: str = "path") -> DataFrame:
    """``paths`` with ``ignored``: the last rule that matches decides.

    A rule for directories matches what lies beneath them. The rules are an ordered
    expression evaluated per path, not a join: they are few and known when planning.
    """
    verdict = F.lit(False)
    for pattern, negated, only_dirs in rules:
        if only_dirs:
            pattern = pattern.replace("(?:/.*)?$", "/.*$")
        verdict = F.when(F.col(path_col).rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return paths.withColumn("ignored", verdict)


def dependencies(manifests: DataFrame, text_col: str = "text") -> DataFrame:
    """(path, section, name, version) of JSON manifests; unreadable ones give no rows."""
    parsed = F.from_json(text_col, "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>")
    one = manifests.select("path", parsed.alias("m"))
    sections = [one.select("path", F.lit(s).alias("section"), F.explode(f"m.{s}").alias("name", "version")) for s in ("dependencies", "devDependencies")]
    return sections[0].unionByName(sections[1])


def entry_points(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """The manifests at the root of a tree."""
    return paths.where(F.col(path_col).isin(*MANIFESTS)).select(F.col(path_col).alias("path"))


def file_rows(rows: Iterator[tuple[str, str]], spark: SparkSession) -> DataFrame:
    """texts(path, text, language) from (path, text) pairs."""
    return spark.createDataFrame(list(rows), "path string, text string").withColumn("language", detect_language(F.col("path")))
