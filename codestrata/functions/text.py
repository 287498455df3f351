"""Scalar text functions, as native expressions; patterns built at plan time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSITIVE_NAMES = (".dockercfg", ".git-credentials", ".netrc", ".npmrc", ".pypirc", "authorized_keys", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa", "known_hosts")
SENSITIVE_FORM = r"(?i)^\.env(\..*)?$|\.(jks|key|keystore|p12|pem|pfx|htpasswd)$|(^|[._-])(credentials?|secrets?)([._-]|$)|service-?account.*\.json$"
DANGEROUS_FORM = r"(^|\s)rm\s+-(r|rf|fr|R|Rf)\s+/(\s|$)|mkfs|:\(\)\s*\{\s*:|dd\s+.*of=/dev/|git\s+push\s+(.*\s)?(--force|-f)(\s|$)"
INTERACTIVE = ("not a terminal", "is not a tty")
TEST_MARKS = ("test", "spec", "__test")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("bigint")


def preview(text: Column, n: int = 200) -> Column:
    """Trimmed of all white space, cut to ``n`` characters."""
    return F.substring(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 1, n)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def head_tail(text: Column, budget: int, marker: str = "\n...[truncated]...\n") -> Column:
    """The text if it fits the budget, else its first and last halves around a marker."""
    half = budget // 2
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half))))


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def shorten(text: Column, most: int = 200) -> Column:
    """A text cut to a number of characters, with the number of those left out."""
    rest = F.concat(F.lit("…[+"), (F.length(text) - most).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), rest))


def fold_path(path: Column, case_sensitive: bool = True) -> Column:
    """A path by which paths are compared: with slashes only, and in lower case where the file system ignores case."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return path if case_sensitive else F.lower(path)


def pad_end(text: Column, n: int) -> Column:
    """Padded with blanks to ``n``, never cut."""
    return F.rpad(text, F.greatest(F.lit(n), F.length(text)), F.lit(" "))


def line_ending(text: Column) -> Column:
    """``crlf``, ``lf``, ``mixed`` or ``none``; null for a null text."""
    crlf, lf = F.regexp_count(text, F.lit("\r\n")), F.regexp_count(text, F.lit("\n"))
    return F.when(lf == 0, "none").when(crlf == 0, "lf").when(crlf == lf, "crlf").when(lf > 0, "mixed")


def line_count(text: Column) -> Column:
    """Lines of a text; a last line counts with or without a line break, an empty text has none."""
    return (F.regexp_count(text, F.lit("\n")) + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("bigint")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_sensitive(path: Column) -> Column:
    base = basename(path)
    return F.lower(base).isin(*SENSITIVE_NAMES) | base.rlike(SENSITIVE_FORM)


def is_dangerous(command: Column) -> Column:
    return command.rlike(DANGEROUS_FORM)


def looks_interactive(output: Column) -> Column:
    found = F.lit(False)
    for mark in INTERACTIVE:
        found = found | F.contains(output, F.lit(mark))
    return found


def is_test_path(path: Column) -> Column:
    found = F.lit(False)
    for mark in TEST_MARKS:
        found = found | F.contains(path, F.lit(mark))
    return found


def inside(path: Column, root: str) -> Column:
    """Whether a normalised path is a root or lies under it; paths with NUL never do."""
    root = root.rstrip("/")
    return ~F.contains(path, F.lit("\0")) & ((path == root) | F.startswith(path, F.lit(root + "/")))


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/?", "")


def normalise(path: Column) -> Column:
    """A path without empty and ``.`` segments, ``..`` resolved."""
    fold = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(fold, "/"))


def search_glob(glob: str) -> str:
    """A pattern for whole paths: ``*`` and ``?`` stay within a segment."""
    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob) + "$"


def ignore_glob(glob: str, anchored: bool) -> str:
    """A pattern of an ignore rule: ``**`` crosses segments, and the match ends with a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + "(?:/.*)?$"


def substitute(template: str, item: Column, mark: str = "$ITEM") -> Column:
    """Words of a command template with the mark replaced."""
    return F.split(F.replace(F.lit(template), F.lit(mark), item), r"\s+")
