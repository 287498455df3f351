"""Blanking of comments and string contents, line by line positions kept."""

from __future__ import annotations

import re
from functools import lru_cache

from .lang import DELIMITERS

_KEEP_NEWLINES = re.compile(r"[^\n]")


@lru_cache(maxsize=64)
def _scanner(language: str) -> re.Pattern | None:
    d = DELIMITERS.get(language)
    if d is None or not (d.line or d.block or d.quotes or d.templates):
        return None
    parts = [f"(?P<b{i}>{re.escape(a)}[\\s\\S]*?(?:{re.escape(b)}|\\Z))" for i, (a, b) in enumerate(d.block)]
    parts += [f"(?P<l{i}>{re.escape(x)}[^\\n]*)" for i, x in enumerate(d.line)]
    parts += [f"(?P<t{i}>{q}(?:\\\\[\\s\\S]|[^\\\\{q}])*(?:{q}|\\Z))" for i, q in enumerate(d.templates)]
    parts += [f"(?P<q{i}>{q}(?:\\\\[^\\n]|[^\\\\{q}\\n])*(?:{q}|\\\\?(?=\\n)|\\\\?\\Z))" for i, q in enumerate(d.quotes)]
    return re.compile("|".join(parts))


def _blank(m: re.Match) -> str:
    text = m.group()
    if m.lastgroup[0] in "bl":
        return _KEEP_NEWLINES.sub(" ", text)
    closed = len(text) > 1 and text[-1] == text[0]
    return text[0] + _KEEP_NEWLINES.sub(" ", text[1:-1] if closed else text[1:]) + (text[-1] if closed else "")


def strip_code(text: str, language: str | None) -> str:
    """``text`` with comments and the contents of strings as blanks: same length, same line breaks.

    A single-line string ends with its line; template strings span lines; escapes are
    honoured; triple quotes count as block comments in Python. Unknown languages and those
    without delimiters come back unchanged.
    """
    scanner = _scanner(language) if language else None
    return scanner.sub(_blank, text) if scanner else text
