"""The engine's error: a code, a message, a hint."""

from __future__ import annotations

import errno

#: Every code there is; those of a family share its first word.
CODES = frozenset(
    f"{family}_{rest}"
    for family, names in {
        "AMBIGUOUS": "SYMBOL", "COMMAND": "DANGEROUS NOT_FOUND TIMEOUT", "DIRTY": "INDEX", "EXEC": "CAP_REACHED", "FILE": "BINARY ENCODING TOO_LARGE", "GIT": "STATE_UNSUPPORTED UNAVAILABLE",
        "INTERNAL": "ERROR", "MEMORY": "CONFLICT", "PARSER": "UNAVAILABLE", "PATH": "INVALID NOT_FOUND OUTSIDE_WORKSPACE SENSITIVE", "RATE": "LIMITED", "SNAPSHOT": "CAP NOT_FOUND", "SYMBOL": "NOT_FOUND", "TASK": "CYCLE NOT_FOUND STATE",
    }.items() for rest in names.split()
) | {"VALIDATION"}
OS_CODES = {errno.ENOENT: "PATH_NOT_FOUND", errno.EACCES: "PATH_INVALID", errno.EPERM: "PATH_INVALID", errno.ENOSPC: "INTERNAL_ERROR"}


class EngineError(Exception):
    def __init__(self, code: str, message: str, hint: str | None = None, **details):
        super().__init__(message)
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        self.code, self.hint, self.details = code, hint, details

    def as_dict(self) -> dict:
        return {k: v for k, v in {"code": self.code, "message": str(self), "hint": self.hint, "details": self.details}.items() if v}


def as_error(e: BaseException, fallback: str = "INTERNAL_ERROR") -> EngineError:
    """An error of this engine as it is; an error of the system by its number; any other as the fallback."""
    if isinstance(e, EngineError):
        return e
    return EngineError(OS_CODES.get(getattr(e, "errno", None), fallback), str(e) or type(e).__name__)


def is_internal(e: BaseException) -> bool:
    """Whether an error is none that a caller could act on."""
    return not isinstance(e, EngineError) or e.code == "INTERNAL_ERROR"


def guard_sensitive(path: str, sensitive: bool, allow: bool = False, write: bool = False) -> None:
    """Raise for a sensitive path: always when writing, when reading unless allowed."""
    if sensitive and (write or not allow):
        raise EngineError("PATH_SENSITIVE", f"{path} is sensitive", "sensitive files are never written, and read only on request")
