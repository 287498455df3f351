"""JSON lines of what the engine does, on standard error."""

from __future__ import annotations

import json
import sys
from datetime import datetime, timezone

LEVELS = {"debug": 10, "info": 20, "warn": 30, "error": 40, "silent": 99}
_least = ["info"]


def set_level(level: str) -> None:
    _least[0] = level if level in LEVELS else "info"


def emit(level: str, message: str, **fields) -> None:
    """One line, if the level is not under the least one; values that JSON lacks are written as text."""
    if LEVELS[level] >= LEVELS[_least[0]]:
        print(json.dumps({"ts": datetime.now(timezone.utc).isoformat(), "level": level, "msg": message, **fields}, default=str), file=sys.stderr)
