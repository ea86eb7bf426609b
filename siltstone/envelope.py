"""What leaves the engine: one JSON line, never secrets, never whole rows."""

from __future__ import annotations

import json
import re
import sys
from typing import Any, TextIO

from .plans.costs import NeedsConfirmation, OverBudget
from .plans.guard import Refused

SECRET_KEY = re.compile(r"(?i)pass(?:word|wd|phrase)|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|(?:^|_)token$|(?:^|_)pwd$")
SECRET_TEXT = re.compile(r"(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)[^\s,;&'\"]+|(://[^/\s:@]+:)[^@\s]+(?=@)")
ROW_KEYS = frozenset({"rows", "records", "raw_rows", "sample_rows"})


class Unsafe(ValueError):
    """The payload holds what must not leave."""


def sanitise(payload: Any, path: str = "$") -> Any:
    """The payload itself, once proven free of secret-like keys and raw rows."""
    if isinstance(payload, dict):
        for k, v in payload.items():
            if SECRET_KEY.search(str(k)) and v not in (None, "", False, True):
                raise Unsafe(f"{path}.{k} looks like a secret")
            if str(k).lower() in ROW_KEYS and isinstance(v, list) and any(isinstance(x, dict | list) for x in v):
                raise Unsafe(f"{path}.{k} holds raw rows")
            sanitise(v, f"{path}.{k}")
    elif isinstance(payload, list | tuple):
        for i, v in enumerate(payload):
            sanitise(v, f"{path}[{i}]")
    return payload


def redact(text: str) -> str:
    """Error text without the credentials that it may quote."""
    return SECRET_TEXT.sub(lambda m: (m[1] or m[2]) + "***", text)


REASONS: list[tuple[type, str]] = [(NeedsConfirmation, "needs_confirmation"), (OverBudget, "over_budget"), (Refused, "refused"), (Unsafe, "unsafe_payload"), (FileNotFoundError, "not_found"), (LookupError, "not_found"), (PermissionError, "not_permitted"), (TimeoutError, "timeout"), (ValueError, "invalid_input")]


def reason_for(error: BaseException) -> str:
    return next((name for kind, name in REASONS if isinstance(error, kind)), "internal_error")


def success(command: str, data: Any, notes: list[str] | None = None) -> dict:
    return {"ok": True, "command": command, "data": sanitise(data), "notes": notes or []}


def failure(command: str, error: BaseException) -> dict:
    out = {"ok": False, "command": command, "reason": reason_for(error), "message": redact(str(error).strip() or type(error).__name__)}
    if isinstance(error, NeedsConfirmation):
        out["estimate_bytes"] = error.estimate
    return out


def emit(envelope: dict, to: TextIO | None = None) -> None:
    print(json.dumps(envelope, default=str), file=to or sys.stdout, flush=True)
