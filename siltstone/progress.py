"""Counters on stderr, at most a few a second."""

from __future__ import annotations

import sys
import time
from typing import TextIO


class Progress:
    def __init__(self, total: int, what: str, to: TextIO | None = None, every: float = 0.5):
        self.total, self.what, self.to, self.every = total, what, to or sys.stderr, every
        self.done, self._said = 0, 0.0

    def step(self, name: str = "") -> None:
        self.done += 1
        now = time.monotonic()
        if self.done == self.total or now - self._said >= self.every:
            self._said = now
            print(f"{self.what}: {self.done} of {self.total} {name}".rstrip(), file=self.to, flush=True)
