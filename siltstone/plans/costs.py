"""What scans may cost, in bytes read: estimates before, a ceiling and a confirmation, a reservation while running."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from ..sources.store import Store, spent
from .guard import Refused


class OverBudget(Refused):
    """The estimate exceeds the ceiling."""


class NeedsConfirmation(Refused):
    """The scan has a price that nobody has agreed to yet; ``estimate`` says which."""

    def __init__(self, message: str, estimate: int):
        super().__init__(message)
        self.estimate = estimate


@dataclass
class Gate:
    """paradigm "free": scans cost nothing and pass; "billed": each needs a ceiling and a confirmation."""

    store: Store
    paradigm: str = "free"
    ceiling: int | None = None
    confirmed: int | None = None  # bytes that the caller has agreed to
    connector: str = "spark"
    reserved: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def used(self) -> int:
        return int(spent(self.store, connector=self.connector)) + self.reserved

    def preflight(self, estimate: int | None) -> None:
        """Over the ceiling: refused.  Free: passes.  Billed: no ceiling or no confirmation is refused, and so is an unknown estimate."""
        if estimate is None:
            if self.paradigm == "free" and self.ceiling is None:
                return
            raise OverBudget("nothing is known about how much the scan reads")
        if self.ceiling is not None and self.used() + estimate > self.ceiling:
            raise OverBudget(f"the scan reads up to {estimate} bytes; {max(0, self.ceiling - self.used())} of {self.ceiling} are left")
        if self.paradigm == "free" or estimate == 0:
            return
        if self.ceiling is None:
            raise NeedsConfirmation(f"the scan reads up to {estimate} bytes and no budget is set", estimate)
        if self.confirmed is None or self.confirmed < estimate:
            raise NeedsConfirmation(f"the scan reads up to {estimate} bytes: confirm that many to run it", estimate)

    @contextmanager
    def spend(self, estimate: int, what: str) -> Iterator[None]:
        """Reserve the estimate while the work runs; log it afterwards, also when the work failed."""
        with self._lock:
            self.preflight(estimate)
            self.reserved += estimate
        try:
            yield
        finally:
            with self._lock:
                self.reserved -= estimate
                self.store.append("spend", {"at": dt.datetime.now(dt.UTC).isoformat(), "unit": "bytes", "amount": estimate, "connector": self.connector, "what": what})

    def settle(self, estimate: int, actual: int, what: str) -> None:
        """Correct a logged estimate by what was read."""
        if actual != estimate:
            self.store.append("spend", {"at": dt.datetime.now(dt.UTC).isoformat(), "unit": "bytes", "amount": actual - estimate, "connector": self.connector, "what": f"settled: {what}"})

    def run(self, estimate: int, what: str, work: Callable[[], Any]) -> Any:
        with self.spend(estimate, what):
            return work()
