"""Background merging: on request and at an interval, one merge of an index at a time."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable

log = logging.getLogger(__name__)


class Merger:
    """A thread that compacts indexes.

    Requests of an index that wait are one; the interval compacts every index.
    A merge that fails is logged and tried again when it is next asked for.
    """

    def __init__(self, compact: Callable[[str], object], names: Callable[[], Iterable[str]], interval: float):
        self._compact, self._names, self._interval = compact, names, interval
        self._waiting: set[str] = set()
        self._changed = threading.Condition()
        self._stop = self._busy = False
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def request(self, name: str) -> None:
        with self._changed:
            self._waiting.add(name)
            self._changed.notify_all()

    def idle(self, timeout: float | None = None) -> bool:
        """Wait until nothing is asked for."""
        with self._changed:
            return self._changed.wait_for(lambda: not self._waiting and not self._busy, timeout)

    def alive(self) -> bool:
        return self._thread.is_alive()

    def close(self) -> None:
        with self._changed:
            self._stop = True
            self._changed.notify_all()
        self._thread.join()

    def _run(self) -> None:
        while True:
            with self._changed:
                self._changed.wait_for(lambda: self._waiting or self._stop, self._interval or None)
                if self._stop:
                    return
                try:
                    due = self._waiting or set(self._names())
                except Exception:
                    log.exception("indexes can't be listed")
                    due = set()
                self._waiting, self._busy = set(), True
            for name in sorted(due):
                try:
                    self._compact(name)
                except Exception:
                    log.exception("merging %s failed", name)
            with self._changed:
                self._busy = False
                self._changed.notify_all()
