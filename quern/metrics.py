"""Counters, gauges and latency histograms, in the text format that Prometheus reads."""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections import defaultdict

#: Upper bounds of a histogram's buckets, in milliseconds.
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)

_Key = tuple[str, tuple[tuple[str, str], ...]]


def _key(name: str, labels: dict[str, object]) -> _Key:
    return name, tuple(sorted((k, str(v)) for k, v in labels.items()))


class Metrics:
    """Safe for threads. Each value has a name and labels."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._counters: dict[_Key, float] = defaultdict(float)
        self._gauges: dict[_Key, float] = {}
        self._histograms: dict[_Key, list[float]] = {}  # counts by bucket, then the sum

    def count(self, name: str, by: float = 1, **labels: object) -> None:
        with self._lock:
            self._counters[_key(name, labels)] += by

    def gauge(self, name: str, value: float, **labels: object) -> None:
        with self._lock:
            self._gauges[_key(name, labels)] = value

    def observe(self, name: str, value: float, **labels: object) -> None:
        with self._lock:
            own = self._histograms.setdefault(_key(name, labels), [0.0] * (len(BOUNDS) + 2))
            own[bisect_left(BOUNDS, value)] += 1
            own[-1] += value

    def total(self, name: str) -> float:
        """A counter or gauge summed over its labels, or how often a histogram was fed."""
        with self._lock:
            return sum(v for d in (self._counters, self._gauges) for (n, _), v in d.items() if n == name) + sum(sum(h[:-1]) for (n, _), h in self._histograms.items() if n == name)

    def text(self) -> str:
        def line(name: str, labels: tuple, value: float, **more: object) -> str:
            told = ",".join(f'{k}="{_escaped(v)}"' for k, v in [*labels, *((k, str(v)) for k, v in more.items())])
            return f"{name}{{{told}}} {value:g}" if told else f"{name} {value:g}"

        with self._lock:
            out: list[str] = []
            for kind, values in (("counter", self._counters), ("gauge", self._gauges)):
                for name in sorted({n for n, _ in values}):
                    out += [f"# TYPE {name} {kind}", *(line(name, at, v) for (n, at), v in sorted(values.items()) if n == name)]
            for name in sorted({n for n, _ in self._histograms}):
                out.append(f"# TYPE {name} histogram")
                for (n, at), own in sorted(self._histograms.items()):
                    if n == name:
                        upto = 0.0
                        for bound, count in zip([*BOUNDS, "+Inf"], own):
                            upto += count
                            out.append(line(f"{name}_bucket", at, upto, le=bound))
                        out += [line(f"{name}_sum", at, own[-1]), line(f"{name}_count", at, upto)]
            return "\n".join(out) + "\n"


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
