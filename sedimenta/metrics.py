"""Counters of a running engine: latencies, recent statements, health and text exposition."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Metrics:
    def __init__(self, recent: int = 32):
        self._lock = threading.Lock()
        self.started, self.ready = time.time(), False
        self.queries, self.failures, self.seconds = 0, 0, 0.0
        self.histogram = [0] * (len(BOUNDS) + 1)
        self.recent: deque = deque(maxlen=recent)
        self.gauges: dict[str, Callable[[], float]] = {}  # read when asked for

    def record(self, sql: str, seconds: float, rows: int | None, error: str | None = None) -> None:
        with self._lock:
            self.queries += 1
            self.failures += error is not None
            self.seconds += seconds
            self.histogram[next((i for i, b in enumerate(BOUNDS) if seconds <= b), len(BOUNDS))] += 1
            self.recent.append({"sql": sql, "seconds": round(seconds, 6), "rows": rows, "error": error})

    def status(self, sessions: int = 0) -> dict:
        with self._lock:
            return {
                "ready": self.ready,
                "uptime_seconds": time.time() - self.started,
                "queries": self.queries,
                "failures": self.failures,
                "sessions": sessions,
                "recent": list(self.recent),
            }

    def text(self, sessions: int = 0) -> str:
        """The counters in the Prometheus text format."""
        with self._lock:
            total, lines = 0, ["# TYPE sedimenta_query_seconds histogram"]
            for bound, n in zip((*BOUNDS, "+Inf"), self.histogram):
                total += n
                lines.append(f'sedimenta_query_seconds_bucket{{le="{bound}"}} {total}')
            lines += [f"sedimenta_query_seconds_sum {self.seconds}", f"sedimenta_query_seconds_count {total}"]
            lines += ["# TYPE sedimenta_query_failures counter", f"sedimenta_query_failures {self.failures}", "# TYPE sedimenta_sessions gauge", f"sedimenta_sessions {sessions}"]
            for name, value in self.gauges.items():
                lines += [f"# TYPE sedimenta_{name} gauge", f"sedimenta_{name} {value()}"]
            return "\n".join(lines) + "\n"
