"""Timers by name on the driver, and counters of what passes through a DataFrame."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession


@dataclass
class Channels:
    """Calls, total, least and most of each named span; spans may nest."""

    spans: dict[str, list[float]] = field(default_factory=dict)

    @contextmanager
    def span(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spans.setdefault(name, []).append(time.perf_counter() - began)

    def timed(self, name: str) -> Callable:
        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def inner(*args, **kwargs):
                with self.span(name):
                    return f(*args, **kwargs)

            return inner

        return wrap

    def reset(self) -> None:
        self.spans.clear()

    def report(self, spark: SparkSession) -> DataFrame:
        """name, calls, total, least, most; the longest first."""
        rows = sorted(((n, len(t), sum(t), min(t), max(t)) for n, t in self.spans.items()), key=lambda r: -r[2])
        return spark.createDataFrame(rows, "name string, calls int, total double, least double, most double")


def counted(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, Observation]:
    """``df`` with measures that its next action fills in: no job of their own."""
    o = Observation(name)
    return df.observe(o, *measures), o
