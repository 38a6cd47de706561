"""Counts and times of a run, taken while it runs."""

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Metrics:
    """Observed counts per name, and seconds per phase.

    ``watch`` adds counters to a plan; they are filled by the first action over it
    that runs to its end, so no extra pass counts anything. Watch what a sink is
    given: a plan that is also looked into before (``limit``) counts that look.
    """

    def __init__(self) -> None:
        self.watched: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def watch(self, name: str, df: DataFrame, **more: Column) -> DataFrame:
        """The same rows; ``rows`` and the named aggregates are counted under ``name``."""
        if name in self.watched:
            raise ValueError(f"{name!r} is watched already")
        seen = self.watched[name] = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in more.items()])

    def structures(self, name: str, features: DataFrame) -> DataFrame:
        """Local-structure rows with their structures and fingerprints (a print's first chunk counts it)."""
        return self.watch(name, features, structures=F.sum(F.size("ls")), fingerprints=F.count_if(F.col("chunk") == 0))

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start

    def counts(self) -> dict[str, dict[str, int]]:
        """Counts of everything watched; waits for the actions."""
        return {name: dict(seen.get) for name, seen in self.watched.items()}
