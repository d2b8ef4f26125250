"""Counts of a run, taken while its tables are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

COUNTS = ("n_urls", "n_stored", "n_subpages", "n_links", "n_new_links")


class RunCounts:
    """Watches the decisions and links of a batch as they are staged, without a pass of its own.

    What is watched must be written once, and is counted when `total` is asked for.
    """

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def _watch(self, df: DataFrame, **counts) -> DataFrame:
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *(c.alias(name) for name, c in counts.items()))

    def routed(self, df: DataFrame) -> DataFrame:
        return self._watch(df, n_urls=F.count(F.lit(1)), n_stored=F.count_if(F.col("outcome") == "store"),
                           n_subpages=F.count_if(~F.col("from_queue")))

    def links(self, df: DataFrame) -> DataFrame:
        return self._watch(df, n_links=F.count(F.lit(1)), n_new_links=F.count_if("is_new"))

    def total(self) -> dict[str, int]:
        """The sums over all that was watched; both passes of a batch count."""
        parts = [seen.get for seen in self._seen]
        return {name: sum(int(p.get(name) or 0) for p in parts) for name in COUNTS}
