"""Endless extraction: micro-batches of URLs through the batch plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from datatrawl.plans.batch import run_batch
from datatrawl.plans.inputs import Inputs
from datatrawl.plans.store import Store


def dedupe_stream(urls: DataFrame, delay: str | None = None, event_time: str = "ts") -> DataFrame:
    """Let a URL pass once.

    Without `delay` every URL is remembered. With it, a URL is forgotten once it has not been
    seen for that long (by `event_time`), which bounds the state.
    """
    if delay is None:
        return urls.dropDuplicates(["url"])
    return urls.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])


_CACHE = "url array<string>, first array<long>, last array<long>"


def cached_dedupe_stream(urls: DataFrame, time_to_live: float, idle: float, entries: int, buckets: int = 256,
                         event_time: str = "ts") -> DataFrame:
    """Let a URL pass unless a cache of at most `entries` URLs (rounded up to `buckets`) knows it.

    A URL is forgotten `time_to_live` seconds after it passed, and when it wasn't seen for `idle`
    seconds, both by `event_time` of the rows; beyond its bound a bucket forgets what it saw longest
    ago. Only a URL that was forgotten passes again. Rows of a micro-batch count in order of
    `event_time` (a null counts as the bucket's newest time, or 0), equal ones by URL. Null URLs
    don't pass. The state of a bucket is one row, so it is the same after a restart.
    """
    most = -(-entries // buckets)
    columns = urls.columns
    schema = T.StructType([*urls.schema.fields])

    def go(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {u: (a, b) for u, a, b in zip(*state.get)} if state.exists else {}
        rows = pd.concat(batches, ignore_index=True)
        newest = max((b for _, b in known.values()), default=0)
        rows["_at"] = rows["_at"].fillna(max(newest, rows["_at"].max() if rows["_at"].notna().any() else 0))
        rows = rows.sort_values(["_at", "url"], kind="stable")
        passed = []
        for i, url, at in zip(rows.index, rows["url"], rows["_at"].astype("int64")):
            first, last = known.pop(url, (None, None))
            forgotten = first is None or at - first > time_to_live * 1e6 or at - last > idle * 1e6
            if forgotten:
                passed.append(i)
            # The order of the entries is that of their last use.
            known[url] = (at if forgotten else first, at if forgotten else max(last, at))
            if len(known) > most:
                del known[next(iter(known))]
        state.update((list(known), [a for a, _ in known.values()], [b for _, b in known.values()]))
        yield rows.loc[passed, columns]

    at = F.unix_micros(F.col(event_time).cast("timestamp"))
    keyed = urls.filter(F.col("url").isNotNull()).withColumn("_at", at).withColumn(
        "_bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    return keyed.groupBy("_bucket").applyInPandasWithState(go, schema, _CACHE, "append", "NoTimeout")


def run_frontier_stream(frontier: DataFrame, store: Store, inputs: Callable[[], Inputs] | Inputs,
                        checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start the stream. A batch that is replayed after its commit does nothing."""

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        run_batch(store, batch_id, rows, inputs() if callable(inputs) else inputs)

    return (
        frontier.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
