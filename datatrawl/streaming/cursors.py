"""State of search terms, carried from response to response."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.utils import AnalysisException

from datatrawl.sources.search import parse_search_payload, response_cursors, search_cursor

_CURSORS = "term STRING, since_id BIGINT, max_id BIGINT, last_count INT, version BIGINT"


def read_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of each term."""
    try:
        versions = spark.read.schema(_CURSORS).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        versions = spark.createDataFrame([], _CURSORS)
    state = F.struct("since_id", "max_id", "last_count")
    newest = versions.groupBy("term").agg(F.max_by(state, "version").alias("s"))
    return newest.select("term", "s.since_id", "s.max_id", "s.last_count")


def run_cursor_stream(responses: DataFrame, folder: str, checkpoint: str,
                      trigger: dict | None = None) -> StreamingQuery:
    """Keep the cursor table up to date; each micro-batch writes the terms it saw."""

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        cursors = search_cursor(parse_search_payload(rows))
        cursors.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")

    return (
        responses.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


_STATE = "since_id long, max_id long, last_count int, response_id long"


def run_cursor_state(responses: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep each term's cursor as one value in the query's state store, see `read_cursor_state`.

    A response that is not newer than the one a term's cursor came from changes nothing.
    """

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        row = rows.loc[rows["response_id"].idxmax()]
        if not state.exists or state.get[3] < row["response_id"]:
            state.update((int(row["since_id"]) if pd.notna(row["since_id"]) else None, int(row["max_id"]),
                          int(row["last_count"]) if pd.notna(row["last_count"]) else None, int(row["response_id"])))
            yield pd.DataFrame({"term": [key[0]]})

    cursors = response_cursors(parse_search_payload(responses))
    kept = cursors.groupBy("term").applyInPandasWithState(go, "term string", _STATE, "update", "NoTimeout")
    return (
        kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_cursor_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The cursor of each term from the state store: one row a term, however many batches there were."""
    state = spark.read.format("statestore").load(checkpoint)
    value = F.col("value.groupState")
    return state.select("key.term", value["since_id"].alias("since_id"), value["max_id"].alias("max_id"),
                        value["last_count"].alias("last_count"))
