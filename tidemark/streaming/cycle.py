"""The restartable cycle as Structured Streaming: receipts arrive as files, versions append once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.sources.store import append


def landing(spark: SparkSession, path: str, schema: StructType | str, *, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def append_once(stream: DataFrame, table: str, key: list[str], checkpoint: str, *, change: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append a stream's rows to a table, each key once, however often batches are replayed.

    Late rows are kept: what was knowable is decided by a query's cutoff, not by a watermark.
    """

    def write(batch: DataFrame, _: int) -> None:
        append(change(batch) if change else batch, table, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def receipts_by_window(stream: DataFrame, *, late: str = "48 hours", width: str = "1 day") -> DataFrame:
    """Receipts and successes by source and window of arrival."""
    return stream.withWatermark("received_at", late).groupBy(F.window("received_at", width), "source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("n_success"))


DEADLINE = "sample_id string, status string, reason string"
STATE = "due bigint, answered boolean"


def delivery_deadlines(stream: DataFrame, *, delay_hours: int = 48) -> DataFrame:
    """Labels that wait for their endpoint: ready on its arrival, blocked once event time passes the delay.

    stream: sample_id, at (event time), kind (`expected` or `received`). A sample is answered once: an answer is
    remembered until event time has passed another delay, so an arrival after a block, or a repeated one, answers nothing
    before.
    A deadline that event time has passed already blocks at once, and every state has a timer: one that nothing is
    expected for goes after the delay.
    """
    delay = delay_hours * 3_600_000

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda status, reason: pd.DataFrame({"sample_id": [key[0]], "status": [status], "reason": [reason]})
        now = state.getCurrentWatermarkMs()
        due, answered = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            if not due or answered:
                state.remove()
                return
        else:
            latest = now
            for batch in batches:
                for kind, at in zip(batch["kind"], batch["at"]):
                    moment = int(at.timestamp() * 1000)
                    latest = max(latest, moment + delay)
                    if kind == "expected" and not answered:
                        due = moment + delay
                    elif kind == "received" and not answered:
                        answered, due = True, max(due, moment)
                        yield row("ready", None)
            if answered or not due or due > now:
                state.update((due, answered))
                state.setTimeoutTimestamp(max(max(due, now) + delay if answered else due or latest, now + 1))
                return
        yield row("blocked", "past_endpoint_price_missing_or_collection_failure")
        state.update((due, True))
        state.setTimeoutTimestamp(max(due, now) + delay)

    timed = stream.withWatermark("at", "0 seconds").groupBy("sample_id")
    return timed.applyInPandasWithState(advance, DEADLINE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
