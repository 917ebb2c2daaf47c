"""Keyed state over streams of (key, at, value) rows, as one state processor for each rule."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moraine.session import checkpoint_dir


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet table at a path, be it a file or a folder. (As a pattern; a plain path has to be a folder.)"""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(parts)).sort_values(["at", "ident"], kind="stable")
    before = rows["value"].shift(1)
    before.iloc[0] = last
    changed = rows[(rows["value"] != before)]
    state.update((rows["value"].iloc[-1],))
    if len(changed):
        yield pd.DataFrame({"key": changed["key"], "at": changed["at"], "ident": changed["ident"], "value": changed["value"]})


def changes(stream: DataFrame) -> DataFrame:
    """Rows (key, at, ident, value) whose value differs from the one before of their key. The last value is kept as state."""
    schema = stream.select("key", "at", "ident", "value").schema
    return stream.groupBy("key").applyInPandasWithState(_changes, schema, "value string", "append", GroupStateTimeout.NoTimeout)


def _actions(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, active = state.get if state.exists else (None, True)
    rows = pd.concat(list(parts)).sort_values(["at", "ident"], kind="stable")
    out = []
    for ident, h in zip(rows["ident"], rows["hash"]):
        if h is None or pd.isna(h):
            out.append((ident, "delete" if known is not None and active else "skip"))
            active = False
        else:
            out.append((ident, "index" if known is None else "reindex" if h != known else "skip" if active else "restore"))
            known, active = h, True
    state.update((known, active))
    yield pd.DataFrame({"key": key[0], "ident": [i for i, _ in out], "action": [a for _, a in out]})


def actions(stream: DataFrame) -> DataFrame:
    """key, ident and action of rows (key, at, ident, hash) against the last hash of their key: index, reindex, skip, restore after a deletion, and delete where the hash is null."""
    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").applyInPandasWithState(_actions, f"key {kind}, ident long, action string", "hash string, active boolean", "append", GroupStateTimeout.NoTimeout)


def _expiring(ttl_ms: int) -> Callable:
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value, at = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "at": [at], "expired": [True]})
            return
        rows = pd.concat(list(parts)).sort_values(["at", "ident"], kind="stable")
        last = rows.iloc[-1]
        value, at = last["value"], last["at"].to_pydatetime()
        if state.exists and state.get[1] > at:
            value, at = state.get
        state.update((value, at))
        # a row may be older than the watermark allows a timer for; then the task has ended already
        state.setTimeoutTimestamp(max(int(pd.Timestamp(at).timestamp() * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "at": [at], "expired": [False]})

    return run


def tasks(stream: DataFrame, ttl: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """The state of each key (key, value, at, expired) when it changes, and once more when it has been idle for ttl of event time."""
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    kind = stream.schema["key"].dataType.simpleString()
    return stream.withWatermark("at", late).groupBy("key").applyInPandasWithState(_expiring(ms), f"key {kind}, value string, at timestamp, expired boolean", "value string, at timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def once_within(stream: DataFrame, keys: list[str], late: str = "1 hour", time_col: str = "at") -> DataFrame:
    """The first row of each key to come, while the watermark keeps it."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, run through to a Parquet table in the shared folder (complete mode: the last state), read again."""
    spark = stream.sparkSession
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"

    def store(batch: DataFrame, number: int) -> None:
        # a batch that runs again overwrites its own folder, so none is there twice
        batch.write.mode("overwrite").parquet(f"{path}/{'last' if mode == 'complete' else f'batch={number}'}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-log").foreachBatch(store).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/*")




__all__ = ["actions", "changes", "drained", "once_within", "stream_of", "tasks"]
