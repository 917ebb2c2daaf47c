"""Progress lines and the state of tasks, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = "PROGRESS "


def parsed(line: Column, schema: str) -> Column:
    """The JSON after the prefix; null for other lines."""
    return F.from_json(F.when(F.startswith(line, F.lit(PREFIX)), F.substring(line, len(PREFIX) + 1, 1 << 30)), schema)


def changed(rows: DataFrame, by: list[str], value: str, *order: str) -> DataFrame:
    """Rows whose value differs from that of the row before of their group."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def timeouts(rows: DataFrame, by: list[str], time: str, *order: str, stall: float = 300, hard: float = 21600) -> DataFrame:
    """Rows that come later after the one before than a task may be silent, with the gap in seconds and stall or hard."""
    at = F.unix_micros(time) / 1e6
    gap = F.round(at - F.lag(at).over(Window.partitionBy(*by).orderBy(time, *order)), 3)
    return rows.withColumn("gap_s", gap).where(F.col("gap_s") > stall).withColumn("timeout", F.when(F.col("gap_s") > hard, "hard").otherwise("stall"))


def status(stage: Column) -> Column:
    return F.when(stage == "error", "failed").when(stage == "purchase", "completed").otherwise("processing")


def health(up: Column) -> Column:
    """An aggregate: healthy, degraded or unhealthy."""
    return F.when(F.bool_and(up), "healthy").when(F.bool_or(up), "degraded").otherwise("unhealthy")


def confirmed(done: Column, failed: Column) -> Column:
    """An aggregate: error if any part failed, completed if all are done, else pending."""
    return F.when(F.bool_or(failed), "error").when(F.bool_and(done), "completed").otherwise("pending")


def opened(rows: DataFrame, by: list[str], failed: Column, *order: str, failures: int = 5) -> DataFrame:
    """Rows that are the given number of failures in a row; a success starts the count again."""
    w = Window.partitionBy(*by).orderBy(*order)
    runs = rows.withColumn("_failed", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_failed")).over(w))
    count = F.sum("_failed").over(Window.partitionBy(*by, "_run").orderBy(*order))
    return runs.withColumn("_count", count).where((F.col("_failed") == 1) & (F.col("_count") == failures)).drop("_failed", "_run", "_count")
