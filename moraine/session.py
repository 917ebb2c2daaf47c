"""Session and checkpoint helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch; rows and characters of one that map_rows() gives, about.
ARROW_BYTES = 4 << 20
OUT_ROWS, OUT_CHARS = 1024, 1 << 20
_ARROW_LIMIT, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("moraine")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where that is unset, one of the system's temporary folder in local mode, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="moraine-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a Parquet table in the shared folder, read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow in batches of ARROW_BYTES rather than of 64 MB, Spark's default, as each task has several copies of a batch in memory. A session's own limit stays."""
    conf = df.sparkSession.conf
    if conf.get(_ARROW_LIMIT, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that make gives of each row's values. Both sides are small batches, so a worker holds the rows of a few inputs only, whatever the table's size."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for part in parts:
            for at in range(part.num_rows):
                for row in make(*(c[at].as_py() for c in part.columns)):
                    held.append(row)
                    chars += sum(len(x) for x in row if type(x) is str)
                    if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield packed(held)
                        held, chars = [], 0
        if held:
            yield packed(held)

    return map_batches(df, run, schema)
