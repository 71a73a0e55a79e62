"""Streams over growing folders of files, and sinks that survive a restart."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskframe.session import scratch_path


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream, in the order they appear."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Start queries whose state lies on local disk with changelogs in the checkpoint, so that it
    may outgrow memory; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Start a query with no more state partitions than cores.

    The number is fixed in the checkpoint when a stateful query first starts, and unlike a
    batch shuffle its partitions are not coalesced later.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def start_files(sdf: DataFrame, out: str, checkpoint: str, mode: str = "append", once: bool = True, name: str | None = None) -> StreamingQuery:
    """Stream to parquet; with `once`, everything available is processed and the query ends."""
    writer = sdf.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def drain(sdf: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and read its output back as a table."""
    spark = sdf.sparkSession
    out, checkpoint = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    with state_partitions(spark):
        started = start_files(sdf, out, checkpoint)
    started.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)
