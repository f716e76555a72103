"""Streaming sources and the run helper."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillworks.config import shared_dir
from tillworks.sources.schemas import RAW


def stream_raw(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The table ``<folder>/<name>.parquet``, a file or a folder of part files, as a stream.

    ``files_per_trigger`` bounds every micro-batch. The path is given as a pattern that only the
    table itself matches, since a plain path must be a folder.
    """
    return spark.readStream.schema(RAW[name]).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parque[t]")


def new_run(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared checkpoint folder for one run's state and output."""
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, run: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes everything available, batch by batch, and stops. Progress is checkpointed in the run folder."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{run}/progress")
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def drain_to_parquet(stream: DataFrame, run: str) -> DataFrame:
    """Appends a stream to parquet files (exactly once through the file sink's log) and reads them back."""
    out = f"{run}/rows"
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{run}/progress").option("path", out)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
