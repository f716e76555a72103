"""Job parameters and the session used by tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ShopConfig:
    """Shop-wide parameters a job may depend on."""

    currency: str = "₹"
    hide_out_of_stock: bool = True


def local_session(cpus: int | str = "*", app: str = "tillworks") -> SparkSession:
    """A local session for tests and bench runs; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and cut-lineage tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where it
    names none (a bare local test) is a temporary folder used, one for the session; on a
    cluster that is an error.
    """
    ctx = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
    if not named:
        current = ctx._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not ctx.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        ctx.setCheckpointDir(named)
    return named.rstrip("/")


def stage_table(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a parquet table in the shared folder and reads it back.

    Later steps then prune columns, push filters and know the real size, and a lost
    executor costs a re-read instead of the whole plan before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the lighter form for loops whose rows shrink."""
    ctx = df.sparkSession.sparkContext
    if not ctx._jsc.sc().getCheckpointDir().isDefined():
        ctx.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
