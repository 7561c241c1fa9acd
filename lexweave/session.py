"""Session construction and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, spark-submit makes the session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{n}]").appName("lexweave").config("spark.driver.memory", memory)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(n)} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt to all cores if its files give fewer partitions than there are cores.

    Work on texts is bound by the CPU, so one small file should not be one task. Inputs of more
    partitions, as any large one has, are read as they lie.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def reused(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder, for plans that read it many times.

    The copy is a leaf: neither its rows nor its logical plan are worked out again for each use, each
    use reads only its columns, and its size tells Spark which joins to broadcast. It stays until the
    folder is cleaned up, as checkpoints do.
    """
    path = f"{shared_folder(df.sparkSession)}/lexweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
