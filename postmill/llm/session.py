"""What the operators need from a session: Arrow batch size and the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows and bytes in an Arrow batch: bound a Python worker's memory even where every text is long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Bytes of input for each partition of a shuffle, and partitions at most.
PARTITION_BYTES, MAX_PARTITIONS = 16 << 20, 50_000
#: A size beyond this is what Spark says of tables of which it knows none.
MAX_KNOWN = 1 << 50


#: The folder that holds this package, for Python workers that start elsewhere.
ROOT = str(Path(__file__).resolve().parents[2])


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def partitions(df: DataFrame) -> int:
    """Partitions for what is made of df: as many as the session says, and more where the input's size, if known, asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = 0 if size > MAX_KNOWN else size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTITIONS, -(-size // PARTITION_BYTES)))


def arrow(f, kind: DataType):
    """f, from Arrow arrays to an Arrow array, as a function of columns. Marked nondeterministic so that
    the optimiser never evaluates it twice for one row."""
    return F.arrow_udf(f, kind).asNondeterministic()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only where it is unset, as in local tests, one is made."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "postmill-shared")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, and a lost
    executor costs no more than a reread."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` returned, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished jobs now: they go when the driver's objects are collected."""
    gc.collect()
    spark._jvm.System.gc()
