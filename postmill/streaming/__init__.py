"""Pages as a stream: every micro-batch is one ingest."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from postmill.config import Settings
from postmill.operators.store import Store
from postmill.plans.ingest import ingest
from postmill.schema import PAGES


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark wrote into a checkpoint when its query was first started."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def ingest_stream(pages: DataFrame, store: Store, checkpoint: str, clock: Callable[[], dt.datetime], settings: Settings | None = None, **network) -> DataStreamWriter:
    """A writer to start with a trigger, as ``.trigger(availableNow=True)``. The query's id, which its checkpoint keeps, and the batch's number
    name the change, so a batch that is run again changes nothing, and other streams on the same store are told apart.
    Postings are dropped by age at the clock, not by a watermark."""

    def batch(df: DataFrame, batch_id: int) -> None:
        ingest(df, store, clock(), settings, name=f"{query_id(df.sparkSession, checkpoint)}-{batch_id}", **network)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def recent_fingerprints(jobs: DataFrame, hours: float = 24) -> DataFrame:
    """Streaming approximation of deduplication: the first row of each fingerprint within the window."""
    return jobs.withWatermark("scraped_at", f"{int(hours * 3600)} seconds").dropDuplicatesWithinWatermark(["fingerprint"])


def counts_by_hour(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Postings of each source and hour, closed by a watermark on the posting time."""
    return jobs.withWatermark("posted_at", late).groupBy(F.window("posted_at", "1 hour").alias("hour"), "source").agg(F.count("*").alias("jobs"))
