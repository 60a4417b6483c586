"""The digest of recent jobs, and readiness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import digest as D
from postmill.operators.store import Store


def recent(jobs: DataFrame, as_of: dt.datetime, hours: float) -> DataFrame:
    """Active jobs scraped in the window. A merge moves scraped_at, so a job seen again is in it again."""
    return jobs.where((F.col("scraped_at") >= F.lit(as_of - dt.timedelta(hours=hours))) & F.col("is_active"))


def digest(jobs: DataFrame, as_of: dt.datetime, site_url: str, hours: float = 24, max_jobs: int = 5) -> DataFrame:
    """One row: message, job_count, listed_count, x_length, fits, window_hours. Only the first max_jobs rows are brought together."""
    if not 0 < hours <= 720:
        raise ValueError(f"hours: {hours}")
    if not 1 <= max_jobs <= 20:
        raise ValueError(f"max_jobs: {max_jobs}")
    window = recent(jobs, as_of, hours)
    count = window.agg(F.count("*").alias("job_count"))
    top = window.orderBy(F.col("scraped_at").desc(), "id").limit(max_jobs).select("scraped_at", "id", D.job_line(F.col("title"), F.col("company")).alias("line"))
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("scraped_at").cast("timestamp"))).alias("t"), "id", "line"))).alias("rows"))
    one = count.withColumn("__one", F.lit(1)).join(listed.withColumn("__one", F.lit(1)), "__one")
    lines = F.transform("rows", lambda x: x["line"])
    one = one.select("job_count", D.build(lines, F.col("job_count"), site_url).alias("message"))
    listed_count = F.coalesce(F.size(F.filter(F.split("message", "\n"), lambda x: F.startswith(x, F.lit("• ")))), F.lit(0))
    length = F.coalesce(D.billed_length(F.col("message"), site_url), F.lit(0))
    return one.select("message", "job_count", F.when(F.col("message").isNull(), 0).otherwise(listed_count).alias("listed_count"), length.alias("x_length"), (length <= D.LIMIT).alias("fits"), F.lit(float(hours)).alias("window_hours"))


def health() -> dict:
    return {"status": "ok"}


def readiness(store: Store) -> tuple[int, dict]:
    state = store.probe()
    return (200 if state == "connected" else 503), {"status": "ok" if state == "connected" else "degraded", "database": state}
