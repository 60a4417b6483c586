"""What needs the network, behind functions the caller provides: resolving, rewriting, checking links.

Each function is called once for each distinct input, in tasks, and never raises into the job. Answers are joined to all rows with
that input; rows without one are spread over the join's tasks. The defaults work offline.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import or_else, or_null
from postmill.functions.url import host
from postmill.operators.store import Store
from postmill.runtime import written

#: raw URL to (final URL, its host), or nulls where it can't be reached. The status doesn't matter.
Resolve = Callable[[str], tuple[str | None, str | None]]
#: text to (status, text): a status of 429 or 500 and above is tried again, 0 stands for a failed transport.
Rewrite = Callable[[str], tuple[int, str | None]]
#: URL to its status, or None where it can't be reached.
Status = Callable[[str], int | None]


def _answered(rows: DataFrame, key: str, answers: DataFrame) -> DataFrame:
    """rows with the answer to their key, if any: a blank one gets a key of its own that nothing equals, else all such rows would meet in one task."""
    own = F.when(or_null(F.col(key)).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string")))
    return rows.withColumn("__k", own).join(answers.withColumnRenamed(key, "__k"), "__k", "left").drop("__k")


#: What a memo of resolutions holds: an answer, or nulls where there was none, and when it was asked for.
RESOLUTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("raw_apply_url", "apply_url", "resolved_domain")] + [T.StructField("asked_at", T.TimestampType())])


def memo_at(spark: SparkSession, path: str) -> Store:
    """A stored memo of resolutions, one row for each URL that was ever asked for."""
    return Store(spark, path, schema=RESOLUTIONS, key="raw_apply_url")


def _by_host(urls: DataFrame, column: str, tasks: int | None) -> DataFrame:
    """urls dealt so that all of a host are in one task, one after another: a host is asked by one client at a time."""
    n = tasks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return urls.withColumn("__host", F.coalesce(host(F.col(column)), F.lit(""))).repartition(n, "__host").sortWithinPartitions("__host", column)


def _paced(hosts, delay: float) -> Iterator[None]:
    """Waits between two URLs of one host."""
    last = None
    for h in hosts:
        if delay and h == last:
            time.sleep(delay)
        last = h
        yield


def asked(urls: DataFrame, call: Resolve, tasks: int | None = None, delay: float = 0.0) -> DataFrame:
    """(raw_apply_url, apply_url, resolved_domain) of distinct URLs, each asked for once, with a pause between two of one host."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, _ in zip(b["raw_apply_url"], _paced(b["__host"], delay), strict=True):
                try:
                    out.append((u, *call(u)))
                except Exception:
                    out.append((u, None, None))
            yield pd.DataFrame(out, columns=["raw_apply_url", "apply_url", "resolved_domain"])

    return _by_host(urls, "raw_apply_url", tasks).mapInPandas(f, "raw_apply_url string, apply_url string, resolved_domain string")


def resolve(rows: DataFrame, call: Resolve | None = None, table: DataFrame | None = None, tasks: int | None = None, memo: Store | None = None, as_of: dt.datetime | None = None, keep_hours: float = 720, keep_failed_hours: float = 24, delay: float = 0.0) -> DataFrame:
    """rows with apply_url and resolved_domain of their raw_apply_url: looked up in table (raw_apply_url,
    apply_url, resolved_domain), else asked of call, else the URL itself. With a memo, only URLs are asked for whose answer in it is missing, or older at as_of than
    an answer, or a failure, is kept; what is learned is committed to it."""
    rows = rows.drop("apply_url", "resolved_domain")
    answer = ["raw_apply_url", "apply_url", "resolved_domain"]
    if table is not None:
        return _answered(rows, "raw_apply_url", table.select(*answer))
    if call is None:
        return rows.withColumns({"apply_url": or_null(F.col("raw_apply_url")), "resolved_domain": host(F.col("raw_apply_url"))})
    urls = rows.select("raw_apply_url").where("raw_apply_url <> ''").distinct()
    if memo is None:
        return _answered(rows, "raw_apply_url", asked(urls, call, tasks, delay))
    if as_of is None:
        raise ValueError("a memo needs a time to judge its answers by")
    ago = lambda hours: F.lit(as_of - dt.timedelta(hours=hours))
    fresh = F.col("asked_at") >= F.when(F.col("apply_url").isNull(), ago(keep_failed_hours)).otherwise(ago(keep_hours))
    known = written(memo.read().join(urls, "raw_apply_url", "left_semi").where(fresh), "known")
    found = written(asked(urls.join(known, "raw_apply_url", "left_anti"), call, tasks, delay).withColumn("asked_at", F.lit(as_of)), "found")
    memo.commit(lambda _: found)
    return _answered(rows, "raw_apply_url", known.unionByName(found).select(*answer))


def rewritten(text: str | None, call: Rewrite | None, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> str | None:
    """The rewritten text, or None: for blank input, without a service, after a refusal, or when tries run out."""
    if call is None or not (text or "").strip():
        return None
    for k in range(retries + 1):
        try:
            status, out = call(text)
        except Exception:
            status, out = 0, None
        if status == 200:
            return (out or "").strip() or None
        if status and status != 429 and status < 500:
            return None
        if k < retries:
            wait(2.0**k)
    return None


def rewrite(rows: DataFrame, call: Rewrite | None = None, retries: int = 2, tasks: int = 3) -> DataFrame:
    """rows with rewritten_description, for rows about to be inserted."""
    if call is None:
        return rows.withColumn("rewritten_description", F.lit(None).cast("string"))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(rewritten_description=[rewritten(t, call, retries) for t in b["description_original"]])

    texts = rows.select("description_original").where("description_original <> ''").distinct().repartition(tasks)
    out = texts.mapInPandas(f, "description_original string, rewritten_description string")
    return _answered(rows.drop("rewritten_description"), "description_original", out)


def link_of() -> F.Column:
    return or_else(F.col("apply_url"), F.col("raw_apply_url"))


def statuses(jobs: DataFrame, call: Status, tasks: int | None = None, delay: float = 0.0) -> DataFrame:
    """(link, status, failed) for each distinct link of an active job, with a pause between two of one host."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, _ in zip(b["link"], _paced(b["__host"], delay), strict=True):
                try:
                    s = call(u)
                except Exception:
                    s = None
                out.append((u, s, s is None))
            yield pd.DataFrame(out, columns=["link", "status", "failed"]).astype({"status": "Int32"})

    links = jobs.where("is_active").select(link_of().alias("link")).where("link <> ''").distinct()
    return _by_host(links, "link", tasks).mapInPandas(f, "link string, status int, failed boolean")


def is_dead() -> F.Column:
    return F.coalesce(F.col("status").isin(404, 410) | F.col("failed"), F.lit(False))


def dead_ids(jobs: DataFrame, table: DataFrame) -> DataFrame:
    """ids of active jobs whose link is gone (404, 410) or can't be reached. table: link, status, failed."""
    return jobs.where("is_active").select("id", link_of().alias("link")).join(table, "link").where(is_dead()).select("id")
