"""The walk over a source's sitemap, newest first, with a fetch function that the caller provides.

A site is walked in order and in blocks, each one fetched by a single task with a pause after each page, as its crawl delay asks.
A block's pages are a table in the shared folder, so what was fetched isn't fetched again. The walk ends
at the page cap, at the first entry whose own date is too old, or with the block that holds the first page that is. Pages of
that block after the stop were fetched in vain and are left out.
"""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.config import Settings
from postmill.runtime import written
from postmill.schema import PAGES
from postmill.sources.base import Source, until_stale

#: URL to (status, text). May raise: a page that does, or has another status than 200, is skipped.
Fetch = Callable[[str], tuple[int, str | None]]

BLOCK = 25


class SitemapError(RuntimeError):
    """A sitemap that can't be had ends the walk of its source: there is nothing to skip to."""


def entries(xml: str, pattern: str) -> list[tuple[str, str | None]]:
    """(URL, date or None) of a sitemap, in document order."""
    return [(m.group(1), m.group(2) if m.re.groups > 1 else None) for m in re.finditer(pattern, xml)]


def _fetched(spark: SparkSession, block: list[tuple[int, str, str | None]], fetch: Fetch, delay: float, wait: Callable[[float], None]) -> DataFrame:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pos, u in zip(b["pos"], b["url"], strict=True):
                try:
                    status, text = fetch(u)
                except Exception:
                    status, text = 0, None
                if status == 200:
                    out.append((pos, u, text))
                wait(delay)
            yield pd.DataFrame(out, columns=["pos", "url", "html"])

    rows = spark.createDataFrame([(p, u) for p, u, _ in block], "pos long, url string").coalesce(1)
    return written(rows.mapInPandas(f, "pos long, url string, html string"), "fetched")


def walk(spark: SparkSession, source: Source, fetch: Fetch, as_of: dt.datetime, settings: Settings | None = None, block: int = BLOCK, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The pages (url, html) of one source that a run reads, each with the 200 answers only."""
    settings = settings or Settings()
    status, xml = fetch(source.sitemap_url)
    if status != 200:
        raise SitemapError(f"{source.source_name}: sitemap answered {status}")
    found = [(k, u, when) for k, (u, when) in enumerate(entries(xml or "", source.sitemap_pattern)[: settings.max_pages(source.source_name, source.max_pages)])]
    since = F.lit(as_of - dt.timedelta(hours=settings.max_job_age_hours))
    if found and any(when for _, _, when in found):
        dated = spark.createDataFrame(found, "pos long, url string, at string").withColumn("t", source.entry_time(F.col("at")))
        last = until_stale(dated, "pos", "t", since).agg(F.max("pos")).first()[0]
        found = found[: 0 if last is None else last + 1]
    out = []
    for k in range(0, len(found), block):
        pages = _fetched(spark, found[k : k + block], fetch, settings.crawl_delay(source.source_name, source.crawl_delay_seconds), wait)
        kept = until_stale(pages.withColumn("__t", source.peek(F.col("html"))), "pos", "__t", since)
        out.append(kept.select("url", "html"))
        if kept.count() < pages.count():
            break
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], PAGES)
