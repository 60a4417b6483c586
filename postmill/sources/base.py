"""The contract of a source, and its registry."""

from __future__ import annotations

import datetime as dt
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_registry: dict[str, Source] = {}


class Source(Protocol):
    """Three steps; only the one that provides pages, the walk over the sitemap, does I/O.

    entry_time, peek: the date of a sitemap's entry and of a fetched page, null where that doesn't end the walk
    parse:     pages (url, html) to one raw record for each posting worth keeping
    normalize: raw records to canonical columns; odd values become nulls, never errors. A record that can't be read has the reason in
               ``corrupt``, which is null for all others
    """

    source_name: str
    max_pages: int
    sitemap_url: str
    sitemap_pattern: str
    crawl_delay_seconds: float

    def entry_time(self, at: F.Column) -> F.Column: ...

    def peek(self, html: F.Column) -> F.Column: ...

    def parse(self, pages: DataFrame, as_of: dt.datetime, max_age_hours: float) -> DataFrame: ...

    def normalize(self, raw: DataFrame) -> DataFrame: ...


def register(source: Source) -> Source:
    name = getattr(source, "source_name", "")
    if not name:
        raise ValueError("a source needs a source_name")
    if name in _registry and type(_registry[name]) is not type(source):
        raise ValueError(f"two sources are named {name}")
    _registry[name] = source
    return source


def all_sources() -> list[Source]:
    from postmill.sources import flat, graph  # noqa: F401  they register themselves

    return [_registry[k] for k in sorted(_registry)]


def get_source(name: str) -> Source:
    known = {s.source_name: s for s in all_sources()}
    if name not in known:
        raise KeyError(f"no source named {name}; known: {', '.join(known)}")
    return known[name]


def run(source: Source, pages: DataFrame, as_of: dt.datetime, max_age_hours: float = 24) -> DataFrame:
    return source.normalize(source.parse(pages, as_of, max_age_hours))


def cutoff(as_of: dt.datetime, max_age_hours: float) -> F.Column:
    return F.lit(as_of - dt.timedelta(hours=max_age_hours))


def sitemap_locations(xml: F.Column, pattern: str) -> F.Column:
    """All locations of the pattern's group 1, in document order."""
    return F.regexp_extract_all(xml, F.lit(pattern), F.lit(1))


def sitemap_entries(xml: F.Column, pattern: str) -> F.Column:
    """Pairs (loc, lastmod) of the pattern's two groups, in document order."""
    get = lambda k: F.regexp_extract_all(xml, F.lit(pattern), F.lit(k))
    return F.arrays_zip(get(1).alias("loc"), get(2).alias("lastmod"))


def until_stale(df: DataFrame, order: str, time: str, since: F.Column, most: int | None = None, group: str | None = None) -> DataFrame:
    """The rows in order up to the first one older than since; undated rows don't stop it. most bounds
    the positions looked at. group separates lists, each of which is one crawl's sitemap that one task holds;
    without it the one list may be of any length, and its bounded start is taken before the window."""
    stale = F.coalesce(F.col(time) < since, F.lit(False))
    if not group and most is None:
        first = df.where(stale).agg(F.min(F.struct(order)).alias("__first"))
        return df.join(F.broadcast(first)).where(F.col("__first").isNull() | (F.struct(order) < F.col("__first"))).drop("__first")
    if not group:
        df, most = df.orderBy(order).limit(most), None
    w = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    seen = F.max(stale).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("__stale", seen)
    if most is not None:
        rows = rows.withColumn("__n", F.row_number().over(w.orderBy(order))).where(F.col("__n") <= most).drop("__n")
    return rows.where(~F.col("__stale")).drop("__stale")
