"""Sitemaps as a data source of Spark: ``register(spark)``, then ``spark.read`` or ``spark.readStream`` with format "sitemaps".

A sitemap is a partition, and one task reads it from its newest entry on and stops within it: before the first entry older than
``since``, before the first page whose own date is, or after ``most`` entries. Nothing behind that place is read or asked for.
Entries are in the order of the sitemap. A stream's offset is the newest entry seen of each sitemap; a
batch holds the entries between two such, so nothing is listed on the driver but the first entry of every sitemap.

Sitemaps come from an archive (option ``path``), a folder that ``archive`` writes and may add to; or from sites, for which ``register`` takes the
function that fetches and option ``sources`` names them, all by default.

Defined results: an entry or page without a date, or with one that isn't ISO-8601, never ends the reading; dates without an offset are
UTC; pages that can't be had are skipped, but count as entries; a sitemap without entries has no rows; one that can't be had fails the read.
Where the last entry seen has left a sitemap, a batch ends at the first older one; if there are no dates it holds the whole
sitemap once more, which ``ingest`` takes for what it has. Columns of an archive's rows beyond its own are left out.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from postmill.sources.base import all_sources, get_source

SCHEMA = "sitemap string, pos long, url string, at string, html string"
#: Bytes of a row group, the least that is read of an archive's file.
GROUP_BYTES = 4 << 20

#: Place, URL, date, and a function for the page's text, None where it can't be had.
Entry = tuple[int, str, str | None, Callable[[], str | None]]
Fetch = Callable[[str], tuple[int, str | None]]
Peek = Callable[[str, str], dt.datetime | None]


class SitemapError(RuntimeError):
    """A sitemap that can't be had: there is nothing to skip to."""


def moment(text: str | None) -> dt.datetime | None:
    """An ISO-8601 date or time, None if it isn't one."""
    if not text or not re.match(r"\d{4}-?\d{2}-?\d{2}([T ]|$)", text):
        return None
    try:
        when = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    return when if when.tzinfo else when.replace(tzinfo=dt.UTC)


def archive(rows: DataFrame, path: str) -> None:
    """Adds rows (sitemap, pos, url, at, html) to an archive. Rows added later must be newer, so with lower places than those of
    their sitemap that are there. A sitemap's rows go through one task; the protocol allows 50,000."""
    own = rows.where("sitemap is not null and pos is not null and url is not null").select("sitemap", F.col("pos").cast("bigint"), "url", F.col("at").cast("string"), "html")
    own.repartition("sitemap").sortWithinPartitions("sitemap", "pos", "url").write.mode("append").option("parquet.block.size", GROUP_BYTES).partitionBy("sitemap").parquet(path)


@dataclass(frozen=True)
class Archive:
    path: str

    def names(self) -> list[str]:
        from pyarrow import fs

        system, base = self._base()
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(unquote(f.base_name.partition("=")[2]) for f in found if f.base_name.startswith("sitemap="))

    def entries(self, name: str) -> Iterator[Entry]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = self._base()
        folders = [f.path for f in system.get_file_info(fs.FileSelector(base)) if unquote(f.base_name) == f"sitemap={name}"]
        paths = [f.path for folder in folders for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
        firsts = []
        for path in paths:
            meta = pq.read_metadata(path, filesystem=system)
            column = meta.schema.names.index("pos")
            if meta.num_rows:
                firsts.append((meta.row_group(0).column(column).statistics.min, path))
        for _, path in sorted(firsts):
            with system.open_input_file(path) as source:
                file = pq.ParquetFile(source)
                for k in range(file.num_row_groups):
                    for row in file.read_row_group(k, columns=["pos", "url", "at", "html"]).to_pylist():
                        yield row["pos"], row["url"], row["at"], lambda row=row: row["html"]

    def _base(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.path[5:].lstrip("/")
        return fs.FileSystem.from_uri(self.path)


@dataclass(frozen=True)
class Sites:
    fetch: Fetch
    sources: tuple[str, ...]
    wait: Callable[[float], None]

    def names(self) -> list[str]:
        return sorted(self.sources)

    def entries(self, name: str) -> Iterator[Entry]:
        source = get_source(name)
        status, xml = self.fetch(source.sitemap_url)
        if status != 200:
            raise SitemapError(f"{name}: sitemap answered {status}")

        def page(url: str) -> str | None:
            try:
                status, text = self.fetch(url)
            except Exception:
                return None
            finally:
                self.wait(source.crawl_delay_seconds)
            return text if status == 200 else None

        for k, m in enumerate(re.finditer(source.sitemap_pattern, xml or "")):
            yield k, m.group(1), m.group(2) if m.re.groups > 1 else None, lambda url=m.group(1): page(url)


def fresh(entries: Iterator[Entry], since: dt.datetime | None, most: int | None, peek: Callable[[str], dt.datetime | None]) -> Iterator[tuple[int, str, str | None, str]]:
    """The pages up to the first old entry or page."""
    old = lambda t: since is not None and t is not None and t < since
    for pos, url, at, page in islice(entries, most):
        if old(moment(at)):
            return
        html = page()
        if html is None:
            continue
        if old(peek(html)):
            return
        yield pos, url, at, html


def between(entries: Iterator[Entry], after: list | None, until: list) -> Iterator[Entry]:
    """The entries from the one that was the newest, ``until``, to before the one that was it earlier. Both are (URL, date)."""
    begun = False
    last = moment(after[1]) if after else None
    upper = moment(until[1])
    for e in entries:
        when = moment(e[2])
        if not begun and [e[1], e[2]] != until and when and upper and when > upper:
            continue  # has come since
        begun = True
        if after and ([e[1], e[2]] == after or (when and last and when < last)):
            return
        yield e


@dataclass
class Sitemap(InputPartition):
    name: str
    after: list | None = None
    until: list | None = None


class _Reading:
    def __init__(self, listing: Archive | Sites, options: dict[str, str], peek: Peek):
        self.listing, self.peek = listing, peek
        self.since = moment(options.get("since"))
        if options.get("since") and self.since is None:
            raise ValueError("since must be an ISO-8601 time")
        self.most = int(options["most"]) if "most" in options else None

    def read(self, partition: Sitemap | None):
        if partition is None:  # what Spark asks for where there are no sitemaps
            return
        entries = self.listing.entries(partition.name)
        if partition.until:
            entries = between(entries, partition.after, partition.until)
        for row in fresh(entries, self.since, self.most, lambda html: self.peek(partition.name, html)):
            yield (partition.name, *row)


class _Batch(_Reading, DataSourceReader):
    def partitions(self):
        return [Sitemap(n) for n in self.listing.names()]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self):
        return {}

    def latestOffset(self):
        heads = {n: next(self.listing.entries(n), None) for n in self.listing.names()}
        return {n: [e[1], e[2]] for n, e in heads.items() if e}

    def partitions(self, start, end):
        return [Sitemap(n, start.get(n), head) for n, head in end.items() if start.get(n) != head]

    def commit(self, end):
        pass


def register(spark: SparkSession, fetch: Fetch | None = None, peek: Peek | None = None, wait: Callable[[float], None] = time.sleep) -> None:
    """Makes the format known to the session. peek gives a page's own date by its sitemap's name and text."""
    known = tuple(s.source_name for s in all_sources())
    look = peek or (lambda name, html: None)

    class Sitemaps(DataSource):
        @classmethod
        def name(cls):
            return "sitemaps"

        def schema(self):
            return SCHEMA

        def _listing(self):
            if "path" in self.options:
                return Archive(self.options["path"])
            if fetch is None:
                raise ValueError("sitemaps need a path, or a function that fetches")
            named = json.loads(self.options["sources"]) if "sources" in self.options else known
            return Sites(fetch, tuple(named), wait)

        def reader(self, schema):
            return _Batch(self._listing(), self.options, look)

        def streamReader(self, schema):
            return _Stream(self._listing(), self.options, look)

    spark.dataSource.register(Sitemaps)
