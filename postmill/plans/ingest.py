"""From pages to a new snapshot of the store, and the liveness pass."""

from __future__ import annotations

import datetime as dt
import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from postmill.config import Settings
from postmill.operators import dedup, network, records
from postmill.operators.store import Store
from postmill.plans import crawl
from postmill.runtime import discard, written
from postmill.schema import JOBS, PAGES, PARSED
from postmill.sources.base import Source, all_sources, run

log = logging.getLogger(__name__)


def canonical(pages: DataFrame, sources: list[Source], as_of: dt.datetime, settings: Settings) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]], dict[str, str]]:
    """Written records of each source, finalised, with counts made as they were written, and what went wrong with the sources that failed: each one is a
    job of its own. pages may name a source; else each page is offered to every one."""
    out, counts, failed = {}, {}, {}
    for s in sources:
        own = pages.where(F.col("source") == s.source_name) if "source" in pages.columns else pages
        try:
            rows = records.finalize(run(s, own.select("url", "html"), as_of, settings.max_job_age_hours), as_of)
            seen = Observation()
            out[s.source_name] = written(rows.observe(seen, *records.first_counters()), f"records-{s.source_name}")
            counts[s.source_name] = seen.get
        except Exception as e:  # whatever a source does, the others' rows are stored
            log.exception("source %s failed", s.source_name)
            failed[s.source_name] = f"{type(e).__name__}: {e}"
    return out, counts, failed


def ingest(pages: DataFrame, store: Store, as_of: dt.datetime, settings: Settings | None = None, names: list[str] | None = None, resolve: network.Resolve | None = None, rewrite: network.Rewrite | None = None, name: str | None = None, unfetched: dict[str, str] | None = None, memo: Store | None = None) -> DataFrame:
    """Runs all steps and commits what they change; returns the counters for each source and in total. Records that can't be read are
    kept aside, with their page and the reason (``store.skipped``). memo: resolutions of earlier runs, which aren't asked for again. unfetched: sources that gave no pages, and why; they count as errors too. A name that the store knows was run before: its
    counters are returned, and nothing is done."""
    settings = settings or Settings()
    sources = [s for s in all_sources() if names is None or s.source_name in names]
    if not sources:
        raise ValueError(f"no such sources: {names}")
    name = name or uuid.uuid4().hex
    if store.has(name):
        return records.counted(pages.sparkSession, store.note(name) or {}, {})
    tables, counts, failed = canonical(pages, sources, as_of, settings)
    rows = reduce(DataFrame.unionByName, tables.values(), pages.sparkSession.createDataFrame([], PARSED).withColumn("is_valid", F.lit(True)))
    if any(n["corrupt"] for n in counts.values()):
        store.bury(rows.where("corrupt is not null").select("source", "url", F.col("corrupt").alias("error")), name)
    kept = network.resolve(records.external(rows.where("corrupt is null and is_valid").drop("url", "corrupt")), resolve, memo=memo, as_of=as_of)
    seen = Observation()
    kept = written(dedup.with_url_key(records.recheck(kept)).observe(seen, *records.later_counters("downgraded_after_resolution", ~F.col("is_external"), counts)), "resolved")
    records.add(counts, seen.get)
    # Arrival order: sources by name, then by posting time and id.
    arriving, ranged = _numbered(kept.where("is_external"))
    made: list[DataFrame] = []

    def change(stored: DataFrame) -> DataFrame:
        """What the arrivals change in this state of the store; called again if another run was first."""
        discard(*made)
        made.clear()
        stored = dedup.with_url_key(stored)
        assigned, seen = dedup.assign(arriving, stored), Observation()
        inserted = F.col("target").isNull() & F.col("new_seq").isNull()
        if settings.rewriter_enabled and rewrite is not None:
            made.append(written(assigned, "assigned"))
            new = network.rewrite(made[0].where(inserted), rewrite, settings.rewriter_max_retries, settings.rewriter_concurrency)
            assigned = new.unionByName(made[0].where(~inserted))
        told = [*records.later_counters("inserted", inserted, counts), *records.later_counters("merged_duplicates", ~inserted, counts), *records.later_counters("rewritten", inserted & F.col("rewritten_description").isNotNull(), counts)]
        made.append(written(assigned.observe(seen, *told), "assigned"))
        records.add(counts, seen.get)
        return dedup.changed(made[-1], stored).select(*JOBS.names)

    store.commit(change, name, lambda: records.noted(counts, {**(unfetched or {}), **failed}))
    discard(kept, ranged, *made, *tables.values())
    return records.counted(pages.sparkSession, counts, {**(unfetched or {}), **failed})


def fetched(spark: SparkSession, fetch: crawl.Fetch, as_of: dt.datetime, settings: Settings, names: list[str] | None = None, wait: Callable[[float], None] = time.sleep) -> tuple[DataFrame, dict[str, str]]:
    """Pages (url, html, source) of all sources, a few of them walked at a time, and what went wrong with those that failed."""
    sources = [s for s in all_sources() if names is None or s.source_name in names]

    def one(s: Source) -> DataFrame | str:
        try:
            return crawl.walk(spark, s, fetch, as_of, settings, wait=wait).withColumn("source", F.lit(s.source_name))
        except Exception as e:  # whatever a site does, the others are walked
            log.exception("source %s gave no pages", s.source_name)
            return f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=max(1, settings.max_concurrent_sources)) as pool:
        got = dict(zip([s.source_name for s in sources], pool.map(one, sources), strict=True))
    none = spark.createDataFrame([], PAGES).withColumn("source", F.lit(""))
    return reduce(DataFrame.union, [x for x in got.values() if isinstance(x, DataFrame)], none), {n: x for n, x in got.items() if isinstance(x, str)}


def fetch_and_ingest(spark: SparkSession, fetch: crawl.Fetch, store: Store, as_of: dt.datetime, settings: Settings | None = None, names: list[str] | None = None, wait: Callable[[float], None] = time.sleep, **rest) -> DataFrame:
    """A whole run, from the sitemaps to a snapshot; rest as of ingest."""
    settings = settings or Settings()
    pages, failed = fetched(spark, fetch, as_of, settings, names, wait)
    return ingest(pages, store, as_of, settings, names, unfetched=failed, **rest)


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with seq, their place in a total order, found without bringing them to one task: numbers of
    range partitions, each after the counts of those before it. Also the table that this reads."""
    order = ["source", "posted_at", "id", "raw_apply_url", "title"]
    ranged = written(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    counts = counts.select("__p", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__n", own).join(F.broadcast(counts), "__p").withColumn("seq", F.col("__before") + F.col("__n")).drop("__p", "__n", "__before"), ranged


def check_links(store: Store, table: DataFrame | None = None, call: network.Status | None = None, delay: float = 0.0) -> dict:
    """Deactivates jobs whose link is gone; counts what was checked and deactivated, as they are written. With a delay, one task asks link after link."""
    jobs = store.read()
    if table is None:
        table = network.statuses(jobs, call or (lambda u: 200), **({"tasks": 1, "delay": delay} if delay else {}))
    table = written(table, "statuses")
    seen = Observation()
    active = jobs.where("is_active").select("id", network.link_of().alias("link")).join(table, "link", "left").withColumn("dead", network.is_dead())
    told = written(active.select("id", "dead").observe(seen, F.count("*").alias("checked"), F.count_if("dead").alias("deactivated")), "checked")
    counts = dict(seen.get)
    if counts["deactivated"]:
        store.deactivate(told.where("dead"))
    discard(table, told)
    return counts
