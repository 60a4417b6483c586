"""Finalising, external filter, recheck after resolution, and run statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text, url
from postmill.schema import PARSED, conform, valid


def finalize(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Canonical records with id, fingerprint and scraped_at, ``is_valid``, and url and ``corrupt`` of the source; nothing is dropped here."""
    c = F.col
    rows = rows.withColumns(
        {
            "scraped_at": F.lit(as_of),
            "fingerprint": text.fingerprint(c("title"), c("company"), c("location")),
            "id": text.job_id(c("source"), c("external_id")),
        }
    )
    return conform(rows, PARSED).withColumn("is_valid", valid())


def external(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("apply_type") == "EXTERNAL").withColumn("is_external", F.lit(True))


def recheck(rows: DataFrame) -> DataFrame:
    """No longer external where the link turned out to lead to a job board; never the other way round."""
    return rows.withColumn("is_external", F.col("is_external") & ~url.is_aggregator(F.col("resolved_domain")))


def run_stats(rows: DataFrame, totals: bool = True) -> DataFrame:
    """Counters for each source, and over all with a null source; ``error`` is 0, see with_errors. Needs the flags is_valid, was_external,
    is_external, and outcome (inserted or merged, else null)."""
    grouped = rows.rollup("source") if totals else rows.groupBy("source")
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    c = F.col
    return grouped.agg(
        F.count("*").alias("fetched"), n(c("is_valid")).alias("normalized"), n(~c("is_valid")).alias("dropped_invalid"), n(c("was_external")).alias("external_kept"),
        n(c("was_external") & ~c("is_external")).alias("downgraded_after_resolution"), n(c("outcome") == "inserted").alias("inserted"), n(c("outcome") == "merged").alias("merged_duplicates"),
        n((c("outcome") == "inserted") & c("rewritten_description").isNotNull()).alias("rewritten"), F.lit(0).cast("bigint").alias("error"),
    )


def with_errors(stats: DataFrame, names: list[str]) -> DataFrame:
    """stats with a row for each source that failed, and their number in the total."""
    if not names:
        return stats
    counts = [c for c in stats.columns if c not in ("source", "error")]
    failed = stats.sparkSession.createDataFrame([(n,) for n in sorted(names)], "source string").select("source", *[F.lit(0).cast("bigint").alias(c) for c in counts], F.lit(1).cast("bigint").alias("error"))
    known = stats.withColumn("error", F.when(F.col("source").isNull(), len(names)).otherwise(F.col("error")).cast("bigint"))
    return known.unionByName(failed)


#: The counters of a run, in the order of its report.
COUNTERS = ("fetched", "normalized", "dropped_invalid", "external_kept", "downgraded_after_resolution", "inserted", "merged_duplicates", "rewritten", "error", "corrupt")


def first_counters() -> list[F.Column]:
    """What is counted of one source's records while they are written."""
    read, valid = F.col("corrupt").isNull(), F.col("is_valid")
    n = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    return [n(read, "fetched"), n(read & valid, "normalized"), n(read & ~valid, "dropped_invalid"), n(read & valid & (F.col("apply_type") == "EXTERNAL"), "external_kept"), n(~read, "corrupt")]


def later_counters(name: str, test: F.Column, sources) -> list[F.Column]:
    """What is counted of rows of several sources: a column for each one, ``name:source``."""
    return [F.count_if(F.coalesce(test & (F.col("source") == s), F.lit(False))).alias(f"{name}:{s}") for s in sources] or [F.count("*").alias("rows")]


def add(counts: dict[str, dict[str, int]], seen: dict[str, int]) -> None:
    """Puts what later_counters counted into the sources' counts."""
    for key, n in seen.items():
        name, _, source = key.partition(":")
        if source:
            counts[source][name] = n


def noted(counts: dict[str, dict[str, int]], failed: dict[str, str]) -> dict[str, dict[str, int]]:
    """The counts with those of the sources that failed."""
    return {s: {**dict(counts.get(s, {})), **({"error": 1} if s in failed else {})} for s in {**counts, **failed}}


def counted(spark: SparkSession, counts: dict[str, dict[str, int]], failed: dict[str, str]) -> DataFrame:
    """The report of a run: a row for each source, and the total with a null source."""
    rows = {s: [n.get(c, 0) for c in COUNTERS] for s, n in sorted(noted(counts, failed).items())}
    total = [sum(x) for x in zip(*rows.values(), strict=True)] or [0] * len(COUNTERS)
    return spark.createDataFrame([(s, *n) for s, n in [*rows.items(), (None, total)]], "source string, " + ", ".join(f"{c} bigint" for c in COUNTERS))
