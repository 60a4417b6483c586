"""Every query that has an SQL form gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    d.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return d


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dedup_greedy_is_the_sequential_rule(spark):
    """Over all arrivals, one after another."""
    taken, kept = set(), []
    for r in sorted(catalog._arrivals(spark, DIR).collect(), key=lambda r: r.seq):
        own = {(k, r[k]) for k in ("fingerprint", "url_key", "id") if r[k] is not None}
        if not own & taken:
            taken |= own
            kept.append((r.seq, r.id))
    assert sorted(tuple(r) for r in catalog.dedup_greedy(spark, DIR).collect()) == kept
