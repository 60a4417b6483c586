"""Sitemaps as a data source: where it stops, what it asks for, and what a stream's batches hold."""

from __future__ import annotations

import datetime as dt

import pytest

from postmill.sources import sitemaps as S

AT = dt.datetime(2024, 1, 10, tzinfo=dt.UTC)


def _at(days):
    return (AT - dt.timedelta(days=days)).isoformat()


def _entries(rows, asked=None):
    for k, (u, at) in enumerate(rows):
        yield k, u, at, lambda u=u: (asked.append(u) if asked is not None else None, u)[1]


def test_moment():
    assert S.moment("2024-01-10") == S.moment("20240110T000000Z") == S.moment("2024-01-10T05:30:00+05:30") == AT
    assert [S.moment(x) for x in (None, "", "soon", "2024-W02-3", "2024-13-01")] == [None] * 5


def test_nothing_behind_an_old_entry_is_asked_for():
    asked = []
    rows = [("a", _at(0)), ("b", None), ("c", "soon"), ("d", _at(9)), ("e", _at(0))]
    got = [u for _, u, _, _ in S.fresh(_entries(rows, asked), AT - dt.timedelta(days=1), None, lambda h: None)]
    assert got == asked == ["a", "b", "c"]
    assert [r[1] for r in S.fresh(_entries(rows), None, 2, lambda h: None)] == ["a", "b"]
    seen = {"b": AT - dt.timedelta(days=5)}
    assert [r[1] for r in S.fresh(_entries(rows), AT - dt.timedelta(days=1), None, seen.get)] == ["a"]


@pytest.mark.parametrize(
    ("after", "until", "want"),
    [
        (None, 1, "bcd"),
        (2, 0, "ab"),
        (0, 0, ""),
        (["gone", _at(2.5)], 1, "bc"),  # the last one seen has left the sitemap
        (2, ["gone", _at(0.5)], "b"),  # so has the newest
    ],
)
def test_between_two_offsets(after, until, want):
    rows = [("a", _at(0)), ("b", _at(1)), ("c", _at(2)), ("d", _at(3))]
    named = lambda x: list(rows[x]) if isinstance(x, int) else x
    assert "".join(e[1] for e in S.between(_entries(rows), named(after), named(until))) == want


def test_without_dates_a_lost_offset_reads_the_whole_sitemap():
    rows = [(u, None) for u in "abc"]
    assert [e[1] for e in S.between(_entries(rows), ["b", None], ["a", None])] == ["a"]
    assert [e[1] for e in S.between(_entries(rows), ["gone", None], ["lost", None])] == ["a", "b", "c"]


def test_archive_of_odd_rows(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    rows = [("x y/z", 2, "b", None, "p"), ("x y/z", 1, "a", "bad", None), (None, 1, "n", None, "p"), ("m", None, "n", None, "p"), ("m", 1, None, None, "p"), ("é=%", 5, "c", _at(0), "")]
    S.archive(spark.createDataFrame([(*r, 1) for r in rows], "sitemap string, pos int, url string, at string, html string, more int"), path)
    S.register(spark)
    got = spark.read.format("sitemaps").option("path", path).load()
    assert sorted(tuple(r) for r in got.collect()) == [("x y/z", 2, "b", None, "p"), ("é=%", 5, "c", _at(0), "")]
    assert got.rdd.getNumPartitions() == 2
    assert spark.read.format("sitemaps").option("path", f"{path}-none").load().count() == 0
    with pytest.raises(Exception, match="ISO-8601"):
        spark.read.format("sitemaps").option("path", path).option("since", "soon").load().collect()


def test_an_archive_is_not_read_behind_the_stop(tmp_path, spark, monkeypatch):
    import pyarrow.parquet as pq

    path = str(tmp_path / "archive")
    rows = spark.range(4000).selectExpr("'s' sitemap", "id pos", "concat('u', id) url", "cast(date_sub(date'2024-01-10', cast(id div 100 as int)) as string) at", "repeat(sha2(cast(id as string), 512), 40) html")
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    S.archive(rows, path)
    spark.conf.unset("spark.sql.parquet.compression.codec")
    read, one = [], pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, k, **o: (read.append(self.num_row_groups), one(self, k, **o))[1])
    got = list(S.fresh(S.Archive(path).entries("s"), AT - dt.timedelta(days=2), None, lambda h: None))
    assert len(got) == 300 and len(read) == 1 and read[0] > 2


def test_sites_through_a_function_that_fetches(spark):
    loc = "https://www.talentd.in/jobs/{}"
    xml = "".join(f"<loc>{loc.format(k)}</loc><lastmod>{t}</lastmod>" for k, t in {"a": _at(0), "b": "bad", "gone": _at(0), "down": _at(0), "old": _at(8), "late": _at(0)}.items())

    def fetch(u):
        if u.endswith("sitemap.xml"):
            return (200, xml) if "talentd" in u else (500, None)
        if u.endswith(("down", "old", "late")):
            raise OSError(u)
        return (404, "x") if u.endswith("gone") else (200, "page")

    S.register(spark, fetch, wait=lambda s: None)
    got = spark.read.format("sitemaps").option("sources", '["talentd"]').option("since", _at(1)).load()
    assert [r.url for r in got.orderBy("pos").collect()] == [loc.format("a"), loc.format("b")]
    with pytest.raises(Exception, match="sitemap answered 500"):
        spark.read.format("sitemaps").load().collect()
