"""Pages to store: extraction, filters, deduplication, snapshots, queries, streaming."""

import datetime as dt
import json
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.config import Settings
from postmill.functions import display
from postmill.operators import dedup, network
from postmill.operators.store import Store
from postmill.plans import catalog, client, crawl, ingest, jobs, social
from postmill.schema import JOBS, PUBLIC, conform
from postmill.sources import base
from postmill.sources.base import get_source, run
from postmill.sources.html import page_parts, to_text
from postmill.streaming import ingest_stream, page_stream

AS_OF = dt.datetime(2026, 8, 7, 12, tzinfo=dt.UTC)


def ago(hours):
    return (AS_OF - dt.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def chunk(s):
    return f"self.__next_f.push([1,{json.dumps(s)}])"


def flat_page(body="<h3>Näme</h3><p>Text ☃ here</p>", split=False, **over):
    job = {"title": "Backend Developer", "slug": "backend-1", "companyName": "Acme", "jobType": "full-time", "experience": "2-4", "domain": "Engineering", "location": "Pune", "country": "India", "skills": "Python, Django", "applyUrl": "https://careers.acme.com/1", "workplaceType": "remote", "postedAt": ago(1), "salary": "10-20 LPA", "description": "$21"} | over
    head = '5:["x",{"initialJob":' + json.dumps(job, ensure_ascii=False) + ',"similarJobs":[]}]\n'
    row = f"21:T{len(body.encode()):x},{body}22:I[1]"
    parts = [head[:40], head[40:] + row[:9], row[9:]] if split else [head, row]
    return "<html>" + "".join(f"<script>{chunk(p)}</script>" for p in parts) + r'<script>self.__next_f.push([1,"bad \x escape"])</script></html>'


def graph_page(streamed=True, link='<a target="_blank" href="https://jobs.acme.com/9">Apply <b>Now</b></a>', block='<div class="jobContent_jobContent__aB1"><p>Full</p><div>inner</div></div>', **over):
    job = {"@type": "JobPosting", "title": "Software Engineer", "description": "<p>Short</p>", "employmentType": ["FULL_TIME", "INTERN"], "jobLocation": [{"address": {"addressLocality": "Delhi", "addressRegion": "DL", "addressCountry": "in"}}], "hiringOrganization": {"name": "Acme"}, "datePosted": ago(1), "baseSalary": {"currency": "INR", "value": {"minValue": 1000000, "maxValue": 2000000, "unitText": "YEAR"}}, "skills": "Java, SQL", "experienceRequirements": {"monthsOfExperience": 24}, "url": "https://www.talentd.in/x"} | over
    data = json.dumps({"@context": "https://schema.org", "@graph": [{"@type": "BreadcrumbList"}, job]})
    script = f"<script>{chunk('noise')}</script><script>{chunk(data)}</script>" if streamed else f'<script type="application/ld+json">{data}</script>'
    return f'<html>{script}<a target="_blank" href="https://talentd.in/hub">Hub</a>{link}{block}</html>'


def parsed(spark, name, *pages):
    df = spark.createDataFrame([(f"https://site/job/p-{i}/", h) for i, h in enumerate(pages)], "url string, html string")
    return {r.url[19:-1]: r for r in run(get_source(name), df, AS_OF).collect()}


def test_flat(spark):
    long = "<p>" + "ж" * 10_000 + "</p>"
    got = parsed(spark, "jobfound", flat_page(), flat_page(split=True), flat_page(body=long), flat_page(country="UK"), flat_page(postedAt=ago(48)), flat_page(postedAt=None), flat_page(country=""), "<html></html>", None,
                 flat_page(description="<p>Inline</p>", salary=None, jobType=None, workplaceType="", skills="", domain="", experience="", location=None, applyUrl=""), flat_page(description="$99"))
    assert sorted(got) == ["0", "1", "10", "2", "9"]
    a = got["0"]
    assert (a.title, a.company, a.external_id, a.is_remote, a.seniority, a.salary_min, a.salary_max, a.apply_type) == ("Backend Developer", "Acme", "backend-1", True, "junior", 1000000, 2000000, "EXTERNAL")
    assert a.description_original == "Näme\nText ☃ here" == got["1"].description_original and a.tags == ["Python", "Django", "Engineering"] and a.source_fields_missing == []
    assert got["2"].description_original == "ж" * 10_000
    b = got["9"]
    assert b.description_original == "Inline" and b.source_fields_missing == ["location", "is_remote", "employment_type", "seniority", "salary_min", "salary_max", "salary_period", "salary_raw", "tags", "raw_apply_url"]
    assert got["10"].description_original is None and "description_original" in got["10"].source_fields_missing


def test_graph(spark):
    got = parsed(spark, "talentd", graph_page(), graph_page(streamed=False), graph_page(title="Sales Executive"), graph_page(jobLocation=[{"address": {"addressCountry": "GB"}}]), graph_page(jobLocation=None, employmentType="full-time, remote", experienceRequirements="8-10 years", baseSalary=None, skills=None, block="", title="Developer"),
                 graph_page(datePosted=None), "<html>{}</html>", graph_page(experienceRequirements={"monthsOfExperience": True}, title="Fresher Developer", link='<a target="_blank" href="https://x.io/">Go</a>'))
    assert sorted(got) == ["0", "1", "4", "7"]
    a = got["0"]
    assert (a.location, a.employment_type, a.seniority, a.salary_raw, a.salary_min, a.raw_apply_url, a.is_remote) == ("Delhi, DL", "full-time", "junior", "1000000-2000000 per annum", 1000000, "https://jobs.acme.com/9", False)
    assert a.description_original == "Full\ninner" and a.source_fields_missing == ["is_remote"] and a.external_id == "p-0"
    b = got["4"]
    assert (b.location, b.is_remote, b.seniority, b.description_original, b.salary_currency) == (None, True, "senior", "Short", "INR")
    assert (got["7"].seniority, got["7"].raw_apply_url) == ("fresher", "https://x.io/")


def test_html():
    assert to_text("<p> a </p><script>x</script>\n<b>b &amp; c</b>") == "a\nb & c"
    assert page_parts('<div class="x jobContent_jobContent__Z"><div>1</div>2</div>3', "own")[1] == '<div class="x jobContent_jobContent__Z"><div>1</div>2</div>'
    assert page_parts(None, "own") == (None, None)


def test_cut_references_are_text():
    assert to_text("<p>a &amp</p><p>b&ampc; &copy; &#65;&quo</p>\x0b&nbsp;<p> d & e </p>") == "a &amp\nb&ampc; © A&quo\n\x0b\xa0\nd & e"


def test_registry():
    assert [s.source_name for s in base.all_sources()] == ["jobfound", "talentd"]
    with pytest.raises(KeyError, match="jobfound"):
        get_source("none")


def test_sitemap(spark):
    from postmill.sources import flat, graph

    xml = "<url><loc>https://www.jobfound.org/job/a</loc></url><loc>https://jobfound.org/hub</loc><loc>https://jobfound.org/job/b</loc>"
    two = "<loc>https://www.talentd.in/jobs/a</loc> <lastmod>2026-08-07</lastmod><loc>https://www.talentd.in/jobs/b</loc><x/><loc>https://www.talentd.in/jobs/c</loc><lastmod>bad</lastmod>"
    row = spark.range(1).select(base.sitemap_locations(F.lit(xml), flat.SITEMAP).alias("a"), base.sitemap_entries(F.lit(two), graph.SITEMAP).alias("b")).first()
    assert row.a == ["https://www.jobfound.org/job/a", "https://jobfound.org/job/b"]
    assert [(x[0][-1], x[1]) for x in row.b] == [("a", "2026-08-07"), ("c", "bad")]


def sequential(rows, stored=()):
    """The rule itself, one row at a time."""
    kept = [dict(r, seq=-1) for r in sorted(stored, key=lambda r: (r["scraped_at"], r["id"]))]
    into = {}
    for r in rows:
        hit = next((s for k in ("fingerprint", "url_key", "id") for s in kept if r[k] is not None and s[k] == r[k]), None)
        if hit is None:
            kept.append(r)
        into[r["seq"]] = hit and hit["id"]
    return into


def random_rows(rng, n, keys):
    pick = lambda: rng.randrange(keys)
    return [{"seq": i, "id": f"i{rng.randrange(3 * n)}", "fingerprint": f"f{pick()}", "url_key": None if rng.random() < 0.3 else f"u{pick()}", "scraped_at": dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), "source": f"s{pick() % 3}"} for i in range(n)]


@pytest.mark.parametrize(("seed", "share"), [(0, 0), (1, 1), (2, 4), (3, dedup.SHARE)])
def test_dedup_is_the_sequential_rule(spark, monkeypatch, seed, share):
    monkeypatch.setattr(dedup.leaders, "__defaults__", (dedup.KEYS, share))
    rng = random.Random(seed)
    rows = random_rows(rng, 40, 14)
    seen, stored = set(), []
    for r in random_rows(rng, 8, 14):
        if r["id"] not in seen:
            seen.add(r["id"])
            stored.append(r | {"id": f"old-{r['id']}", "scraped_at": r["scraped_at"] - dt.timedelta(days=1)})
    schema = "seq bigint, id string, fingerprint string, url_key string, scraped_at timestamp, source string"
    df, old = (spark.createDataFrame([tuple(r[k] for k in ("seq", "id", "fingerprint", "url_key", "scraped_at", "source")) for r in x], schema) for x in (rows, stored))
    got = {r.seq: r for r in dedup.assign(df, old.drop("seq")).collect()}
    ids = {r["seq"]: r["id"] for r in rows}
    assert {s: r.target or (ids[r.new_seq] if r.new_seq is not None else None) for s, r in got.items()} == sequential(rows, stored)


def test_dedup_cases(spark):
    def case(*keys):
        rows = [{"seq": i, "id": f"i{i}", "fingerprint": f, "url_key": u} for i, (f, u) in enumerate(keys)]
        df = spark.createDataFrame([(r["seq"], r["fingerprint"], r["url_key"], r["id"]) for r in rows], "seq bigint, fingerprint string, url_key string, id string")
        found = [sorted(r.seq for r in dedup.leaders(df, share=n).collect()) for n in (0, dedup.SHARE)]
        assert found[0] == found[1]
        return found[0]

    assert case(("f1", "u1"), ("f2", "u1"), ("f2", "u2")) == [0, 2]
    assert case(("f1", None), ("f2", None)) == [0, 1]
    assert case(("f1", "u1"), ("f2", "u2"), ("f2", "u1")) == [0, 1]


def pages_of(spark, *htmls):
    return spark.createDataFrame([(f"https://site/job/p-{i}/", h) for i, h in enumerate(htmls)], "url string, html string")


def test_ingest_store_query_digest(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/jobs")
    assert store.read().count() == 0 and store.probe() == "connected"
    pages = pages_of(spark, flat_page(), flat_page(slug="copy"), flat_page(title="Data Engineer", slug="d", applyUrl="https://www.linkedin.com/x"), flat_page(title="", slug="t"), graph_page(), flat_page(title="QA", slug="q", applyUrl="https://short.io/1"))
    resolve = lambda u: ("https://in.indeed.com/z", "in.indeed.com") if "short" in u else (u, u.split("/")[2])
    stats = {r.source: r for r in ingest.ingest(pages, store, AS_OF, resolve=resolve).collect()}
    a = stats["jobfound"]
    assert (a.fetched, a.normalized, a.dropped_invalid, a.external_kept, a.downgraded_after_resolution, a.inserted, a.merged_duplicates) == (5, 4, 1, 3, 1, 1, 1)
    assert stats[None].inserted == 2 and stats["talentd"].inserted == 1
    first = store.version()
    saved = store.read()
    assert saved.columns == JOBS.names and saved.count() == 2

    later = AS_OF + dt.timedelta(hours=2)
    ingest.ingest(pages_of(spark, flat_page()), store, later, names=["jobfound"])
    rows = {r.source: r for r in store.read().collect()}
    assert rows["jobfound"].scraped_at == later.replace(tzinfo=None) and rows["jobfound"].merged_sources == [] and store.read(first).count() == 2

    q = jobs.JobQuery(tag="Python", min_salary=0)
    envelope = jobs.listing(store.read(), q)
    assert envelope["total"] == 1 and envelope["items"][0].title == "Backend Developer" and not envelope["items"][0].is_rewritten
    item = json.loads(jobs.as_json(jobs.page(store.read(), q)).first().json)
    assert item["company"] == "Acme" and item["tags"] == ["Python", "Django", "Engineering"] and set(item) == set(PUBLIC)
    job = jobs.get(store.read(), rows["jobfound"].id)
    ld = json.loads(jobs.public(store.read()).where("source = 'jobfound'").select(display.json_ld().alias("x")).first().x)
    assert ld["@type"] == "JobPosting" and ld["employmentType"] == "FULL_TIME" and ld["baseSalary"]["value"]["unitText"] == "YEAR" and "<" not in str(ld["description"])
    assert job.apply_url == "https://careers.acme.com/1" and jobs.get(store.read(), "none") is None
    assert jobs.similar(store.read(), rows["jobfound"].id).count() == 0
    d = social.digest(store.read(), later, "https://example.com").first()
    assert d.job_count == 2 and d.listed_count == 2 and d.fits and "2 new tech jobs" in d.message
    # A job seen again is announced again, since its merge moved scraped_at.
    assert social.digest(store.read(), later, "https://example.com", hours=1).first().job_count == 1
    assert social.readiness(store)[0] == 200

    counts = ingest.check_links(store, call=lambda u: 404 if "careers" in u else 500)
    assert counts == {"checked": 2, "deactivated": 1}
    assert [r.source for r in store.read().where("not is_active").collect()] == ["jobfound"]


def test_stream(spark, tmp_path):
    pages_of(spark, flat_page(), graph_page()).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/jobs")
    for _ in range(2):  # the second run finds no new files
        q = ingest_stream(page_stream(spark, f"{tmp_path}/in"), store, f"{tmp_path}/cp", lambda: AS_OF).trigger(availableNow=True).start()
        q.awaitTermination()
    assert store.read().count() == 2 and [n for n, _ in store.history()] == [0]
    # A second stream on the same store, whose batches begin at 0 again.
    pages_of(spark, flat_page(slug="other", title="Data Engineer", applyUrl="https://careers.acme.com/2")).write.parquet(f"{tmp_path}/in2")
    ingest_stream(page_stream(spark, f"{tmp_path}/in2"), store, f"{tmp_path}/cp2", lambda: AS_OF).trigger(availableNow=True).start().awaitTermination()
    assert store.read().count() == 3 and len({v for _, v in store.history()}) == 2


def test_early_stop(spark):
    rows = [(0, AS_OF), (1, None), (2, AS_OF - dt.timedelta(hours=30)), (3, AS_OF)]
    df = spark.createDataFrame(rows, "pos int, ts timestamp")
    assert [r.pos for r in base.until_stale(df, "pos", "ts", F.lit(AS_OF - dt.timedelta(hours=24))).orderBy("pos").collect()] == [0, 1]
    assert base.until_stale(df, "pos", "ts", F.lit(AS_OF - dt.timedelta(hours=48)), most=3).count() == 3


def test_early_stop_of_any_ids(spark, tmp_path):
    values = {9_000 + i: 1.0 for i in range(500)}
    for stop, n in ((9_499, 499), (9_030, 30)):
        values[stop] = 0.01
        spark.createDataFrame(list(values.items()), "event_id long, value double").repartition(5).write.parquet(f"{tmp_path}/{n}/events.parquet")
        got = catalog.early_stop_prefix(spark, f"{tmp_path}/{n}").collect()
        assert sorted(r.event_id for r in got) == list(range(9_000, 9_000 + n))
        events = spark.read.parquet(f"{tmp_path}/{n}/events.parquet")
        assert base.until_stale(events, "event_id", "value", F.lit(0.05)).count() == stop - 9_000
    assert base.until_stale(events, "event_id", "value", F.lit(0.0)).count() == 500


def test_store_survives_a_crash_and_a_replay(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/jobs")
    first = ingest.ingest(pages_of(spark, flat_page()), store, AS_OF, names=["jobfound"], name="one").collect()
    with monkeypatch.context() as m:
        m.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))  # after the rows, before the manifest
        with pytest.raises(OSError):
            store.write(store.read().limit(0), "two")
    assert store.version() == "v-one" and store.read().count() == 1
    store.write(store.read().limit(0), "two")
    assert store.version() == "v-two" and store.read().count() == 0
    assert store.write(store.read("v-one"), "one") == "v-one" and store.version() == "v-two"  # known, though not current
    assert store.expire(1) == ["v-one"] and store.write(store.read(), "one") == "v-one" and store.version() == "v-two"
    # A run that comes again isn't run: its counters are those of the first time.
    monkeypatch.setattr(ingest, "canonical", None)
    assert ingest.ingest(pages_of(spark, flat_page()), store, AS_OF, names=["jobfound"], name="one").collect() == first


def jobs_of(spark, *ids, source="a"):
    rows = [(i, source, i, "Engineer", "Acme", f"https://x.example.com/{i}", AS_OF, f"f{i}") for i in ids]
    return conform(spark.createDataFrame(rows, "id string, source string, external_id string, title string, company string, raw_apply_url string, scraped_at timestamp, fingerprint string"))


def test_a_name_is_marked_by_whoever_comes_next(spark, tmp_path, monkeypatch):
    """A writer dies between its commit and its mark."""
    store = Store(spark, f"file://{tmp_path}/jobs")
    with monkeypatch.context() as m:
        m.setattr(Store, "_mark", lambda *a: None)
        store.commit(lambda rows: jobs_of(spark, "1"), "one")
    assert store.has("one")  # it is the last commit
    store.commit(lambda rows: jobs_of(spark, "2"), "two")
    calls = []
    store.commit(lambda rows: calls.append(1) or jobs_of(spark, "1", source="b"), "one")
    assert not calls and store.has("one") and sorted(r.source for r in store.read().collect()) == ["a", "a"]


def test_two_writers_keep_both_rows(spark, tmp_path):
    """The second writer commits between the first one's reading and writing."""
    store, other = (Store(spark, f"file://{tmp_path}/jobs") for _ in range(2))
    store.write(jobs_of(spark, *map(str, range(40))), "start")
    seen = []

    def change(rows):
        seen.append(rows.count())
        if len(seen) == 1:
            other.commit(lambda r: jobs_of(spark, "q"), "q")
        return jobs_of(spark, "p")

    store.commit(change, "p")
    assert seen == [40, 41] and {"p", "q"} <= {r.id for r in store.read().collect()}
    assert [n for n, _ in store.history()] == [0, 1, 2] and store.read("v-q").count() == 41
    assert not store._point(2, {}) and store.version() == "v-p"  # no number is given twice


def test_a_change_copies_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/jobs", buckets=8)
    store.write(jobs_of(spark, *map(str, range(400))), "start")
    before = set(store.read().inputFiles())
    store.deactivate(spark.createDataFrame([("7",), ("none",)], "id string"))
    after = set(store.read().inputFiles())
    assert len(before) == 8 and len(before - after) == 1 == len(after - before)
    assert [r.id for r in store.read().where("not is_active").collect()] == ["7"] and store.read().count() == 400
    store.deactivate(spark.createDataFrame([("7",)], "id string"))  # nothing to change
    assert set(store.read().inputFiles()) == after
    assert store.expire(1) == ["v-start"] and store.read().count() == 400


def test_a_lookup_skips_row_groups(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/jobs", buckets=4)
    store.write(jobs_of(spark, *(f"{k:05d}" for k in range(0, 4000, 2))))
    got = store.lookup("00006")
    assert [r.id for r in got.collect()] == ["00006"] and len(got.inputFiles()) == 1

    def scanned(df):
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        found = []

        def walk(p):
            if p.nodeName().startswith("Scan"):
                found.append(p.metrics().apply("numOutputRows").value())
            for i in range(p.children().size()):
                walk(p.children().apply(i))

        walk(plan)
        return sum(found)

    # An id within the file's range, and a fingerprint, that are not there: their Bloom filters leave no row group to read.
    assert scanned(store.lookup("00007")) == 0 < scanned(store.lookup("00006"))
    assert scanned(store.read().where("fingerprint = 'f00007'")) == 0 < scanned(store.read().where("fingerprint = 'f00006'"))


def test_columns_are_resolved_at_reading(spark, tmp_path, monkeypatch):
    """A store that was written before one column and after another."""
    from postmill.operators import store as module

    old = T.StructType([f for f in JOBS if f.name != "rewritten_description"] + [T.StructField("dropped", T.StringType())])
    store = Store(spark, f"file://{tmp_path}/jobs")
    with monkeypatch.context() as m:
        m.setattr(module, "conform", lambda df, schema=None: conform(df, old))
        store.write(jobs_of(spark, "1", "2", "3"))
    assert store.read().columns == JOBS.names and store.read().where("rewritten_description is null").count() == 3
    store.commit(lambda rows: rows.where("id = '2'").withColumn("rewritten_description", F.lit("new")))
    assert sorted((r.id, r.rewritten_description) for r in store.read().collect()) == [("1", None), ("2", "new"), ("3", None)]


def test_a_bad_page_costs_one_record(spark, tmp_path):
    bad = "<p>a<![bogus[x]]>b"
    pages = pages_of(spark, flat_page(), flat_page(body=bad, slug="bad"), flat_page(slug="c", title="QA Engineer", applyUrl="https://careers.acme.com/3"), graph_page(), graph_page(block=f'<div class="jobContent_jobContent__a">{bad}</div>'))
    store = Store(spark, f"file://{tmp_path}/jobs")
    stats = {r.source: r for r in ingest.ingest(pages, store, AS_OF, name="run").collect()}
    assert [(stats[s].fetched, stats[s].corrupt, stats[s].inserted, stats[s].error) for s in ("jobfound", "talentd", None)] == [(2, 1, 2, 0), (1, 1, 1, 0), (3, 2, 3, 0)]
    skipped = store.skipped().orderBy("url").collect()
    assert [(r.source, r.url[-2]) for r in skipped] == [("jobfound", "1"), ("talentd", "4")] and all("Error" in r.error for r in skipped)
    ingest.ingest(pages_of(spark, flat_page()), store, AS_OF, name="later")
    assert store.skipped().count() == 2


def test_a_failing_source_leaves_the_others(spark, tmp_path, monkeypatch):
    from postmill.sources.base import get_source

    def broken(pages, as_of, hours):
        raise ValueError("no such shape")

    monkeypatch.setattr(get_source("talentd"), "parse", broken, raising=False)
    store = Store(spark, f"file://{tmp_path}/jobs")
    stats = {r.source: r for r in ingest.ingest(pages_of(spark, flat_page(), graph_page()), store, AS_OF).collect()}
    assert stats["talentd"].error == 1 and stats["talentd"].fetched == 0 and stats[None].error == 1 and stats["jobfound"].error == 0
    assert [r.source for r in store.read().collect()] == ["jobfound"]


def _site(xml, pages):
    asked = []

    def fetch(u):
        asked.append(u)
        if u.endswith("sitemap.xml"):
            return 200, xml
        got = pages[u]
        if got is None:
            raise OSError("unreachable")
        return got

    return fetch, asked


def test_walk_stops_at_the_first_old_page(spark):
    pages = {f"https://jobfound.org/job/{k}": (200, flat_page(postedAt=ago(40 if k in (6, 8) else 1) if k != 3 else None)) for k in range(12)}
    pages["https://jobfound.org/job/1"], pages["https://jobfound.org/job/2"] = None, (404, "gone")
    fetch, _ = _site("".join(f"<loc>{u}</loc>" for u in pages), pages)
    got = crawl.walk(spark, get_source("jobfound"), fetch, AS_OF, block=4, wait=lambda s: None)
    assert sorted(int(r.url[-1]) for r in got.collect()) == [0, 3, 4, 5] and got.columns == ["url", "html"]
    capped = crawl.walk(spark, get_source("jobfound"), fetch, AS_OF, Settings(flat_max_pages=4), block=3, wait=lambda s: None)
    assert sorted(int(r.url[-1]) for r in capped.collect()) == [0, 3]


def test_walk_by_the_dates_of_the_sitemap(spark):
    dates = {"hub": ago(0), "a": "bad", "b": ago(2), "c": ago(30), "d": ago(1)}
    pages = {f"https://www.talentd.in/jobs/{k}": (200, graph_page()) for k in dates}
    xml = "".join(f"<loc>https://www.talentd.in/jobs/{k}</loc><lastmod>{t}</lastmod>" for k, t in dates.items())
    del pages["https://www.talentd.in/jobs/c"], pages["https://www.talentd.in/jobs/d"]  # asking for them would raise
    fetch, _ = _site(xml, pages)
    got = crawl.walk(spark, get_source("talentd"), fetch, AS_OF, wait=lambda s: None)
    assert sorted(r.url.rsplit("/", 1)[1] for r in got.collect()) == ["a", "b", "hub"]
    assert crawl.walk(spark, get_source("talentd"), lambda u: (200, ""), AS_OF).count() == 0
    with pytest.raises(crawl.SitemapError):
        crawl.walk(spark, get_source("talentd"), lambda u: (500, ""), AS_OF)


def test_client():
    asked = []

    def send(u):
        asked.append(u)
        if "down" in u:
            raise ConnectionError("refused")
        return (404, "") if "none" in u else (503, "") if "hours" in u else (200, '{"total": 1}')

    api = client.Client(send, "http://api")
    assert api.jobs(q="c++ dev", tag="", source=None, has_salary=False, offset=0) == {"total": 1}
    assert asked == ["http://api/jobs?q=c%2B%2B+dev&has_salary=false&offset=0"]
    assert api.job("none") is None and api.job("a/b") == {"total": 1} and asked[-1] == "http://api/jobs/a%2Fb"
    with pytest.raises(client.ApiError) as e:
        api.digest(24)
    assert e.value.status == 503
    with pytest.raises(client.ApiError) as e:
        client.Client(send, "http://down").jobs()
    assert e.value.status is None


def test_a_run_from_the_sitemaps(spark, tmp_path):
    url = "https://jobfound.org/job/1"
    fetch, _ = _site(f"<loc>{url}</loc>", {url: (200, flat_page())})
    store, only = Store(spark, f"file://{tmp_path}/jobs"), lambda u: (503, None) if "talentd" in u else fetch(u)
    stats = {r.source: r for r in ingest.fetch_and_ingest(spark, only, store, AS_OF, wait=lambda s: None).collect()}
    assert (stats["jobfound"].inserted, stats["jobfound"].error, stats["talentd"].fetched, stats["talentd"].error, stats[None].error) == (1, 0, 0, 1, 1)
    assert [r.title for r in store.read().collect()] == ["Backend Developer"]
    assert ingest.check_links(store, call=lambda u: 404, delay=0.01) == {"checked": 1, "deactivated": 1}


def test_an_object_is_parsed_once(spark):
    raw = get_source("jobfound").parse(pages_of(spark, flat_page()), AS_OF)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson") == 1 and "get_json_object" not in plan
    odd = flat_page().replace('\\"salary\\": \\"10-20 LPA\\"', '\\"salary\\": 12')
    assert [r.salary for r in get_source("jobfound").parse(pages_of(spark, odd, flat_page(salary=True), flat_page(salary=None), flat_page(skills=["a"])), AS_OF).collect()] == ["12", "true", None, "10-20 LPA"]


def test_a_memo_is_not_asked_twice(spark, tmp_path):
    rows = spark.createDataFrame([("http://a.io/1",), ("http://a.io/2",), ("http://b.io/1",), ("",), (None,), ("http://a.io/1",)], "raw_apply_url string")
    memo = network.memo_at(spark, f"file://{tmp_path}/memo")

    def answer(run):
        def f(u):
            if u.endswith("2") and run < 2:
                raise OSError("down")
            return f"{u}#{run}", "x.io"

        return f

    def run(k, hours):
        got = network.resolve(rows, answer(k), memo=memo, as_of=AS_OF + dt.timedelta(hours=hours), keep_hours=100, keep_failed_hours=10).collect()
        return sorted((r.raw_apply_url or "", (r.apply_url or "")[-2:]) for r in got)

    first = [("", ""), ("", ""), ("http://a.io/1", "#0"), ("http://a.io/1", "#0"), ("http://a.io/2", ""), ("http://b.io/1", "#0")]
    assert run(0, 0) == first == run(1, 9)
    assert run(2, 20) == [(u, "#2" if u.endswith("2") else t) for u, t in first]  # a failure is forgotten sooner
    assert {t for u, t in run(3, 101) if u} == {"#3", "#2"} and memo.read().count() == 3
    # All URLs of a host are in one task.
    urls = rows.where("raw_apply_url <> ''").distinct()
    dealt = network._by_host(urls, "raw_apply_url", 4).withColumn("p", F.spark_partition_id()).groupBy("__host").agg(F.count_distinct("p").alias("n"))
    assert {r.n for r in dealt.collect()} == {1}


def test_rewriting_goes_by_text(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("3", None), ("4", " ")], "id string, description_original string")
    got = network.rewrite(rows, lambda t: (200, t.upper()), retries=0).collect()
    assert sorted((r.id, r.description_original or "", r.rewritten_description or "") for r in got) == [("1", "a", "A"), ("1", "b", "B"), ("1", "c", "C"), ("2", "a", "A"), ("3", "", ""), ("4", " ", "")]


@pytest.mark.parametrize("terms", [{"title": "eng"}, {"title": "E%GI"}, {"title": r"50\\%", "company": "ACM"}, {"title": "xy"}, {"title": "%"}, {"company": "none such"}, {"title": "ÄRZ"}])
def test_search_by_trigrams(spark, terms):
    from postmill.functions.text import ilike_any
    from postmill.operators import trigrams

    titles = ["Engineer", "engine 50% off", "Ärztin", "an xy", None, "", "gin", "ENGAGIST", "5050"]
    rows = spark.createDataFrame([(str(k), t, "Acme" if k % 3 == 0 else "Other") for k, t in enumerate(titles)], "id string, title string, company string")
    want = rows.where(reduce(lambda a, b: a | b, [ilike_any(F.col(c), v) for c, v in terms.items()]))
    got = trigrams.search(rows, trigrams.postings(rows, ["title", "company"]), terms)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_workers_need_no_package(tmp_path):
    """A driver elsewhere, with the package on its own path only."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession, functions as F
from postmill.operators import dedup, network
from postmill.sources.html import html_to_text
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = spark.createDataFrame([(1, "<p>a</p>", "http://x.io/1")], "seq long, html string, raw_apply_url string")
assert df.select(html_to_text(F.col("html")).alias("t")).first().t == "a"
assert network.resolve(df, lambda u: (u, "x.io")).first().resolved_domain == "x.io"
rows = spark.createDataFrame([(k, f"f{{(k + 1) // 2}}", f"u{{k // 2}}", str(k)) for k in range(9)], "seq long, fingerprint string, url_key string, id string")
assert sorted(r.seq for r in dedup.leaders(rows).collect()) == [0, 2, 4, 6, 8]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_leaders_leave_no_table_but_theirs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("postmill.runtime.shared_dir", lambda _: f"file://{tmp_path}")
    rows = spark.createDataFrame([(k, f"f{(k + 1) // 2}", f"u{k // 2}", str(k)) for k in range(12)], "seq long, fingerprint string, url_key string, id string")
    assert sorted(r.seq for r in dedup.leaders(rows).collect()) == list(range(0, 12, 2))
    assert {p.name.split("-")[0] for p in tmp_path.iterdir() if any(p.glob("*.parquet"))} <= {"first", "settled"}


def greedy(rows):
    taken, kept = set(), []
    for seq, *own in sorted(rows):
        held = {(n, v) for n, v in enumerate(own) if v is not None}
        if not held & taken:
            taken |= held
            kept.append(seq)
    return kept


@pytest.mark.parametrize(("share", "chain"), [(dedup.SHARE, 2_000_000), (dedup.SHARE, 0), (100, 0)])
def test_leaders_pass_over_few_rows(spark, monkeypatch, share, chain):
    """Passes that settle a good part of the rows are gone on with: no search for components, and all passes together write a few times the rows.
    A key of more than ``share`` rows is aggregated, and nothing is sorted by it."""
    monkeypatch.setattr(dedup, "CHAIN", chain, raising=False)
    rng = random.Random(7)
    rows = [(k, f"f{k // 4}", None if rng.random() < 0.2 else f"u{0 if rng.random() < 0.1 else rng.randrange(200)}", f"i{k}") for k in range(3000)]
    passed, hot = [], []
    kept, one = dedup._kept, getattr(dedup, "_pass", None)

    def count(df, name):
        table, seen = kept(df, name)
        passed.append(table.count())
        return table, seen

    monkeypatch.setattr(dedup, "_kept", count)
    monkeypatch.setattr(dedup, "_pass", lambda *a: hot.append(a[-1]) or one(*a), raising=False)
    monkeypatch.setattr(dedup, "components", lambda *a: pytest.fail("components were searched"))
    df = spark.createDataFrame(rows, "seq long, fingerprint string, url_key string, id string")
    assert sorted(r.seq for r in dedup.leaders(df, share=share).collect()) == greedy(rows)
    assert sum(passed) < 9 * len(rows)
    assert any(hot) == (share == 100)
