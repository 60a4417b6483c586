"""Every operator as a query over the driver's tables, with the same thing in SQL where SQL can say it.

There is no jobs table among them, so each operator runs over a table of the right shape.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import classify, digest, display, text, url
from postmill.functions.salary import parse_salary
from postmill.operators import dedup, network, records, trigrams
from postmill.operators.store import Store
from postmill.plans import crawl, ingest, social
from postmill.plans import jobs as J
from postmill.runtime import shared_dir, written
from postmill.schema import conform
from postmill.sources import base, html, sitemaps

c = F.col


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """customer as jobs: name, segment and balance stand for title, source and salary."""
    return _read(spark, d, "customer").select(
        c("c_custkey").alias("id"), c("c_mktsegment").alias("source"), c("c_name").alias("title"), c("c_name").alias("company"), c("c_name").alias("location"), c("c_acctbal").alias("salary_min"),
        (c("c_custkey") % 7 != 0).alias("is_active"), c("c_acctbal").alias("posted_at"), c("c_nationkey").alias("seniority"),
    )


_QUERY = J.JobQuery(source="BUILDING", location="customer", min_salary=0, limit=20, offset=10)


def list_filter_page(spark, d):
    rows = J.ordered(J.matching(_customers(spark, d), _QUERY), "posted_at", "desc").offset(_QUERY.offset).limit(_QUERY.limit)
    return rows.select("id", "title", "salary_min")


def list_total(spark, d):
    return J.total(_customers(spark, d), _QUERY)


def sort_oldest_first(spark, d):
    rows = _read(spark, d, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 50 != 0, c("o_orderdate")).alias("posted_at"))
    return J.ordered(rows, "posted_at", "asc").limit(50).select("id", "posted_at")


def _postings(spark, d) -> DataFrame:
    """part as stored jobs, with values in every column that a filter or a page looks at."""
    k = c("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    return conform(_read(spark, d, "part").select(
        k.cast("string").alias("id"), pick("a", "b", "c").alias("source"), k.cast("string").alias("external_id"), c("p_name").alias("title"), c("p_brand").alias("company"), F.when(k % 4 != 0, c("p_type")).otherwise("").alias("location"),
        (k % 2 == 0).alias("is_remote"), pick("full-time", "contract").alias("employment_type"), pick("junior", "mid", "senior").alias("seniority"), F.when(k % 5 != 0, c("p_size") * 1000).alias("salary_min"), (c("p_size") * 2000).alias("salary_max"),
        F.when(k % 2 == 0, "annual").alias("salary_period"), (k % 5 != 0).alias("has_salary"), F.split("p_name", " ").alias("tags"), F.concat(F.lit("Told: <b>"), "p_name").alias("description_original"), F.when(k % 6 == 0, F.lit("")).when(k % 6 == 1, F.concat(F.lit("New: "), "p_type")).alias("rewritten_description"),
        F.concat(F.lit("https://raw.example.com/"), k).alias("raw_apply_url"), F.when(k % 3 != 0, F.concat(F.lit("https://end.example.com/"), k)).alias("apply_url"), F.timestamp_seconds(F.lit(1_704_067_200) + k).alias("scraped_at"), F.when(k % 10 != 0, F.timestamp_seconds(F.lit(1_704_000_000) + k % 97)).alias("posted_at"), (k % 8 != 0).alias("is_active"),
    ))


def lookup_by_id(spark, d):
    """The detail of one job through the store's own lookup."""
    got = J.get(_postings(spark, d), "7")
    return spark.createDataFrame([(got.id, got.title, got.description, got.apply_url)] if got else [], "id string, title string, description string, apply_url string")


def job_filters(spark, d):
    """A page by every kind of filter at once, from request parameters."""
    query = J.JobQuery.from_params({"is_remote": "true", "has_salary": ["true", "x"], "tag": "red", "seniority": "", "min_salary": "5000", "q": "E", "limit": "100", "sort": "scraped_at", "order": "asc"})
    return J.page(_postings(spark, d), query).select("id", "title", "company", "salary_min", "description", "is_rewritten", "apply_url")


def page_texts(spark, d):
    """What a job's page shows beside its fields."""
    rows = J.public(_postings(spark, d))
    ld = display.json_ld()
    get = lambda path: F.get_json_object(ld, path)
    return rows.select("id", display.page_title(c("title"), c("company"), c("is_remote"), c("location")).alias("page_title"), display.excerpt(c("description"), 12).alias("excerpt"), F.array_join(display.paragraphs(F.replace("title", F.lit(" "), F.lit(" \n\n"))), "|").alias("paragraphs"),
                       get("$.employmentType").alias("ld_type"), get("$.jobLocationType").alias("ld_remote"), get("$.jobLocation.address.addressLocality").alias("ld_place"), get("$.baseSalary.value.maxValue").alias("ld_max"), get("$.baseSalary.value.unitText").alias("ld_unit"), F.contains(ld, F.lit("<")).alias("ld_open"))


def similar_jobs(spark, d):
    """Those of one job, by its first tag."""
    return J.similar(_postings(spark, d), "7").select("id")


def rewrite_new(spark, d):
    def call(t: str) -> tuple[int, str | None]:  # one kind of text is refused, one can't be had, one comes back blank
        kind = int(t.rsplit(" ", 1)[1]) % 4
        return ((200, f" {t.upper()} "), (400, None), (503, None), (200, "  "))[kind]

    rows = _read(spark, d, "part").select(c("p_partkey").cast("string").alias("id"), F.concat("p_brand", F.lit(" "), c("p_partkey").cast("string")).alias("description_original"))
    return network.rewrite(rows, call, retries=0).select("id", "rewritten_description")


def dedup_stored(spark, d):
    """parts that arrive at a store that holds every third of them: by fingerprint, by URL key, or by neither."""
    k = c("p_partkey")
    of = lambda id_, fp, key: [id_.alias("id"), fp.alias("fingerprint"), key.alias("url_key"), F.lit(dt.datetime(2024, 1, 1)).alias("scraped_at")]
    named = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    rows = _read(spark, d, "part")
    stored = rows.where(k % 3 == 0).select(*of(named("old"), named("f"), named("u")))
    new = rows.select(k.alias("seq"), *of(named("new"), F.when(k % 2 == 0, named("f")).otherwise(named("g")), F.when(k % 5 != 0, named("u"))))
    return dedup.assign(new, stored).select(c("seq").alias("p_partkey"), "target", "new_seq")


def crawl_flat(spark, d):
    """The walk over a sitemap of all parts, newest first, until the page of the part that is too old; some pages fail."""
    n = _read(spark, d, "part").count()
    xml = "".join(f"<url><loc>https://jobfound.org/job/{k}</loc></url>" for k in range(1, n + 1))

    def fetch(u: str) -> tuple[int, str | None]:
        if u.endswith(".xml"):
            return 200, xml
        k = int(u.rsplit("/", 1)[1])
        if k % 7 == 0:
            raise OSError("unreachable")
        when = "2023-12-01" if k == 100 else "" if k % 5 == 0 else "2024-01-01T12:00:00Z"
        return (404 if k % 11 == 0 else 200), f'<script>self.__next_f.push([1,"{{\\"initialJob\\":{{\\"postedAt\\":\\"{when}\\"}},\\"similarJobs\\":[]}}"])</script>'

    return crawl.walk(spark, base.get_source("jobfound"), fetch, _AS_OF, wait=lambda s: None).select("url")


def link_check(spark, d):
    """Links are checked through the store, and the jobs whose links are gone are inactive afterwards."""
    store = Store(spark, f"{shared_dir(spark)}/checked-{uuid.uuid4().hex}")
    store.write(_postings(spark, d))

    def call(u: str) -> int | None:
        n = int(u.rsplit("/", 1)[1])
        if n % 9 == 0:
            raise OSError("unreachable")
        return 410 if n % 9 == 1 else 503 if n % 9 == 2 else 200

    ingest.check_links(store, call=call)
    return store.read().select("id", "is_active")


def search_or(spark, d):
    rows = _read(spark, d, "part")
    return rows.where(text.ilike_any(c("p_name"), "re") | text.ilike_any(c("p_type"), "brass")).select("p_partkey", "p_name", "p_type")


def tags_contains(spark, d):
    rows = _read(spark, d, "part").select("p_partkey", text.comma_list(F.regexp_replace("p_name", " ", " , ")).alias("tags"))
    first = rows.withColumn("first", F.try_element_at("tags", F.lit(1)))
    return first.where(F.array_contains("tags", "red") | F.array_contains("tags", "blue") | (c("p_partkey") % 10 == 0)).select("p_partkey", F.array_join("tags", "|").alias("tags"), "first")


def url_host(spark, d):
    return _read(spark, d, "pages").select("page_id", url.host(c("url")).alias("host"))


def url_path_key(spark, d):
    p = _read(spark, d, "pages")
    return p.select("page_id", url.url_key(c("url"), url.host(c("url"))).alias("url_key"))


_BOARDS = ("example.com", "example.net")


def aggregator_flag(spark, d):
    return _read(spark, d, "pages").select("page_id", url.is_aggregator(url.host(c("url")), _BOARDS).alias("flag"))


def apply_type(spark, d):
    return _read(spark, d, "pages").select("page_id", url.apply_type(c("url"), "example.org").alias("apply_type"), url.slug(F.regexp_replace("url", "[?#].*$", "")).alias("slug"))


def recheck_resolved(spark, d):
    rows = _read(spark, d, "pages").select("page_id", url.host(c("url")).alias("resolved_domain"), (c("page_id") % 3 != 0).alias("is_external"))
    rows = rows.withColumn("resolved_domain", F.when(c("page_id") % 5 == 0, "jobs.indeed.com").when(c("page_id") % 7 != 0, c("resolved_domain")))
    return records.recheck(rows).select("page_id", "is_external")


def fingerprint(spark, d):
    return _read(spark, d, "part").select("p_partkey", text.fingerprint(c("p_name"), c("p_brand"), F.when(c("p_partkey") % 2 == 0, c("p_type"))).alias("fingerprint"))


def job_id(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", text.job_id(c("o_orderstatus"), c("o_orderkey").cast("string")).alias("id"))


def dedup_exact(spark, d):
    docs = _read(spark, d, "documents").select(F.md5("text").alias("key"), c("doc_id").alias("first_doc"), "source")
    return dedup.first_by(docs, "key", ["first_doc"])


def dedup_sources(spark, d):
    docs = _read(spark, d, "documents").select(F.md5("text").alias("fingerprint"), "source", c("doc_id").cast("bigint").alias("seq"), c("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("url_key"), F.lit(dt.datetime(2024, 1, 1)).alias("scraped_at"))
    stored = docs.select("id", "fingerprint", "url_key", "source", "scraped_at", F.array().cast("array<string>").alias("merged_sources")).limit(0)
    kept = dedup.merged(dedup.assign(docs, stored), stored)
    return kept.select(c("fingerprint").alias("key"), F.concat_ws(",", "source", "merged_sources").alias("sources"))


def _arrivals(spark, d) -> DataFrame:
    """lineitem as arriving postings: the order and the part are the two keys, and some rows have no URL key."""
    rows = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("s"))
    return rows.select(
        (c("l_orderkey") * 1_000_000 + c("l_partkey")).alias("seq"),
        F.concat(F.lit("f"), c("l_orderkey")).alias("fingerprint"),
        F.when(c("s") % 5 != 0, F.concat(F.lit("u"), c("l_partkey"))).alias("url_key"),
        F.concat_ws("-", c("l_orderkey"), c("l_partkey")).alias("id"),
    )


def dedup_greedy(spark, d):
    return dedup.leaders(_arrivals(spark, d)).select("seq", "id")


def recency_window(spark, d):
    events = _read(spark, d, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    rows = events.select(c("event_id").alias("id"), c("ts").alias("scraped_at"), (c("event_type") != "error").alias("is_active"))
    return social.recent(rows, as_of, 24).select("id", "scraped_at") if as_of else rows.select("id", "scraped_at")


def early_stop_prefix(spark, d):
    stopped = base.until_stale(_read(spark, d, "events"), "event_id", "value", F.lit(0.05))
    return stopped.select("event_id", "value")


_LINK = r'href="([^"]*)"'


def html_title_links(spark, d):
    pages = _read(spark, d, "pages")
    return pages.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.size(base.sitemap_locations(c("html"), _LINK)).cast("bigint").alias("links"), F.try_element_at(base.sitemap_locations(c("html"), _LINK), F.lit(1)).alias("first_link"))


def html_text(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(html.html_to_text(c("html"))).alias("text_md5"))


def json_field(spark, d):
    return _read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


_SHAPES = ["%d-%d LPA", "%d LPA", "%dk-%dk per month", "%dk/month", "%d - %d per hour", "Rs %d00000 to %d99999 per annum", "Not disclosed", "%d.5 lakhs per annum"]


def salary_parse(spark, d):
    n, m = c("p_size"), c("p_size") + 5
    shape = c("p_partkey") % len(_SHAPES)
    said = F.when(F.lit(False), "")
    for k, f in enumerate(_SHAPES):
        said = said.when(shape == k, F.format_string(f, *[n, m][: f.count("%d")]) if "%" in f else F.lit(f))
    rows = _read(spark, d, "part").select("p_partkey", said.alias("raw"))
    return rows.select("p_partkey", "raw", parse_salary(c("raw")).alias("s")).select("p_partkey", "raw", "s.*")


def seniority_bucket(spark, d):
    return _read(spark, d, "part").select("p_partkey", classify.seniority(F.concat(F.lit("about "), (c("p_size") % 12).cast("string"), F.lit("+ years"))).alias("seniority"))


def employment_map(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("Full-Time", " temporary", "freelance", "FULL_TIME, INTERN", "remote / contractor"))), (c("o_orderkey") % 5 + 1).cast("int"))
    return _read(spark, d, "orders").select("o_orderkey", classify.employment(kind).alias("one"), classify.employment_of_list(kind).alias("listed"))


def remote_scope(spark, d):
    title = F.element_at(F.array(*map(F.lit, ("Software Engineer (Remote)", "Sales Executive, software", "Hybrid virtual Developer", "Python expert", "DevOps - virtual"))), (c("o_orderkey") % 5 + 1).cast("int"))
    return _read(spark, d, "orders").select("o_orderkey", classify.inferred_remote(title, c("o_orderpriority")).alias("is_remote"), classify.in_scope(title, F.lit("")).alias("in_scope"))


def missing_fields(spark, d):
    docs, labels = _read(spark, d, "documents").select("doc_id", "lang"), _read(spark, d, "labels")
    both = docs.join(labels, "doc_id", "left")
    flags = F.array_compact(F.array(F.when(c("quality").isNull(), F.lit("quality")), F.when(c("toxic").isNull(), F.lit("toxic")), F.when(c("lang") != "en", F.lit("english"))))
    return both.select("doc_id", F.array_join(flags, ",").alias("missing"))


def similar_top4(spark, d):
    return J.similar_all(_read(spark, d, "part"), "p_brand", [c("p_retailprice").desc()], "p_partkey").select("p_partkey", c("position").cast("bigint").alias("position"), "similar_id")


def run_stats(spark, d):
    outcome = F.when(c("value") > 70, "inserted").when(c("value") > 50, "merged")
    flags = [(c("value") > 10).alias("is_valid"), (c("value") > 30).alias("was_external"), (c("value") > 50).alias("is_external"), outcome.alias("outcome"), F.when(c("event_id") % 2 == 0, "new").alias("rewritten_description")]
    stats = records.run_stats(_read(spark, d, "events").select(c("event_type").alias("source"), *flags))
    return records.with_errors(stats, ["down"])


def display_fields(spark, d):
    p = _read(spark, d, "part")
    low, high = F.when(c("p_size") % 3 != 0, c("p_size") * 50_000), F.when(c("p_size") % 4 != 0, (c("p_size") + 6) * 50_000)
    return p.select(
        "p_partkey",
        display.title_case(c("p_name")).alias("title"),
        display.company_initial(c("p_name")).alias("initial"),
        display.format_salary(low, high, F.lit("INR"), F.lit("annual"), F.lit("raw"), c("p_size") % 5 != 0).alias("salary"),
        display.experience_label(F.element_at(F.array(*map(F.lit, ("fresher", "junior", "mid", "senior", "lead", "other"))), (c("p_size") % 6 + 1).cast("int"))).alias("experience"),
        display.looks_like_heading(c("p_name")).alias("heading"),
    )


def display_times(spark, d):
    o = _read(spark, d, "orders")
    return o.select("o_orderkey", display.format_date(c("o_orderdate")).alias("day"), display.time_ago(c("o_orderdate"), F.lit(dt.datetime(2000, 1, 1, tzinfo=dt.UTC))).alias("ago"))


def digest_lines(spark, d):
    p = _read(spark, d, "part")
    return p.select("p_partkey", digest.job_line(F.repeat("p_name", 3), F.when(c("p_partkey") % 3 != 0, c("p_brand")).otherwise(" ")).alias("line"))


def digest_post(spark, d):
    o = _read(spark, d, "orders").select(c("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Order "), c("o_orderpriority")).alias("title"), c("o_orderstatus").alias("company"), c("o_orderdate").alias("scraped_at"), F.lit(True).alias("is_active"))
    last = o.agg(F.max("scraped_at")).first()[0]
    return social.digest(o, last, "https://example.com/a/rather/long/path", hours=720, max_jobs=5)


def upsert_snapshot(spark, d):
    """orders as jobs: two thirds are stored, the even ones arrive later from another source, and some are then deactivated."""
    o = _read(spark, d, "orders")
    key = c("o_orderkey").cast("string")
    jobs = o.select(key.alias("id"), F.lit("a").alias("source"), key.alias("external_id"), c("o_orderpriority").alias("title"), F.lit("x").alias("company"), F.lit("https://x/").alias("raw_apply_url"), F.concat(F.lit("https://x.example.com/"), key).alias("apply_url"), F.lit("x.example.com").alias("resolved_domain"), F.lit(dt.datetime(2024, 1, 1)).alias("scraped_at"), F.concat(F.lit("f"), key).alias("fingerprint"))
    store = Store(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}")
    store.write(jobs.where(c("id").cast("bigint") % 3 != 0), "first")
    new = jobs.where(c("id").cast("bigint") % 2 == 0).withColumns({"seq": c("id").cast("bigint"), "id": F.concat(F.lit("b"), "id"), "source": F.lit("b"), "scraped_at": F.lit(dt.datetime(2024, 1, 2))})
    arriving = dedup.with_url_key(conform(new).withColumn("seq", c("external_id").cast("bigint")))

    def change(stored: DataFrame) -> DataFrame:
        stored = dedup.with_url_key(stored)
        return dedup.changed(written(dedup.assign(arriving, stored), "assigned"), stored)

    for _ in range(2):  # a batch that comes again changes nothing
        store.commit(change, "second")
    store.deactivate(store.read().where(c("external_id").cast("bigint") % 7 == 0))
    store.write(store.read().where("false"), "second")
    store.expire(1)
    return store.read().select(c("external_id").cast("bigint").alias("o_orderkey"), "id", "source", F.array_join("merged_sources", ",").alias("others"), "scraped_at", "is_active")


def _pages(spark, d) -> DataFrame:
    """part as pages of the flat source: a job object in a streamed script chunk."""
    k = c("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    job = F.struct(
        F.concat(F.lit("Engineer "), (F.floor(k / 2)).cast("string")).alias("title"), F.concat(F.lit("part-"), k.cast("string")).alias("slug"), F.lit('Say "A\\B"').alias("companyName"),
        pick("full-time", "").alias("jobType"), F.when(k % 5 != 0, F.concat((k % 12).cast("string"), F.lit(" years"))).otherwise("").alias("experience"), F.lit("Engineering").alias("domain"),
        F.lit("Pune").alias("location"), F.when(k % 9 != 0, " India").otherwise("Nepal").alias("country"), F.replace("p_type", F.lit(" "), F.lit(" , ")).alias("skills"),
        F.when(k % 11 == 0, "").when(k % 6 == 0, F.concat(F.lit("https://www.jobfound.org/x/"), k.cast("string"))).otherwise(F.concat(F.lit("https://careers.example.com/"), k.cast("string"), F.lit("/?a=b"))).alias("applyUrl"),
        pick("remote", "On-site", "").alias("workplaceType"), F.when(k % 13 != 0, "2024-01-01T12:00:00Z").otherwise("2023-12-01").alias("postedAt"),
        F.when(k % 4 != 0, F.concat((k % 20).cast("string"), F.lit("-"), (k % 20 + 5).cast("string"), F.lit(" LPA"))).otherwise("").alias("salary"),
    )
    chunk = F.regexp_replace(F.concat(F.lit('5:["x",{"initialJob":'), F.to_json(job), F.lit(',"similarJobs":[]}]')), r'(["\\])', r"\\$1")
    page = F.when(k % 17 == 0, "<p>no job</p>").otherwise(F.concat(F.lit('<script>self.__next_f.push([1,"'), chunk, F.lit('"])</script>')))
    return _read(spark, d, "part").select(F.concat(F.lit("https://jobfound.org/job/"), k.cast("string")).alias("url"), page.alias("html"))


def _graph_pages(spark, d) -> DataFrame:
    """part as pages of the graph source: a posting in JSON-LD, with link and description beside it."""
    k = c("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    kind, place = F.lit("JobPosting"), F.struct(F.struct(F.lit(" Pune ").alias("addressLocality"), F.when(k % 4 != 0, "MH").alias("addressRegion"), F.when(k % 7 != 0, " in").otherwise("NP").alias("addressCountry")).alias("address"))
    pay = F.struct(F.when(k % 3 != 0, "USD").alias("currency"), F.struct((k % 10 + 1).alias("minValue"), F.when(k % 4 != 0, k % 10 + 1 + k % 4).alias("maxValue"), pick("year", "MONTH", "DAY").alias("unitText")).alias("value"))
    posting = F.struct(kind.alias("@type"), F.concat(pick("Software Engineer ", "Fresher Developer ", "Sales Executive ", "Remote SDE "), k.cast("string")).alias("title"), F.lit("<p>Short</p>").alias("description"), pick("FULL_TIME, INTERN", "freelance", "contractor/x").alias("employmentType"),
                       F.array(place).alias("jobLocation"), F.struct(F.lit("Acme").alias("name")).alias("hiringOrganization"), F.when(k % 13 != 0, "2024-01-01T20:00:00+05:30").otherwise("2023-12-01").alias("datePosted"), pay.alias("baseSalary"), F.lit("Java, SQL").alias("skills"),
                       F.when(k % 4 != 1, F.struct((k % 150).alias("monthsOfExperience"))).alias("experienceRequirements"))
    link = F.when(k % 5 == 0, '<a target="_blank" href="https://www.talentd.in/hub">Hub</a>').when(k % 5 == 1, '<a target="_blank" href="https://x.io/">Go</a>').otherwise('<a target="_blank" href="https://y.io/">Y</a><a href="https://no.io/" target="_blank"><b>Apply</b> now</a>')
    block = F.when(k % 2 == 0, '<div class="x jobContent_jobContent__a"><p> Full </p><div>in<b>ner</b></div></div><p>after</p>').otherwise("")
    page = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":[{"@type":"Thing"},'), F.to_json(posting), F.lit("]}</script>"), link, block)
    return _read(spark, d, "part").select(F.concat(F.lit("https://www.talentd.in/jobs/p-"), k.cast("string"), F.lit("/")).alias("url"), page.alias("html"))


def graph_records(spark, d):
    rows = records.finalize(base.run(base.get_source("talentd"), _graph_pages(spark, d), _AS_OF), _AS_OF)
    columns = ["external_id", "title", "company", "location", "is_remote", "employment_type", "seniority", "salary_min", "salary_max", "salary_currency", "salary_period", "salary_raw", "has_salary", "description_original", "apply_type", "raw_apply_url", "posted_at", "is_valid"]
    return rows.select(*columns, F.array_join("tags", "|").alias("tags"))


_AS_OF = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)


def page_records(spark, d):
    rows = records.finalize(base.run(base.get_source("jobfound"), _pages(spark, d), _AS_OF), _AS_OF)
    columns = ["external_id", "id", "fingerprint", "title", "company", "location", "is_remote", "employment_type", "seniority", "salary_min", "salary_max", "salary_period", "salary_raw", "has_salary", "apply_type", "raw_apply_url", "posted_at", "is_valid"]
    return rows.select(*columns, F.array_join("tags", "|").alias("tags"), F.array_join("source_fields_missing", ",").alias("missing"))


def ingest_run(spark, d):
    """From pages to the store and its public rows."""
    store = Store(spark, f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}")
    ingest.ingest(_pages(spark, d), store, _AS_OF, names=["jobfound"]).collect()
    return J.public(store.read()).select("source", "title", "apply_url", "seniority", "is_active", "is_rewritten", "scraped_at")


def ingest_stats(spark, d):
    store = Store(spark, f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}")
    return ingest.ingest(_pages(spark, d), store, _AS_OF, names=["jobfound"]).drop("corrupt")


def liveness(spark, d):
    o = _read(spark, d, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("https://x/"), (c("o_orderkey") % 100).cast("string")).alias("apply_url"), F.lit("").alias("raw_apply_url"), (c("o_orderkey") % 4 != 0).alias("is_active"))
    n = F.substr("link", F.lit(11)).cast("int")
    table = o.select(network.link_of().alias("link")).distinct().select("link", F.when(n % 10 == 0, 404).when(n % 10 == 1, 410).when(n % 10 == 2, 500).otherwise(200).alias("status"), (n % 25 == 24).alias("failed"))
    return network.dead_ids(o, table)


def resolve_memo(spark, d):
    p = _read(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("raw_apply_url"))

    def call(u: str) -> tuple[str, str]:  # asked once for each URL
        if u.startswith("https:"):
            raise OSError("unreachable")
        return u + "#end", "final.example.com"

    return network.resolve(p, call).select("page_id", "apply_url", "resolved_domain")


def flagship(spark, d):
    """Postings by source: order statuses as sources, with stats, newest price and ranks."""
    o = _read(spark, d, "orders")
    cust = _read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    per = o.join(cust, o.o_custkey == cust.c_custkey).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("jobs"), F.max("o_orderdate").alias("newest"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("jobs"), "o_orderstatus")
    return per.withColumn("place", F.row_number().over(w).cast("bigint"))


#: One job title in six scripts, and its slug.
_TITLES = (("Ingénieur", "ingenieur"), ("Инженер-программист", "inzhener-programmist"), ("Μηχανικός", "mekhanikos"), ("सॉफ्टवेयर अभियंता", "sophttveyr-abhiyntaa"), ("軟體工程師", "u8edf-u9ad4-u5de5-u7a0b-u5e2b"), ("소프트웨어 엔지니어", "sopeuteuweeo-enjinieo"))


def fingerprint_scripts(spark, d):
    """Titles in six scripts, numbered: each has a fingerprint of its own."""
    k = c("p_partkey")
    title = F.concat_ws(" ", F.get(F.array(*[F.lit(t) for t, _ in _TITLES]), (k % len(_TITLES)).cast("int")), F.floor(k / len(_TITLES)).cast("string"))
    rows = _read(spark, d, "part").select("p_partkey", text.slugify(title).alias("slug"), text.fingerprint(title, c("p_brand"), F.lit(None).cast("string")).alias("fingerprint"))
    return rows.withColumn("alike", F.count("*").over(Window.partitionBy("fingerprint")))


def page_errors(spark, d):
    """Pages of which every tenth has markup that the parser gives up on: the others' rows are stored, and it is listed with the reason."""
    k = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    told = F.when(k % 10 == 3, r'\"description\":\"<p>a<![bogus[x]]>b</p>\",').otherwise(r'\"description\":\"<p>Told</p>\",')
    pages = _pages(spark, d).withColumn("html", F.replace("html", F.lit(r'{\"initialJob\":{'), F.concat(F.lit(r'{\"initialJob\":{'), told)))
    store = Store(spark, f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}")
    ingest.ingest(pages, store, _AS_OF, names=["jobfound"])
    none = F.lit(None).cast("string")
    stored = store.read().select("title", "description_original", none.alias("url"), none.alias("error"))
    return stored.unionByName(store.skipped().select(none.alias("title"), none.alias("description_original"), "url", F.regexp_extract("error", r"^(\w+)", 1).alias("error")))


def resolve_again(spark, d):
    """Links resolved by three runs with one memo: half of the pages, all an hour later, and all after two days, when failures are asked for again."""
    p = _read(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("raw_apply_url"))
    memo = network.memo_at(spark, f"{shared_dir(spark)}/memo-{uuid.uuid4().hex}")

    def call(run: int):
        def f(u: str) -> tuple[str, str]:
            if run < 3 and u.startswith("https:"):
                raise OSError("unreachable")
            return f"{u}#{run}", f"run{run}.example.com"

        return f

    times = [_AS_OF, _AS_OF + dt.timedelta(hours=1), _AS_OF + dt.timedelta(hours=48)]
    runs = [network.resolve(p.where("page_id % 2 = 0") if k == 0 else p, call(k + 1), memo=memo, as_of=t).select("page_id", "apply_url", "resolved_domain") for k, t in enumerate(times)]
    return runs[1].withColumnRenamed("apply_url", "second").drop("resolved_domain").join(runs[2].withColumnRenamed("apply_url", "third"), "page_id")


def search_index(spark, d):
    """A substring search through stored trigrams of two columns."""
    rows = _read(spark, d, "part")
    index = written(trigrams.postings(rows, ["p_name", "p_type"], "p_partkey"), "trigrams")
    return trigrams.search(rows, index, {"p_name": "OLD%idg", "p_type": "romo"}, "p_partkey").select("p_partkey", "p_name", "p_type")


def description_rows(spark, d):
    """Descriptions that pages keep apart: a reference to a text row of a later chunk, which some pages lack."""
    k = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    body = F.concat(F.lit("<p>Nä "), k.cast("string"), F.lit("</p><script>x</script>☃"))
    row = F.concat(F.lit('<script>self.__next_f.push([1,"21:T'), F.lower(F.hex(F.octet_length(body))), F.lit(","), body, F.lit('22:I[1]"])</script>'))
    pages = _pages(spark, d).withColumn("html", F.replace("html", F.lit(r'{\"initialJob\":{'), F.lit(r'{\"initialJob\":{\"description\":\"$21\",')))
    pages = pages.withColumn("html", F.concat("html", F.when(k % 7 == 0, F.lit("")).otherwise(row)))
    rows = base.run(base.get_source("jobfound"), pages, _AS_OF)
    return rows.select("external_id", "description_original", "description_available", F.array_contains("source_fields_missing", "description_original").alias("missing"))


def page_windows(spark, d):
    """The page numbers that lists of each nation's customers show, at pages further and further in."""
    per = _customers(spark, d).groupBy(c("seniority").alias("nation")).agg(F.count("*").alias("total"))
    return per.select("nation", display.pages(c("total"), F.lit(5), c("nation") * 5).alias("p")).where("p is not null").select("nation", "p.pages", "p.current", F.array_join(c("p.shown").cast("array<string>"), ",").alias("shown"), "p.gap_before", "p.gap_after")


def jobs_json(spark, d):
    """The items of a response, read back: nulls are kept, and tags stay a list."""
    rows = J.as_json(J.public(_postings(spark, d)))
    get = lambda k: F.get_json_object("json", f"$.{k}")
    return rows.select(get("id").alias("id"), get("title").alias("title"), get("salary_min").alias("salary_min"), get("tags[0]").alias("tag"), get("is_active").alias("is_active"), F.contains("json", F.lit('"posted_at":null')).alias("undated"), F.size(F.json_object_keys("json")).alias("fields"))


def _listed(spark, d) -> DataFrame:
    """pages as entries of sitemaps of 50, newest first, with odd dates; some pages can't be had."""
    k, n = F.floor(c("page_id") / 50), F.pmod("page_id", F.lit(50))
    day = F.date_format(F.timestamp_seconds(F.lit(1706659200) - n * (k % 3 + 1) * 43200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.when(n % 7 == 3, F.lit("soon")).when(n % 5 != 4, day)
    return _read(spark, d, "pages").select(F.concat(F.lit("site/"), k).alias("sitemap"), c("page_id").alias("pos"), F.coalesce("url", F.lit("")).alias("url"), at.alias("at"), F.when(c("page_id") % 11 != 0, c("html")).alias("html"))


def sitemap_pages(spark, d):
    """Sitemaps read as a data source, each by one task up to its first entry older than ten days."""
    path = f"{shared_dir(spark)}/sitemaps-{uuid.uuid4().hex}"
    sitemaps.archive(_listed(spark, d), path)
    sitemaps.register(spark)
    got = spark.read.format("sitemaps").option("path", path).option("since", "2024-01-21").load()
    return got.select("sitemap", "pos", "at", F.sha2("html", 256).alias("digest"))


def sitemap_stream(spark, d):
    """The same sitemaps as a stream, run before and after their newest 20 entries came: which run brought which page."""
    path = f"{shared_dir(spark)}/sitemaps-{uuid.uuid4().hex}"
    rows, new = _listed(spark, d), F.pmod("pos", F.lit(50)) < 20
    sitemaps.register(spark)
    for some in (rows.where(~new), rows.where(new)):
        sitemaps.archive(some, f"{path}/archive")

        def batch(df: DataFrame, number: int) -> None:
            df.select("sitemap", "pos", F.lit(number).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{path}/rows/run={number}")

        pages = spark.readStream.format("sitemaps").option("path", f"{path}/archive").load()
        pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("sitemap", "pos", "batch")


QUERIES = {f.__name__: f for f in (
    flagship, list_filter_page, list_total, sort_oldest_first, lookup_by_id, search_or, tags_contains, url_host, url_path_key, aggregator_flag, apply_type, recheck_resolved, fingerprint, job_id,
    dedup_exact, dedup_sources, dedup_greedy, recency_window, early_stop_prefix, html_title_links, html_text, json_field, salary_parse, seniority_bucket, employment_map, remote_scope,
    missing_fields, similar_top4, run_stats, display_fields, display_times, digest_lines, digest_post, upsert_snapshot, liveness, resolve_memo, page_records, ingest_run, ingest_stats, graph_records, job_filters, page_texts, similar_jobs, rewrite_new, dedup_stored, crawl_flat, link_check, fingerprint_scripts, page_errors, resolve_again, search_index, description_rows, page_windows, jobs_json, sitemap_pages, sitemap_stream,
)}

_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '([0-9]),([0-9])', '\\1\\2', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_LIST_WHERE = "c_mktsegment = 'BUILDING' AND c_name ILIKE '%customer%' AND c_acctbal >= 0 AND c_custkey % 7 <> 0"
_KIND = "CASE o_orderkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"
_LPA = "CASE WHEN {0} % 100000 = 0 THEN CAST({0} // 100000 AS VARCHAR) ELSE printf('%.1f', {0} / 100000.0) END"
_N, _M = "CAST(p_size AS BIGINT)", "CAST(p_size + 5 AS BIGINT)"

SQL = {
    "flagship": "SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY jobs DESC, o_orderstatus) AS place FROM (SELECT c_mktsegment, o_orderstatus, count(*) AS jobs, max(o_orderdate) AS newest, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "list_filter_page": f"SELECT c_custkey AS id, c_name AS title, c_acctbal AS salary_min FROM customer WHERE {_LIST_WHERE} ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 10",
    "list_total": f"SELECT count(*) AS total FROM customer WHERE {_LIST_WHERE}",
    "sort_oldest_first": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS posted_at FROM orders ORDER BY posted_at ASC NULLS FIRST, id LIMIT 50",
    "lookup_by_id": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, 'New: ' || p_type AS description, 'https://end.example.com/7' AS apply_url FROM part WHERE p_partkey = 7",
    "search_or": "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%brass%'",
    "tags_contains": "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS tags, string_split(p_name, ' ')[1] AS first FROM part WHERE list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'blue') OR p_partkey % 10 = 0",
    "url_host": f"SELECT page_id, {_HOST} AS host FROM pages",
    "url_path_key": f"SELECT page_id, {_HOST} || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS url_key FROM pages",
    "aggregator_flag": f"SELECT page_id, coalesce(regexp_replace({_HOST}, '^www\\.', '') IN ('example.com', 'example.net') OR {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.net', false) AS flag FROM pages",
    "apply_type": f"SELECT page_id, CASE WHEN {_HOST} IS NULL THEN 'UNKNOWN' WHEN {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' THEN 'DIRECT' ELSE 'EXTERNAL' END AS apply_type, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS slug FROM pages",
    "recheck_resolved": "SELECT page_id, page_id % 3 <> 0 AND page_id % 5 <> 0 AS is_external FROM pages",
    "fingerprint": f"SELECT p_partkey, sha256({_SLUG.format('p_name')} || '|' || {_SLUG.format('p_brand')} || '|' || CASE WHEN p_partkey % 2 = 0 THEN {_SLUG.format('p_type')} ELSE 'unknown' END) AS fingerprint FROM part",
    "job_id": "SELECT o_orderkey, sha256(o_orderstatus || ':' || o_orderkey) AS id FROM orders",
    "dedup_exact": "SELECT md5(text) AS key, min(doc_id) AS first_doc, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "dedup_sources": "SELECT key, string_agg(source, ',' ORDER BY first) AS sources FROM (SELECT md5(text) AS key, source, min(doc_id) AS first FROM documents GROUP BY 1, 2) GROUP BY 1",
    "recency_window": "SELECT event_id AS id, ts AS scraped_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND event_type <> 'error'",
    "early_stop_prefix": "SELECT event_id, value FROM (SELECT event_id, value, max(CASE WHEN value < 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stale FROM events) WHERE stale = 0",
    "html_title_links": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[1] AS first_link FROM pages",
    "html_text": r"""SELECT page_id, md5(nullif(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '<>', 'g'), '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '')) AS text_md5 FROM pages""",
    "json_field": "SELECT event_id, TRY_CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events",
    "salary_parse": f"""SELECT p_partkey, CASE k WHEN 0 THEN n || '-' || m || ' LPA' WHEN 1 THEN n || ' LPA' WHEN 2 THEN n || 'k-' || m || 'k per month' WHEN 3 THEN n || 'k/month' WHEN 4 THEN n || ' - ' || m || ' per hour' WHEN 5 THEN 'Rs ' || n || '00000 to ' || m || '99999 per annum' WHEN 6 THEN 'Not disclosed' ELSE n || '.5 lakhs per annum' END AS raw,
      CAST(CASE k WHEN 0 THEN n * 100000 WHEN 1 THEN n * 100000 WHEN 2 THEN n * 1000 WHEN 3 THEN n * 1000 WHEN 4 THEN n WHEN 5 THEN n * 100000 WHEN 7 THEN n * 100000 + 50000 END AS INTEGER) AS salary_min,
      CAST(CASE k WHEN 0 THEN m * 100000 WHEN 1 THEN n * 100000 WHEN 2 THEN m * 1000 WHEN 3 THEN n * 1000 WHEN 4 THEN m WHEN 5 THEN m * 100000 + 99999 WHEN 7 THEN n * 100000 + 50000 END AS INTEGER) AS salary_max,
      CASE WHEN k IN (0, 1, 5, 7) THEN 'annual' WHEN k IN (2, 3) THEN 'monthly' WHEN k = 4 THEN 'hourly' END AS salary_period, k <> 6 AS has_salary
      FROM (SELECT p_partkey, p_partkey % 8 AS k, {_N} AS n, {_M} AS m FROM part)""",
    "seniority_bucket": "SELECT p_partkey, CASE WHEN y = 0 THEN 'fresher' WHEN y <= 2 THEN 'junior' WHEN y <= 5 THEN 'mid' WHEN y <= 8 THEN 'senior' ELSE 'lead' END AS seniority FROM (SELECT p_partkey, p_size % 12 AS y FROM part)",
    "employment_map": "SELECT o_orderkey, " + _KIND.format("'full-time'", "'contract'", "'freelance'", "'full_time, intern'", "'remote / contractor'") + " AS one, " + _KIND.format("'full-time'", "'contract'", "NULL", "'full-time'", "'contract'") + " AS listed FROM orders",
    "remote_scope": "SELECT o_orderkey, o_orderkey % 5 IN (0, 4) AS is_remote, o_orderkey % 5 IN (0, 2, 4) AS in_scope FROM orders",
    "missing_fields": "SELECT d.doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN lang <> 'en' THEN 'english' END) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "similar_top4": "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_partkey, position - 1 AS position, similar_id FROM (SELECT a.p_partkey, b.p_partkey AS similar_id, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.n) AS position FROM r a JOIN r b ON a.p_brand = b.p_brand AND b.n <= 5 AND a.p_partkey <> b.p_partkey) WHERE position <= 4",
    "run_stats": """SELECT event_type AS source, count(*) AS fetched, count(*) FILTER (value > 10) AS normalized, count(*) FILTER (value <= 10) AS dropped_invalid, count(*) FILTER (value > 30) AS external_kept, count(*) FILTER (value > 30 AND value <= 50) AS downgraded_after_resolution,
      count(*) FILTER (value > 70) AS inserted, count(*) FILTER (value > 50 AND value <= 70) AS merged_duplicates, count(*) FILTER (value > 70 AND event_id % 2 = 0) AS rewritten, CAST(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END AS BIGINT) AS error FROM events GROUP BY ROLLUP (event_type)
      UNION ALL SELECT 'down', 0, 0, 0, 0, 0, 0, 0, 0, 1""",
    "display_fields": f"""SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS title, upper(p_name[1]) AS initial,
      CASE WHEN p_size % 5 = 0 THEN NULL WHEN a IS NULL AND b IS NULL THEN 'raw' WHEN a IS NOT NULL AND b IS NOT NULL THEN {_LPA.format('a')} || '-' || {_LPA.format('b')} || ' LPA' ELSE {_LPA.format('coalesce(a, b)')} || ' LPA' END AS salary,
      CASE p_size % 6 WHEN 0 THEN 'Fresher' WHEN 1 THEN '1-3 yrs' WHEN 2 THEN '3-6 yrs' WHEN 3 THEN '6+ yrs' WHEN 4 THEN 'Lead' ELSE 'Other' END AS experience,
      length(p_name) <= 60 AND NOT regexp_matches(p_name, '[.!?]$') AS heading
      FROM (SELECT *, CASE WHEN p_size % 3 <> 0 THEN p_size * 50000 END AS a, CASE WHEN p_size % 4 <> 0 THEN (p_size + 6) * 50000 END AS b FROM part)""",
    "digest_lines": """SELECT p_partkey, '• ' || CASE WHEN length(t) <= 42 THEN t ELSE CASE WHEN contains(u, ' ') THEN regexp_extract(u, '(?s)^(.*) [^ ]*$', 1) ELSE u END || '…' END || CASE WHEN p_partkey % 3 <> 0 THEN ' — ' || p_brand ELSE '' END AS line
      FROM (SELECT *, trim(repeat(p_name, 3)) AS t, rtrim(left(trim(repeat(p_name, 3)), 41)) AS u FROM part)""",
    "upsert_snapshot": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE '' END || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS source, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN 'b' ELSE '' END AS others, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS scraped_at, o_orderkey % 7 <> 0 AS is_active FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
    "liveness": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderkey % 10 IN (0, 1) OR o_orderkey % 100 % 25 = 24)",
    "resolve_memo": "SELECT page_id, CASE WHEN u <> '' AND NOT starts_with(u, 'https:') THEN u || '#end' END AS apply_url, CASE WHEN u <> '' AND NOT starts_with(u, 'https:') THEN 'final.example.com' END AS resolved_domain FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)",
}
_AGO = "CAST({0} AS VARCHAR) || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END || ' ago'"
SQL["display_times"] = (
    "SELECT o_orderkey, day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) AS day, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN "
    + _AGO.format("(s // 60)", "minute") + " WHEN s < 86400 THEN " + _AGO.format("(s // 3600)", "hour") + " WHEN s < 2592000 THEN " + _AGO.format("(s // 86400)", "day") + " ELSE " + _AGO.format("(s // 2592000)", "month")
    + " END AS ago FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) AS BIGINT) AS s FROM orders)"
)

_PARTS = """SELECT p_partkey AS k, 'Engineer ' || p_partkey // 2 AS title, 'part-' || p_partkey AS external_id, p_type, p_partkey % 20 AS n, p_partkey % 12 AS y,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 6 = 0 THEN 'https://www.jobfound.org/x/' || p_partkey ELSE 'https://careers.example.com/' || p_partkey || '/?a=b' END AS u
  FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0"""
_YEARS = "CASE WHEN k % 5 = 0 THEN NULL WHEN y = 0 THEN 'fresher' WHEN y <= 2 THEN 'junior' WHEN y <= 5 THEN 'mid' WHEN y <= 8 THEN 'senior' ELSE 'lead' END"
SQL["page_records"] = f"""SELECT external_id, sha256('jobfound:' || external_id) AS id, sha256('engineer-' || k // 2 || '|say-a-b|pune') AS fingerprint, title, 'Say "A\\B"' AS company, 'Pune' AS location, k % 3 = 0 AS is_remote,
  CASE WHEN k % 2 = 0 THEN 'full-time' END AS employment_type, {_YEARS} AS seniority, CAST(CASE WHEN k % 4 <> 0 THEN n * 100000 END AS INTEGER) AS salary_min, CAST(CASE WHEN k % 4 <> 0 THEN (n + 5) * 100000 END AS INTEGER) AS salary_max,
  CASE WHEN k % 4 <> 0 THEN 'annual' END AS salary_period, CASE WHEN k % 4 <> 0 THEN n || '-' || n + 5 || ' LPA' END AS salary_raw, k % 4 <> 0 AS has_salary, CASE WHEN u = '' THEN 'UNKNOWN' WHEN k % 6 = 0 THEN 'DIRECT' ELSE 'EXTERNAL' END AS apply_type, u AS raw_apply_url,
  TIMESTAMP '2024-01-01 12:00:00' AS posted_at, u <> '' AS is_valid, replace(p_type, ' ', '|') || '|Engineering' AS tags,
  concat_ws(',', CASE WHEN k % 3 = 2 THEN 'is_remote' END, CASE WHEN k % 2 = 1 THEN 'employment_type' END, CASE WHEN k % 5 = 0 THEN 'seniority' END, CASE WHEN k % 4 = 0 THEN 'salary_min,salary_max,salary_period,salary_raw' END, 'description_original', CASE WHEN u = '' THEN 'raw_apply_url' END) AS missing
  FROM ({_PARTS})"""
# Of two parts with the same title the one of the lesser id, a digest, arrives first.
_FIRST = f"SELECT *, row_number() OVER (PARTITION BY title ORDER BY sha256('jobfound:' || external_id)) AS place FROM ({_PARTS}) WHERE u <> '' AND k % 6 <> 0"
SQL["ingest_run"] = f"SELECT 'jobfound' AS source, title, u AS apply_url, {_YEARS} AS seniority, true AS is_active, false AS is_rewritten, TIMESTAMP '2024-01-02' AS scraped_at FROM ({_FIRST}) WHERE place = 1"
_COUNTS = f"""SELECT (SELECT count(*) FROM ({_PARTS})) AS fetched, (SELECT count(*) FROM ({_PARTS}) WHERE u <> '') AS normalized, (SELECT count(*) FROM ({_PARTS}) WHERE u = '') AS dropped_invalid, count(*) AS external_kept,
  CAST(0 AS BIGINT) AS downgraded_after_resolution, count(*) FILTER (place = 1) AS inserted, count(*) FILTER (place > 1) AS merged_duplicates, CAST(0 AS BIGINT) AS rewritten, CAST(0 AS BIGINT) AS error FROM ({_FIRST})"""
SQL["ingest_stats"] = f"SELECT s.source, c.* FROM (VALUES ('jobfound'), (NULL)) s(source), ({_COUNTS}) c"
_SHOWN = "CASE WHEN p_partkey % 6 = 1 THEN 'New: ' || p_type ELSE 'Told: <b>' || p_name END"
SQL["job_filters"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS company, p_size * 1000 AS salary_min, {_SHOWN} AS description, p_partkey % 6 < 2 AS is_rewritten,
  CASE WHEN p_partkey % 3 <> 0 THEN 'https://end.example.com/' ELSE 'https://raw.example.com/' END || p_partkey AS apply_url
  FROM part WHERE p_partkey % 8 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AND list_contains(string_split(p_name, ' '), 'red') AND p_size >= 5 AND (p_name ILIKE '%e%' OR p_brand ILIKE '%e%') ORDER BY p_partkey LIMIT 100"""
SQL["page_texts"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' at ' || p_brand || ' — ' || CASE WHEN p_partkey % 2 = 0 THEN 'Remote' WHEN p_partkey % 4 <> 0 THEN p_type ELSE 'India' END AS page_title, left({_SHOWN}, 12) AS excerpt, replace(p_name, ' ', '|') AS paragraphs,
  CASE WHEN p_partkey % 2 = 0 THEN 'FULL_TIME' ELSE 'CONTRACT' END AS ld_type, CASE WHEN p_partkey % 2 = 0 THEN 'TELECOMMUTE' END AS ld_remote, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS ld_place,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 2000 AS VARCHAR) END AS ld_max, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 'YEAR' END AS ld_unit, false AS ld_open FROM part"""
SQL["similar_jobs"] = """SELECT id FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 97 END AS posted FROM part
  WHERE p_partkey % 8 <> 0 AND list_contains(string_split(p_name, ' '), (SELECT string_split(p_name, ' ')[1] FROM part WHERE p_partkey = 7)) ORDER BY posted DESC NULLS LAST, id LIMIT 5) WHERE id <> '7' ORDER BY posted DESC NULLS LAST, id LIMIT 4"""
SQL["rewrite_new"] = "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_brand) || ' ' || p_partkey END AS rewritten_description FROM part"
SQL["dedup_stored"] = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 2 = 0 OR p_partkey % 5 <> 0) THEN 'old' || p_partkey END AS target, CAST(NULL AS BIGINT) AS new_seq FROM part"
SQL["crawl_flat"] = "SELECT 'https://jobfound.org/job/' || p_partkey AS url FROM part WHERE p_partkey < 100 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"
SQL["link_check"] = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey % 8 <> 0 AND p_partkey % 9 NOT IN (0, 1) AS is_active FROM part"
# Titles with "Sales Executive" are out of scope; the zone of the date is its own.
SQL["graph_records"] = """SELECT 'p-' || k AS external_id, title, 'Acme' AS company, CASE WHEN k % 4 <> 0 THEN 'Pune, MH' ELSE 'Pune' END AS location, k % 4 = 3 AS is_remote, CASE k % 3 WHEN 0 THEN 'full-time' WHEN 2 THEN 'contract' END AS employment_type,
  CASE WHEN k % 4 = 1 THEN 'fresher' WHEN y = 0 THEN 'fresher' WHEN y <= 2 THEN 'junior' WHEN y <= 5 THEN 'mid' WHEN y <= 8 THEN 'senior' ELSE 'lead' END AS seniority,
  CAST(CASE WHEN paid THEN low END AS INTEGER) AS salary_min, CAST(CASE WHEN paid THEN coalesce(high, low) END AS INTEGER) AS salary_max, CASE WHEN k % 3 <> 0 THEN 'USD' ELSE 'INR' END AS salary_currency, CASE WHEN paid THEN CASE k % 3 WHEN 0 THEN 'annual' ELSE 'monthly' END END AS salary_period,
  CASE WHEN paid THEN low || CASE WHEN high IS NOT NULL THEN '-' || high ELSE '' END || CASE k % 3 WHEN 0 THEN ' per annum' ELSE ' per month' END END AS salary_raw, paid AS has_salary,
  CASE WHEN k % 2 = 0 THEN 'Full' || chr(10) || 'in' || chr(10) || 'ner' ELSE 'Short' END AS description_original, CASE WHEN k % 5 = 0 THEN 'UNKNOWN' ELSE 'EXTERNAL' END AS apply_type,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://x.io/' ELSE 'https://no.io/' END AS raw_apply_url, TIMESTAMP '2024-01-01 14:30:00' AS posted_at, k % 5 <> 0 AS is_valid, 'Java|SQL' AS tags
  FROM (SELECT p_partkey AS k, p_partkey % 10 + 1 AS low, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 10 + 1 + p_partkey % 4 END AS high, p_partkey % 3 <> 2 AS paid, p_partkey % 150 // 12 AS y,
    CASE p_partkey % 4 WHEN 0 THEN 'Software Engineer ' WHEN 1 THEN 'Fresher Developer ' ELSE 'Remote SDE ' END || p_partkey AS title FROM part WHERE p_partkey % 4 <> 2 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0)"""
_TITLE_SLUG = "CASE p_partkey % 6 " + " ".join(f"WHEN {n} THEN '{slug}'" for n, (_, slug) in enumerate(_TITLES)) + " END || '-' || p_partkey // 6"
SQL["fingerprint_scripts"] = f"SELECT p_partkey, {_TITLE_SLUG} AS slug, sha256({_TITLE_SLUG} || '|' || {_SLUG.format('p_brand')} || '|unknown') AS fingerprint, CAST(1 AS BIGINT) AS alike FROM part"
SQL["page_errors"] = f"""SELECT title, 'Told' AS description_original, NULL AS url, NULL AS error FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY sha256('jobfound:' || external_id)) AS place FROM ({_PARTS}) WHERE u <> '' AND k % 6 <> 0 AND k % 10 <> 3) WHERE place = 1
  UNION ALL SELECT NULL, NULL, 'https://jobfound.org/job/' || k, 'AssertionError' FROM ({_PARTS}) WHERE k % 10 = 3"""
SQL["resolve_again"] = """SELECT page_id, CASE WHEN https THEN NULL WHEN early THEN u || '#1' ELSE u || '#2' END AS second, CASE WHEN https THEN u || '#3' WHEN early THEN u || '#1' ELSE u || '#2' END AS third,
  CASE WHEN https THEN 'run3' WHEN early THEN 'run1' ELSE 'run2' END || '.example.com' AS resolved_domain
  FROM (SELECT page_id, u, starts_with(u, 'https:') AS https, bool_or(page_id % 2 = 0) OVER (PARTITION BY u) AS early FROM (SELECT page_id, nullif(regexp_replace(url, '[?#].*$', ''), '') AS u FROM pages))"""
SQL["search_index"] = "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%old%idg%' OR p_type ILIKE '%romo%'"
SQL["description_rows"] = f"SELECT external_id, CASE WHEN k % 7 <> 0 THEN 'Nä ' || k || chr(10) || '☃' END AS description_original, k % 7 <> 0 AS description_available, k % 7 = 0 AS missing FROM ({_PARTS})"
SQL["page_windows"] = """SELECT nation, pages, current, coalesce(array_to_string(range(greatest(1, current - 2), least(pages, current + 2) + 1), ','), '') AS shown, current <= pages + 2 AND current > 3 AS gap_before, current <= pages + 2 AND current + 2 < pages AS gap_after
  FROM (SELECT c_nationkey AS nation, (count(*) + 4) // 5 AS pages, CAST(c_nationkey + 1 AS BIGINT) AS current FROM customer GROUP BY 1) WHERE pages > 1"""
SQL["jobs_json"] = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 1000 AS VARCHAR) END AS salary_min, string_split(p_name, ' ')[1] AS tag, CASE WHEN p_partkey % 8 <> 0 THEN 'true' ELSE 'false' END AS is_active, p_partkey % 10 = 0 AS undated, 22 AS fields FROM part"
# The longest of six renderings, of five lines to none, that fits 280 characters, where the link counts as 23.
SQL["digest_post"] = """WITH w AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, '• Order ' || o_orderpriority || ' — ' || o_orderstatus AS line, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 720 HOUR),
  n AS (SELECT count(*) AS job_count FROM w), l AS (SELECT list(line ORDER BY o_orderdate DESC, id) AS lines FROM (SELECT * FROM w ORDER BY o_orderdate DESC, id LIMIT 5) t),
  r AS (SELECT k, job_count, CASE WHEN job_count = 1 THEN '🚀 1 new tech job in India today' ELSE '🚀 ' || job_count || ' new tech jobs in India today' END || chr(10) || chr(10) || array_to_string(lines[1:k], chr(10)) || CASE WHEN k > 0 THEN chr(10) ELSE '' END
      || CASE WHEN job_count > k THEN '+' || job_count - k || ' more' || chr(10) ELSE '' END || chr(10) || 'Apply 👉 https://example.com/a/rather/long/path' AS message FROM n, l, range(0, 6) s(k) WHERE k <= len(lines)),
  x AS (SELECT *, CAST(length(message) - length('https://example.com/a/rather/long/path') + 23 AS INTEGER) AS x_length FROM r)
  SELECT message, job_count, CAST(k AS INTEGER) AS listed_count, x_length, x_length <= 280 AS fits, CAST(720 AS DOUBLE) AS window_hours FROM x ORDER BY fits DESC, CASE WHEN fits THEN -k ELSE k END LIMIT 1"""
_LISTED = """SELECT 'site/' || page_id // 50 AS sitemap, page_id AS pos, html, page_id % 11 <> 0 AND html IS NOT NULL AS had, CASE WHEN page_id % 50 % 7 = 3 THEN 'soon' WHEN page_id % 50 % 5 <> 4
  THEN strftime(TIMESTAMP '2024-01-31' - to_seconds((page_id % 50) * (page_id // 50 % 3 + 1) * 43200), '%Y-%m-%dT%H:%M:%SZ') END AS "at" FROM pages"""
SQL["sitemap_pages"] = f"""WITH l AS ({_LISTED}), s AS (SELECT sitemap, min(pos) AS stop FROM l WHERE "at" < '2024-01-21' GROUP BY 1)
SELECT l.sitemap, pos, "at", sha256(html) AS digest FROM l LEFT JOIN s ON l.sitemap = s.sitemap WHERE had AND (stop IS NULL OR pos < stop)"""
SQL["sitemap_stream"] = f"SELECT sitemap, pos, CAST(CASE WHEN pos % 50 < 20 THEN 1 ELSE 0 END AS BIGINT) AS batch FROM ({_LISTED}) WHERE had"
