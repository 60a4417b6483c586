"""Examples of every function's rules."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from postmill.config import Settings
from postmill.functions import classify, digest, display, text, url
from postmill.functions.salary import parse_salary
from postmill.operators.network import rewritten
from postmill.plans.jobs import JobQuery


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


SALARIES = {
    "₹8-12 LPA": (800000, 1200000, "annual"), "8 to 12 lakhs per annum": (800000, 1200000, "annual"), "6 LPA": (600000, 600000, "annual"), "50k/month": (50000, 50000, "monthly"),
    "40,000 - 60,000 per month": (40000, 60000, "monthly"), "40k-60k per month": (40000, 60000, "monthly"), "500 per hour": (500, 500, "hourly"), "₹300-500/hr": (300, 500, "hourly"),
    "800000-1200000 per annum": (800000, 1200000, "annual"), "8 LPA - 12 LPA": (800000, 800000, "annual"), "40-60k per month": (40, 60000, "monthly"), "5-15k per month": (5000, 15000, "monthly"),
    "500.5 per hour": (500, 500, "hourly"), "3 paid leaves": (3, 3, "annual"), "USD 50/hr": (50, 50, "hourly"), "7.5 lakh": (750000, 750000, "annual"), "1,20,000 p.a.": (120000, 120000, "annual"),
}


def test_salary(spark):
    got = run(spark, list(SALARIES), parse_salary)
    assert {k: (r.salary_min, r.salary_max, r.salary_period) for k, r in zip(SALARIES, got, strict=True)} == SALARIES
    nothing = ["Not disclosed", "Negotiable", "₹ Negotiable", "INR Not Disclosed", "Confidential", None, "", "   ", "competitive pay", "-"]
    assert all(r == Row(salary_min=None, salary_max=None, salary_period=None, has_salary=False) for r in run(spark, nothing, parse_salary))


def test_slug_and_keys(spark):
    assert run(spark, ["Héllo,  Wörld!", "C++ / C#", "1,000 jobs", "Straße", None], text.slugify) == ["hello-world", "c-c", "1000-jobs", "strasse", None]
    a, b = run(spark, ["x", "X "], lambda c: text.fingerprint(c, F.lit("Co"), F.lit("")))
    assert a == b and len(a) == 64
    assert run(spark, ["  a b  "], text.strip) == ["a b"]


def test_urls(spark):
    hosts = ["https://WWW.Example.com/a", "x_y.com/a", "http://u:p@h.io:80/p?q", "//h.io", "", None, "mailto:a@b"]
    assert run(spark, hosts, url.host) == ["www.example.com", None, "h.io", "h.io", None, None, None]
    assert run(spark, ["linkedin.com", "www.indeed.com", "jobs.naukri.com", "notlinkedin.com", None, ""], url.is_aggregator) == [True, True, True, False, False, False]
    kinds = ["https://jobs.acme.com/1", "https://own.org/x", "https://www.own.org", "https://a.own.org", "https://in.linkedin.com/j", "", None, "nohost"]
    assert run(spark, kinds, lambda c: url.apply_type(c, "own.org")) == ["EXTERNAL", "DIRECT", "DIRECT", "DIRECT", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert run(spark, ["https://h/a%20b/?q#f", "https://h/", None], lambda c: url.url_key(c, F.lit("h"))) == ["h/a b", "h", None]


def test_classify(spark):
    assert run(spark, ["0", "2-4", "5+", "8-10 years", "9", "none", None, "99999999999999999999"], classify.seniority) == ["fresher", "junior", "mid", "senior", "lead", None, None, "lead"]
    assert run(spark, ["Full-Time", "temporary", "Gig", "", None], classify.employment) == ["full-time", "contract", "gig", None, None]
    assert run(spark, ["full-time, remote", "FULL_TIME, INTERN", "REMOTE", "part time/x", None], classify.employment_of_list) == ["full-time", "full-time", None, "part-time", None]
    assert run(spark, ["Remote dev", "hybrid remote", "Virtual", "office"], classify.inferred_remote) == [True, False, True, False]
    assert run(spark, ["Software Engineer", "Python", "Software Sales Executive", "Full Stack Developer", "Manager"], lambda c: classify.in_scope(c, F.lit(None).cast("string"))) == [True, False, False, True, False]
    got = run(spark, ["2026-08-07T11:20:49.459Z", "2026-08-07", "2026-08-07T11:20:49+05:30", "20260807T112049", "2026", "soon", None], classify.iso_time)
    assert [g and g.strftime("%d %H:%M") for g in got] == [x if x is None else x for x in ["07 11:20", "07 00:00", "07 05:50", "07 11:20", None, None, None]]


def test_display(spark):
    one = spark.range(1)
    row = one.select(
        display.format_salary(F.lit(600000), F.lit(1250000), F.lit("INR"), F.lit(None).cast("string"), F.lit("r"), F.lit(True)).alias("a"),
        display.format_salary(F.lit(0), F.lit(500000), F.lit("INR"), F.lit("annual"), F.lit("r"), F.lit(True)).alias("b"),
        display.format_salary(F.lit(50), F.lit(50), F.lit("USD"), F.lit("annual"), F.lit("raw"), F.lit(True)).alias("c"),
        display.title_case(F.lit("full-time")).alias("d"),
        display.company_initial(F.lit("  ")).alias("e"),
        display.paragraphs(F.lit("a\n\n b \n")).alias("f"),
        display.page_title(F.lit("Dev"), F.lit("Co"), F.lit(False), F.lit("")).alias("g"),
    ).first()
    assert row.asDict() == {"a": "6-12.5 LPA", "b": None, "c": "raw", "d": "Full-time", "e": "?", "f": ["a", "b"], "g": "Dev at Co — India"}
    now = F.lit(dt.datetime(2026, 8, 7, 12, tzinfo=dt.UTC))
    ages = [dt.datetime(2026, 8, 7, 12, 5), dt.datetime(2026, 8, 7, 11, 59, 30), dt.datetime(2026, 8, 7, 11, 59), dt.datetime(2026, 8, 6, 13), dt.datetime(2026, 8, 5), dt.datetime(2025, 8, 5), None]
    assert run(spark, ages, lambda c: display.time_ago(c, now), "timestamp") == ["just now", "just now", "1 minute ago", "23 hours ago", "2 days ago", "12 months ago", None]
    assert display.page_numbers(10, 20, 0) is None
    assert display.page_numbers(200, 20, 100) == {"pages": 10, "current": 6, "shown": [4, 5, 6, 7, 8], "gap_before": True, "gap_after": True}


@pytest.mark.parametrize(("n", "long"), [(0, False), (1, False), (3, False), (5, False), (9, True), (12, True), (12, False)])
def test_digest(spark, n, long):
    site = "https://example.com/some/long/path/that/is/billed/short"
    lines = [(i, ("Senior Staff Platform Reliability Engineer Number " * 3 if long else f"Role {i}"), "Company With Quite A Long Name" if long else "Co") for i in range(min(n, 5))]
    df = spark.createDataFrame(lines or [(0, "", "")], "i int, t string, c string").where(F.lit(n > 0))
    one = df.agg(F.sort_array(F.collect_list(F.struct("i", digest.job_line(F.col("t"), F.col("c")).alias("l")))).alias("x"))
    got = one.select(digest.build(F.transform("x", lambda r: r["l"]), F.lit(n), site).alias("m")).first().m
    if not n:
        assert got is None
        return
    assert len(got) - len(site) + 23 <= 280 and got.count(site) == 1
    shown = got.count("• ")
    assert ("+%d more" % (n - shown) in got) == (n > shown)
    assert got.startswith("\U0001f680 1 new tech job in" if n == 1 else f"\U0001f680 {n} new tech jobs")


def test_query_rules():
    assert JobQuery.from_params({"q": ["", "x"], "tag": "t", "is_remote": "true", "has_salary": "false", "offset": "-3", "limit": "5"}) == JobQuery(tag="t", is_remote=True, limit=5)
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"sort": "title"}, {"order": "up"}):
        with pytest.raises(ValueError):
            JobQuery(**bad)
    assert Settings.from_env({"MAX_JOB_AGE_HOURS": "48", "REWRITER_ENABLED": "true", "SITE_URL": " "}) == Settings(max_job_age_hours=48, rewriter_enabled=True)


def test_rewriter():
    def answers(*xs):
        it = iter(xs)
        waits = []
        return (lambda _: next(it)), waits

    call, waits = answers((429, None), (500, None), (200, " better "))
    assert rewritten("text", call, 2, waits.append) == "better" and waits == [1.0, 2.0]
    assert rewritten("text", answers((400, None))[0]) is None
    assert rewritten("text", answers((200, "  "))[0]) is None
    assert rewritten("  ", answers()[0]) is None and rewritten("x", None) is None
    assert rewritten("text", answers((0, None), (0, None), (0, None))[0], 2, lambda s: None) is None


def test_slugs_of_other_scripts(spark):
    said = {
        "Инженер-программист": "inzhener-programmist", "Объявление, щит": "obiavlenie-shchit", "Їжак Ёлка": "yizhak-iolka", "Μηχανικός Λογισμικού": "mekhanikos-logismikou", "Ψυχή": "psukhe", "अभियंता": "abhiyntaa", "প্রকৌশলী": "prkaushlii",
        "エンジニア": "enjinia", "さくら": "sakura", "한국어": "hangugeo", "מהנדס": "mhnds", "مهندس": "mhnds", "پژوهش": "pzhwhsh", "工程师": "u5de5-u7a0b-u5e08", "ครู": "ue04-ue23-ue39", "Ｆｕｌｌ １２": "full-12", "Đà Nẵng": "da-nang", "Straße": "strasse", "C++ / C#": "c-c",
        "1,200 roles": "1200-roles", "🙂": "", "": "", "𐍈": "u10348",
    }
    got = dict(zip(said, run(spark, list(said), text.slugify), strict=True))
    assert got == said
    assert run(spark, [None, "Ω"], text.slugify) == [None, "o"]


def test_every_letter_leaves_something(spark):
    """One title for each letter of the first planes: none is empty, but for signs that have no sound, and Han ones are all apart."""
    import unicodedata

    letters = [chr(c) for c in range(0x100, 0x3000) if unicodedata.category(chr(c)) in ("Ll", "Lo")]
    got = dict(zip(letters, run(spark, [f"x{ch}" for ch in letters], text.slugify), strict=True))
    assert {ch for ch, v in got.items() if v == "x"} <= {*"ъьء", *(ch for ch in letters if 0x900 <= ord(ch) <= 0xD7F)}
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    assert len(set(run(spark, han, text.slugify))) == len(han)
