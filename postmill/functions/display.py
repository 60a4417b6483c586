"""What a page shows of a job: money, ages, dates, labels, structured data, page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import or_null, strip


def _lpa(n: Column) -> Column:
    x = n / F.lit(100_000.0)
    return F.when(n % 100_000 == 0, F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))


def format_salary(low: Column, high: Column, currency: Column, period: Column, raw: Column, has: Column) -> Column:
    a, b = F.coalesce(low, F.lit(0)) != 0, F.coalesce(high, F.lit(0)) != 0
    annual = (currency == "INR") & F.coalesce(period == "annual", F.lit(True))
    one = F.coalesce(low, high)
    single = F.when(one != 0, F.concat(_lpa(one), F.lit(" LPA")))
    return F.when(has, F.when(annual & (a | b), F.when(a & b, F.concat(_lpa(low), F.lit("-"), _lpa(high), F.lit(" LPA"))).otherwise(single)).otherwise(raw))


def time_ago(then: Column, now: Column) -> Column:
    s = F.floor(F.unix_millis(now.cast("timestamp")) / 1000 - F.unix_millis(then.cast("timestamp")) / 1000)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    d = F.floor(h / 24)

    def said(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(then.isNull(), F.lit(None)).when(s < 60, "just now").when(m < 60, said(m, "minute")).when(h < 24, said(h, "hour")).when(d < 30, said(d, "day")).otherwise(said(F.floor(d / 30), "month"))


def format_date(t: Column) -> Column:
    return F.date_format(t, "d MMMM yyyy")


def title_case(c: Column) -> Column:
    """The first letter upper, the rest as it is."""
    x = or_null(c)
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))


def experience_label(seniority: Column) -> Column:
    # Fixed values.
    labels = {"fresher": "Fresher", "junior": "1-3 yrs", "mid": "3-6 yrs", "senior": "6+ yrs", "lead": "Lead"}
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(known, or_null(seniority)), title_case(seniority))


def company_initial(c: Column) -> Column:
    return F.coalesce(or_null(F.upper(F.left(strip(c), F.lit(1)))), F.lit("?"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), strip), lambda x: x != "")


def looks_like_heading(line: Column) -> Column:
    return (F.length(line) <= 60) & ~line.rlike(r"[.!?]$") & ~F.startswith(line, F.lit("•"))


def page_title(title: Column, company: Column, is_remote: Column, location: Column) -> Column:
    return F.concat(title, F.lit(" at "), company, F.lit(" — "), F.when(is_remote, "Remote").otherwise(F.coalesce(or_null(location), F.lit("India"))))


def excerpt(text: Column, size: int = 155) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(size))


def json_ld() -> Column:
    """schema.org data of a job of the public projection; missing parts are left out, ``<`` is escaped."""
    money = F.when(
        F.col("has_salary") & ((F.coalesce("salary_min", F.lit(0)) != 0) | (F.coalesce("salary_max", F.lit(0)) != 0)),
        F.struct(
            F.lit("MonetaryAmount").alias("@type"),
            F.col("salary_currency").alias("currency"),
            F.struct(F.lit("QuantitativeValue").alias("@type"), F.col("salary_min").alias("minValue"), F.col("salary_max").alias("maxValue"), F.when(F.col("salary_period") == "annual", "YEAR").alias("unitText")).alias("value"),
        ),
    )
    place = F.when(
        or_null(F.col("location")).isNotNull(),
        F.struct(F.lit("Place").alias("@type"), F.struct(F.lit("PostalAddress").alias("@type"), F.col("location").alias("addressLocality"), F.lit("IN").alias("addressCountry")).alias("address")),
    )
    payload = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("JobPosting").alias("@type"),
        F.col("title"),
        F.coalesce("description", "title").alias("description"),
        F.coalesce("posted_at", "scraped_at").alias("datePosted"),
        F.regexp_replace(F.upper("employment_type"), "^([^-]*)-", "$1_").alias("employmentType"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("hiringOrganization"),
        F.lit(False).alias("directApply"),
        place.alias("jobLocation"),
        F.when(F.col("is_remote"), "TELECOMMUTE").alias("jobLocationType"),
        money.alias("baseSalary"),
    )
    return F.replace(F.to_json(payload), F.lit("<"), F.lit("\\u003c"))


def pages(total: Column, limit: Column, offset: Column, window: int = 2) -> Column:
    """The number of pages, the current one, and the numbers around it, none where it lies far beyond the last; null for a single page."""
    count = F.ceil(total / limit).cast("bigint")
    current = (F.floor(offset / limit) + 1).cast("bigint")
    first, last = F.greatest(F.lit(1).cast("bigint"), current - window), F.least(count, current + window)
    some = first <= last
    shown = F.when(some, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    return F.when(count > 1, F.struct(count.alias("pages"), current.alias("current"), shown.alias("shown"), (some & (first > 1)).alias("gap_before"), (some & (last < count)).alias("gap_after")))


def page_numbers(total: int, limit: int, offset: int, window: int = 2) -> dict | None:
    """Pages, the current one, and the numbers around it; None for a single page."""
    pages = -(-total // limit)
    if pages <= 1:
        return None
    current = offset // limit + 1
    shown = list(range(max(1, current - window), min(pages, current + window) + 1))
    return {"pages": pages, "current": current, "shown": shown, "gap_before": bool(shown) and shown[0] > 1, "gap_after": bool(shown) and shown[-1] < pages}
