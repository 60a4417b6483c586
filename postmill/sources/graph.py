"""A source whose pages hold a schema.org JobPosting, with link and description in the page."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import classify, url
from postmill.functions.salary import parse_salary
from postmill.functions.text import comma_list, or_else, or_null, strip
from postmill.sources.base import cutoff, register
from postmill.sources.html import parts_of, text_of
from postmill.sources.payload import job_posting

# The source's name and site, and its sitemap's entries.
NAME, SITE = "talentd", "talentd.in"
SITEMAP_URL = "https://www.talentd.in/jobs/sitemap.xml"
SITEMAP = r"<loc>(https://www\.talentd\.in/jobs/[^<]+)</loc>\s*<lastmod>([^<]+)</lastmod>"
ADDRESS = "$.jobLocation[0].address"


def _get(path: str) -> Column:
    return F.get_json_object("posting", path)


def _flag(test: Column, name: str) -> Column:
    return F.when(F.coalesce(test, F.lit(True)), F.lit(name))


def employment_text() -> Column:
    """A string as it is, a list joined by commas."""
    raw = _get("$.employmentType")
    items = F.filter(F.from_json(raw, "array<string>"), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.startswith(raw, F.lit("[")), F.array_join(items, ", ")).otherwise(F.coalesce(raw, F.lit("")))


def months() -> Column:
    raw = _get("$.experienceRequirements.monthsOfExperience")
    return F.when(F.lower(raw).isin("true", "false"), F.lit(None)).otherwise(F.floor(strip(raw).try_cast("double")))


def salary_text() -> Column:
    """``min-max unit`` or ``min unit``; null without a least amount or with an unknown unit."""
    units = F.create_map(*[F.lit(x) for kv in classify.SALARY_UNITS.items() for x in kv])
    unit = F.try_element_at(units, F.upper(_get("$.baseSalary.value.unitText")))
    low, high = _get("$.baseSalary.value.minValue"), _get("$.baseSalary.value.maxValue")
    same = F.coalesce(low.try_cast("double") == high.try_cast("double"), low == high)
    return F.when(low.isNotNull() & unit.isNotNull(), F.concat(low, F.when(high.isNotNull() & ~same, F.concat(F.lit("-"), high)).otherwise(""), F.lit(" "), unit))


class Graph:
    source_name = NAME
    max_pages = 400
    sitemap_url, sitemap_pattern, crawl_delay_seconds = SITEMAP_URL, SITEMAP, 1.5

    def entry_time(self, at: Column) -> Column:
        return classify.iso_time(at)

    def peek(self, html: Column) -> Column:
        return F.lit(None).cast("timestamp")  # the sitemap's dates end the walk, and parse judges the page's own

    def parse(self, pages: DataFrame, as_of: dt.datetime, max_age_hours: float = 24) -> DataFrame:
        rows = pages.select("url", "html", job_posting(F.col("html")).alias("posting")).where("posting is not null")
        rows = rows.withColumn("posted_at", classify.iso_time(_get("$.datePosted"))).withColumn("country", F.upper(strip(or_null(_get(f"{ADDRESS}.addressCountry")))))
        keep = classify.in_scope(_get("$.title"), _get("$.skills")) & (F.col("country").isNull() | (F.col("country") == "IN")) & (F.col("posted_at") >= cutoff(as_of, max_age_hours))
        rows = rows.where(keep).withColumn("parts", parts_of(F.col("html"), SITE))
        c = F.col
        return rows.select("url", "posting", "posted_at", url.slug(F.col("url")).alias("slug"), "parts.apply_url", "parts.description_html", c("parts.error").alias("page_error"))

    def normalize(self, raw: DataFrame) -> DataFrame:
        c = F.col
        city, region = (or_null(strip(_get(f"{ADDRESS}.{x}"))) for x in ("addressLocality", "addressRegion"))
        kind = or_null(_get("$.experienceRequirements"))
        text = F.when(~F.startswith(kind, F.lit("{")), kind)
        rows = raw.withColumns(
            {
                "title": F.coalesce(_get("$.title"), F.lit("")),
                "company": F.coalesce(_get("$.hiringOrganization.name"), F.lit("")),
                "external_id": F.coalesce(c("slug"), F.lit("")),
                "location": or_null(F.concat_ws(", ", city, region)),
                "employment_raw": employment_text(),
                "salary_raw": salary_text(),
                "body": text_of(c("description_html")),
                "snippet": text_of(_get("$.description")),
                "tags": comma_list(_get("$.skills")),
                "raw_apply_url": or_else(c("apply_url"), F.lit("")),
                "apply_type": url.apply_type(c("apply_url"), SITE),
                "salary_currency": or_else(_get("$.baseSalary.currency"), F.lit("INR")),
            }
        ).withColumns(
            {
                "employment_type": classify.employment_of_list(c("employment_raw")),
                "is_remote": classify.inferred_remote(c("title"), c("location"), c("slug"), c("employment_raw")),
                "seniority": classify.seniority_or_title(text, F.when(text.isNull(), months()), c("title")),
                "parsed": parse_salary(c("salary_raw")),
                "description_original": F.coalesce("body.text", "snippet.text"),
            }
        )
        none = ~c("parsed.has_salary")
        missing = [
            _flag(c("external_id") == "", "external_id"), _flag(c("location").isNull(), "location"), _flag(c("employment_type").isNull(), "employment_type"), F.lit("is_remote"),
            _flag(c("seniority").isNull(), "seniority"), _flag(none, "salary_min"), _flag(none, "salary_max"), _flag(none, "salary_period"), _flag(none & c("salary_raw").isNull(), "salary_raw"),
            _flag(c("description_original").isNull(), "description_original"), _flag(F.size("tags") == 0, "tags"), _flag(c("raw_apply_url") == "", "raw_apply_url"), _flag(c("posted_at").isNull(), "posted_at"),
        ]
        return rows.select(
            F.lit(NAME).alias("source"), "url", "external_id", "title", "company", "location", "is_remote", "employment_type", "seniority", "parsed.salary_min", "parsed.salary_max", "salary_currency",
            "parsed.salary_period", "salary_raw", "parsed.has_salary", "description_original", c("description_original").isNotNull().alias("description_available"), "tags", "apply_type", "raw_apply_url", "posted_at",
            F.array_compact(F.array(*missing)).alias("source_fields_missing"), F.coalesce("page_error", "body.error", F.when(c("body.text").isNull(), c("snippet.error"))).alias("corrupt"),
        )


register(Graph())
