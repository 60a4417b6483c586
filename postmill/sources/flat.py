"""A source whose pages stream one flat job object, its description apart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import classify, url
from postmill.functions.salary import parse_salary
from postmill.functions.text import comma_list, or_else, or_null, strip
from postmill.sources.base import cutoff, register
from postmill.sources.html import text_of
from postmill.sources.payload import buffer, text_row

# The source's name and site, its sitemap's job locations, and where the object stands.
NAME, SITE = "jobfound", "jobfound.org"
SITEMAP_URL = "https://www.jobfound.org/sitemap.xml"
SITEMAP = r"<loc>\s*(https?://(?:www\.)?jobfound\.org/job/[^<\s]+)\s*</loc>"
OBJECT = r'(?s)"initialJob":(\{.*?\}),"similarJobs"'
FIELDS = ("title", "slug", "companyName", "jobType", "experience", "domain", "location", "country", "skills", "applyUrl", "workplaceType", "postedAt", "salary", "description")


def _flag(test: Column, name: str) -> Column:
    return F.when(F.coalesce(test, F.lit(True)), F.lit(name))


class Flat:
    source_name = NAME
    max_pages = 500
    sitemap_url, sitemap_pattern, crawl_delay_seconds = SITEMAP_URL, SITEMAP, 1.0

    def entry_time(self, at: Column) -> Column:
        return F.lit(None).cast("timestamp")  # its sitemap has no dates of jobs

    def peek(self, html: Column) -> Column:
        """The page's own date, which ends the walk."""
        return classify.iso_time(F.get_json_object(or_null(F.regexp_extract(buffer(html), OBJECT, 1)), "$.postedAt"))

    def parse(self, pages: DataFrame, as_of: dt.datetime, max_age_hours: float = 24) -> DataFrame:
        rows = pages.select("url", buffer(F.col("html")).alias("buf"))
        # The object is parsed once; its fields come out of a generator, which filters on them aren't moved below.
        rows = rows.select("url", "buf", F.try_parse_json(or_null(F.regexp_extract("buf", OBJECT, 1))).alias("job"))
        rows = rows.select("url", "buf", F.inline(F.array(F.struct(*[F.try_variant_get("job", f"$.{f}", "string").alias(f) for f in FIELDS]))))
        rows = rows.withColumn("posted_at", classify.iso_time(F.col("postedAt")))
        keep = (F.lower(strip(F.col("country"))) == "india") & (F.col("posted_at") >= cutoff(as_of, max_age_hours))
        inline = or_null(F.col("description"))
        html = F.when(F.startswith("description", F.lit("$")), text_row(F.col("buf"), F.substr("description", F.lit(2)))).otherwise(inline)
        return rows.where(keep).withColumn("description_html", html).drop("buf", "country", "description")

    def normalize(self, raw: DataFrame) -> DataFrame:
        c = F.col
        work = F.lower(strip(F.coalesce(c("workplaceType"), F.lit(""))))
        tags = comma_list(c("skills"))
        role = or_null(c("domain"))
        tags = F.when(role.isNotNull() & ~F.coalesce(F.array_contains(tags, role), F.lit(False)), F.concat(tags, F.array(role))).otherwise(tags)
        rows = raw.withColumn("body", text_of(c("description_html"))).withColumns(
            {
                "title": or_else(c("title"), F.lit("")),
                "company": or_else(c("companyName"), F.lit("")),
                "external_id": or_else(c("slug"), F.lit("")),
                "location": or_null(c("location")),
                "is_remote": work == "remote",
                "employment_type": classify.employment(c("jobType")),
                "seniority": classify.seniority(c("experience")),
                "salary_raw": or_null(c("salary")),
                "parsed": parse_salary(c("salary")),
                "description_original": c("body.text"),
                "tags": tags,
                "raw_apply_url": or_else(c("applyUrl"), F.lit("")),
                "apply_type": url.apply_type(c("applyUrl"), SITE),
            }
        )
        none = ~c("parsed.has_salary")
        missing = [
            _flag(c("external_id") == "", "external_id"), _flag(c("location").isNull(), "location"), _flag(work == "", "is_remote"), _flag(or_null(c("jobType")).isNull(), "employment_type"),
            _flag(c("seniority").isNull(), "seniority"), _flag(none, "salary_min"), _flag(none, "salary_max"), _flag(none, "salary_period"), _flag(none & c("salary_raw").isNull(), "salary_raw"),
            _flag(c("description_original").isNull(), "description_original"), _flag(F.size("tags") == 0, "tags"), _flag(c("raw_apply_url") == "", "raw_apply_url"), _flag(c("posted_at").isNull(), "posted_at"),
        ]
        return rows.select(
            F.lit(NAME).alias("source"), "url", "external_id", "title", "company", "location", "is_remote", "employment_type", "seniority", "parsed.salary_min", "parsed.salary_max", F.lit("INR").alias("salary_currency"),
            "parsed.salary_period", "salary_raw", "parsed.has_salary", "description_original", c("description_original").isNotNull().alias("description_available"), "tags", "apply_type", "raw_apply_url", "posted_at",
            F.array_compact(F.array(*missing)).alias("source_fields_missing"), c("body.error").alias("corrupt"),
        )


register(Flat())
