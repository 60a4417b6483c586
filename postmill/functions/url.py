"""URL parts, aggregator domains and apply-link types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains of job boards.
AGGREGATORS = (
    "linkedin.com", "indeed.com", "indeed.co.in", "naukri.com", "monster.com", "monsterindia.com", "shine.com", "timesjobs.com", "foundit.in", "instahyre.com",
    "cutshort.io", "wellfound.com", "angel.co", "internshala.com", "ziprecruiter.com", "simplyhired.com", "glassdoor.com", "glassdoor.co.in", "ambitionbox.com",
)
_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)"
_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """The lower-case host, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def path(url: Column) -> Column:
    """The path, percent-decoded where that is possible."""
    raw = F.regexp_extract(url, _PATH, 1)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def bare(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def within(domain: Column, of: str) -> Column:
    return (domain == of) | F.endswith(domain, F.lit(f".{of}"))


def is_aggregator(domain: Column, names: tuple[str, ...] = AGGREGATORS) -> Column:
    """The domain, or a parent of it, is a job board; false for null."""
    d = bare(domain)
    return F.coalesce(F.exists(F.array(*map(F.lit, names)), lambda x: (d == x) | F.endswith(d, F.concat(F.lit("."), x))), F.lit(False))


def apply_type(url: Column, own: str) -> Column:
    """EXTERNAL, DIRECT (the source's own site) or UNKNOWN (no host, or a job board)."""
    d = bare(host(url))
    return F.when(d.isNull() | (d == ""), "UNKNOWN").when(within(d, own), "DIRECT").when(is_aggregator(d), "UNKNOWN").otherwise("EXTERNAL")


def url_key(apply_url: Column, domain: Column) -> Column:
    """domain + path without its last slashes; null where either is missing or blank."""
    usable = (F.coalesce(F.length(apply_url), F.lit(0)) > 0) & (F.coalesce(F.length(domain), F.lit(0)) > 0)
    return F.when(usable, F.concat(domain, F.regexp_replace(path(apply_url), "/+$", "")))


def slug(url: Column) -> Column:
    """The last segment of the path."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
