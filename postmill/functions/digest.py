"""The digest post: as many job lines as fit the character budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip

# Budget, what a link is billed at, longest title, and the post's wording.
LIMIT, LINK, TITLE = 280, 23, 42
ONE = "\U0001f680 1 new tech job in India today"
MANY = "\U0001f680 {} new tech jobs in India today"
CALL = "Apply \U0001f449 {}"


def truncate(text: Column, limit: int = TITLE) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.left(t, F.lit(limit - 1)), r"(?U)\s+$", "")
    short = F.when(F.contains(cut, F.lit(" ")), F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)).otherwise(cut)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(short, F.lit("…")))


def job_line(title: Column, company: Column) -> Column:
    c = strip(F.coalesce(company, F.lit("")))
    return F.concat(F.lit("• "), truncate(title), F.when(c != "", F.concat(F.lit(" — "), c)).otherwise(""))


def billed_length(text: Column, url: str) -> Column:
    n = F.length(text)
    return F.when(F.contains(text, F.lit(url)), n - len(url) + LINK).otherwise(n) if url else n


def render(lines: Column, total: Column, url: str) -> Column:
    shown = F.size(lines)
    head = F.when(total == 1, ONE).otherwise(F.replace(F.lit(MANY), F.lit("{}"), total.cast("string")))
    more = F.when(total > shown, F.array(F.concat(F.lit("+"), (total - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head, F.lit("")), lines, more, F.array(F.lit(""), F.lit(CALL.format(url)))), "\n")


def build(lines: Column, total: Column, url: str) -> Column:
    """The longest rendering that fits, dropping last lines first; without any line if none fits; null without jobs."""
    candidates = F.transform(F.sequence(F.size(lines), F.lit(0), F.lit(-1)), lambda n: render(F.slice(lines, F.lit(1), n), total, url))
    fitting = F.filter(candidates, lambda t: billed_length(t, url) <= LIMIT)
    return F.when(total > 0, F.coalesce(F.try_element_at(fitting, F.lit(1)), F.element_at(candidates, -1)))
