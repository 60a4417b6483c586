"""Text helpers with the semantics of Unicode-aware string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.scripts import ascii_letters


def strip(c: Column) -> Column:
    """Trims all Unicode white space, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_else(c: Column, other: Column) -> Column:
    """c unless it is null or empty."""
    return F.coalesce(or_null(c), other)


def slugify(c: Column) -> Column:
    """Lower-case ASCII words joined by single dashes; letters of other scripts are spelled, see scripts."""
    x = F.regexp_replace(ascii_letters(c), r"(?<=\d),(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    parts = [slugify(F.coalesce(title, F.lit(""))), slugify(F.coalesce(company, F.lit(""))), slugify(or_else(location, F.lit("unknown")))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def job_id(source: Column, external_id: Column) -> Column:
    return F.sha2(F.concat(source, F.lit(":"), F.coalesce(external_id, F.lit(""))), 256)


def comma_list(c: Column) -> Column:
    """Parts of a comma list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def ilike_any(c: Column, value: str) -> Column:
    """c ILIKE %value%; wildcards in value stay wildcards, and a backslash before anything else is dropped."""
    out, i = [], 0
    while i < len(value):
        if value[i] == "\\" and i + 1 < len(value):
            out.append(value[i : i + 2] if value[i + 1] in "%_\\" else value[i + 1])
            i += 2
        else:
            out.append(value[i])
            i += 1
    pattern = "".join(out)
    return c.ilike(f"%{pattern}%")
