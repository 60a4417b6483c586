"""The canonical job record and its public projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B, _I, _TS, _A = T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampType(), T.ArrayType(T.StringType())

#: (column, type, nullable, default)
_COLUMNS = [
    ("id", _S, False, None),
    ("source", _S, False, None),
    ("external_id", _S, False, ""),
    ("title", _S, False, None),
    ("company", _S, False, None),
    ("location", _S, True, None),
    ("is_remote", _B, False, False),
    ("employment_type", _S, True, None),
    ("seniority", _S, True, None),
    ("salary_min", _I, True, None),
    ("salary_max", _I, True, None),
    ("salary_currency", _S, False, "INR"),
    ("salary_period", _S, True, None),
    ("salary_raw", _S, True, None),
    ("has_salary", _B, False, False),
    ("description_original", _S, True, None),
    ("description_available", _B, False, False),
    ("rewritten_description", _S, True, None),
    ("tags", _A, False, []),
    ("apply_type", _S, False, "UNKNOWN"),
    ("raw_apply_url", _S, False, None),
    ("apply_url", _S, True, None),
    ("resolved_domain", _S, True, None),
    ("is_external", _B, False, False),
    ("posted_at", _TS, True, None),
    ("scraped_at", _TS, False, None),
    ("is_active", _B, False, True),
    ("fingerprint", _S, False, None),
    ("source_fields_missing", _A, False, []),
    ("merged_sources", _A, False, []),
]

JOBS = T.StructType([T.StructField(n, t, True) for n, t, _, _ in _COLUMNS])
#: A record in flight has every column but the sources merged into it.
RECORD = T.StructType([f for f in JOBS if f.name != "merged_sources"])
#: A record as its source gave it: with its page, and the reason why it is skipped.
PARSED = T.StructType([*RECORD, T.StructField("url", _S), T.StructField("corrupt", _S)])
PAGES = T.StructType([T.StructField("url", _S), T.StructField("html", _S)])
APPLY_TYPES = ("EXTERNAL", "DIRECT", "UNKNOWN")

PUBLIC = [
    "id", "source", "title", "company", "location", "is_remote", "employment_type", "seniority", "salary_min", "salary_max", "salary_currency",
    "salary_period", "salary_raw", "has_salary", "description", "is_rewritten", "tags", "apply_type", "apply_url", "posted_at", "scraped_at", "is_active",
]


def conform(df: DataFrame, schema: T.StructType = JOBS) -> DataFrame:
    """df with exactly the schema's columns: defaults where a column or value is missing, others dropped."""
    defaults = {n: d for n, _, _, d in _COLUMNS}
    have, out = set(df.columns), []
    for f in schema:
        d = defaults.get(f.name)
        lit = F.lit(None) if d is None else F.array().cast(f.dataType) if d == [] else F.lit(d)
        c = F.col(f.name).cast(f.dataType) if f.name in have else lit.cast(f.dataType)
        out.append((F.coalesce(c, lit.cast(f.dataType)) if d is not None else c).alias(f.name))
    return df.select(*out)


def valid() -> F.Column:
    """The record's own rules: the three texts that may not be empty."""
    return (F.coalesce(F.length("title"), F.lit(0)) > 0) & (F.coalesce(F.length("company"), F.lit(0)) > 0) & (F.coalesce(F.length("raw_apply_url"), F.lit(0)) > 0)
