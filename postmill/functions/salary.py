"""Salary texts: amounts, period, and whether there is anything to use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip

# Phrases that mean no salary, the number pattern, range separators and unit patterns.
NO_SALARY = ("not disclosed", "not disclosed by recruiter", "negotiable", "n/a", "na", "as per industry standards", "as per company standards", "confidential", "unpaid", "-")
NUMBER = r"(\d[\d,]*(?:\.\d+)?)"
TO = r"\s*(?:-|to|–|—)\s*"
LAKHS = r"\s*(?:lpa|lakhs?(?:\s*per\s*annum)?|l\.?p\.?a\.?)"
ANNUAL = r"\s*(?:per\s*annum|/\s*annum|p\.?a\.?|annually)"
MONTHLY = r"\s*(?:/\s*month|per\s*month|/\s*mo\b|monthly)"
HOURLY = r"\s*(?:/\s*hour|per\s*hour|/\s*hr\b|hourly)"
FLAGS = "(?iU)"

#: (period, factor, unit, how k counts: never, on either side of a range, or after the number)
_SHAPES = [("annual", 100_000, LAKHS, ""), ("annual", 1, ANNUAL, ""), ("monthly", 1, MONTHLY, "k"), ("hourly", 1, HOURLY, "")]
TYPE = "struct<salary_min:int,salary_max:int,salary_period:string,has_salary:boolean>"


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _whole(c: Column) -> Column:
    """Rounds half to even."""
    return F.bround(c).try_cast("bigint").try_cast("int")


def _thousand(span: Column, number: Column) -> Column:
    """1000 where the number text is followed by k anywhere in the matched span."""
    return F.when(F.regexp_like(span, F.concat(F.lit(FLAGS + r"\Q"), number, F.lit(r"\E\s*k\b"))), 1000.0).otherwise(1.0)


def _found(low: Column, high: Column, period: str) -> Column:
    return F.struct(_whole(low).alias("salary_min"), _whole(high).alias("salary_max"), F.lit(period).alias("salary_period"), F.lit(True).alias("has_salary"))


def parse_salary(raw: Column) -> Column:
    """A struct of TYPE. The first shape found in the text wins, a range before a single amount; currencies
    are not looked at. Amounts beyond an int are null."""
    text = strip(F.coalesce(raw, F.lit("")))
    said = strip(F.regexp_replace(strip(F.lower(text)), r"(?U)^(₹|rs\.?|inr)\s*", ""))
    out = F.when((text == "") | said.isin(*NO_SALARY), F.lit(None))
    for period, factor, unit, k in _SHAPES:
        if k:
            pair = rf"{FLAGS}{NUMBER}\s*k?{TO}{NUMBER}\s*k?{unit}"
            single = rf"{FLAGS}{NUMBER}\s*(k)?{unit}"
        else:
            pair, single = rf"{FLAGS}{NUMBER}{TO}{NUMBER}{unit}", rf"{FLAGS}{NUMBER}{unit}"
        get = lambda p, i: F.regexp_extract(text, p, i)
        low, high, one = _number(get(pair, 1)), _number(get(pair, 2)), _number(get(single, 1))
        if k:
            low, high = low * _thousand(get(pair, 0), get(pair, 1)), high * _thousand(get(pair, 0), get(pair, 2))
            one = one * F.when(get(single, 2) != "", 1000.0).otherwise(1.0)
        out = out.when(text.rlike(pair), _found(low * factor, high * factor, period)).when(text.rlike(single), _found(one * factor, one * factor, period))
    none = F.struct(F.lit(None).cast("int").alias("salary_min"), F.lit(None).cast("int").alias("salary_max"), F.lit(None).cast("string").alias("salary_period"), F.lit(False).alias("has_salary"))
    return F.coalesce(out, none).cast(TYPE)
