"""Substring search by postings of trigrams.

Every three letters in a row of a text, in lower case, make a posting (column, gram, id). A pattern's own trigrams must all be in a text that
matches it, so postings are intersected, by counting, and only rows of the ids left are read and compared. Postings are dealt and sorted by gram, so a search reads the row
groups that its grams are in. A pattern without three letters in a row has no trigrams: there all rows are compared.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import ilike_any

SIZE = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, none for null or fewer letters."""
    lower = F.lower(text)
    at = F.sequence(F.lit(1), F.char_length(lower) - SIZE + 1)
    return F.array_distinct(F.when(F.char_length(lower) >= SIZE, F.transform(at, lambda k: F.substring(lower, k, F.lit(SIZE)))).otherwise(F.array().cast("array<string>")))


def pattern_grams(value: str) -> list[str]:
    """The trigrams of an ILIKE pattern's fixed parts: what a wildcard stands for is not known, and an escaped one is a letter."""
    parts = re.sub(r"\\(.)|[%_]", lambda m: m.group(1) or "\0", value, flags=re.S).split("\0")
    return sorted({p[k : k + SIZE] for p in (x.lower() for x in parts) for k in range(len(p) - SIZE + 1)})


def postings(rows: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(column, gram, id), to be written as it is dealt: sorted, so that files and row groups hold ranges of grams."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), grams(F.col(c)).alias("grams")) for c in columns])
    flat = rows.select(F.col(id_col).alias("id"), F.inline(each)).select("column", F.explode("grams").alias("gram"), "id")
    return flat.repartitionByRange("gram", "column", "id").sortWithinPartitions("gram", "column", "id")


def search(rows: DataFrame, index: DataFrame, terms: dict[str, str], id_col: str = "id") -> DataFrame:
    """rows of which any column is ILIKE %value%, by (column: value)."""
    found = reduce(lambda a, b: a | b, [ilike_any(F.col(c), v) for c, v in terms.items()])
    of = {c: pattern_grams(v) for c, v in terms.items()}
    if not all(of.values()):
        return rows.where(found)
    asked = reduce(lambda a, b: a | b, [(F.col("column") == c) & F.col("gram").isin(g) for c, g in of.items()])
    needed = F.element_at(F.create_map(*[F.lit(x) for c, g in of.items() for x in (c, len(g))]), F.col("column"))
    every = {g for x in of.values() for g in x}
    ids = index.where(F.col("gram").isin(*every) & asked).groupBy("id", "column").agg(F.count("*").alias("n")).where(F.col("n") == needed)
    return rows.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").where(found)
