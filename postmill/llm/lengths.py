"""Token counts as an exact histogram of encoded lengths (operator 8).

Documents are encoded once by a public byte-level BPE and aggregated by length. Every
question about a context limit then needs only suffix sums over the distinct lengths: how
many documents are at least, or beyond, so long, their tokens, what is left when all are cut at
the limit, and quantiles. Sums over lengths are made of ranges of RANGE lengths, so no task
sees more than that many of them.

Defined results: null and empty texts have length 0 and count as documents; repeated rows count each;
texts are encoded whole, strings of special tokens as ordinary text; an empty table gives no rows,
a total of 0 and null quantiles. A limit that no document has is answered like any other.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.session import arrow, tune

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenising pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGE = 4096


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text, path: str = TOKENIZER, pattern: str = PATTERN):
    """Tokens of a text, as a column. The vocabulary file lies at the same path on every machine."""

    def f(col: pa.Array) -> pa.Array:
        e = _encoding(path, pattern)
        return pa.array([len(e.encode_ordinary(t)) if t else 0 for t in col.to_pylist()], pa.int64())

    return arrow(f, T.LongType())(text)


def histogram(docs: DataFrame, text_col: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(length, n_docs): the exact histogram."""
    tune(docs.sparkSession)
    return docs.select(encoded_length(F.col(text_col).cast("string"), path, pattern).alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist is read twice, so give a saved one. For every length: documents and tokens of at least that length, and the tokens left of all
    documents when each is cut at that length."""
    h = hist.withColumn("range", F.floor(F.col("length") / RANGE)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for every RANGE lengths
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("d", later, "d_after"), ("t", later, "t_after"), ("t", earlier, "t_before"))])
    down = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("range").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    h = h.select("range", "length", "n_docs", F.sum("n_docs").over(down).alias("d"), F.sum("tokens").over(down).alias("t"), F.coalesce(F.sum("tokens").over(up), F.lit(0)).alias("b"))
    h = h.join(ranges, "range")
    docs_from, tokens_from = F.col("d") + F.col("d_after"), F.col("t") + F.col("t_after")
    return h.select("length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), (F.col("b") + F.col("t_before") + docs_from * F.col("length")).alias("truncated_tokens"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: documents beyond each, tokens left when cut there, and tokens lost. The suffix sums of the
    least length beyond a limit, which are the greatest ones beyond it, answer all three."""
    beyond = lambda x, c: F.coalesce(F.max(F.when(F.col("length") > x, F.col(c))), F.lit(0))
    one = suffix_sums(hist).agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("all"), *[beyond(x, c).alias(f"{c}{x}") for x in limits for c in ("docs_from", "tokens_from")])
    docs, tokens = (lambda x: F.col(f"docs_from{x}")), (lambda x: F.col(f"tokens_from{x}"))
    rows = F.array(*[F.struct(F.lit(x).cast("bigint").alias("limit"), docs(x).alias("docs_beyond"), (F.col("all") - tokens(x) + docs(x) * x).alias("tokens_kept"), (tokens(x) - docs(x) * x).alias("tokens_lost")) for x in limits])
    return one.select(F.inline(rows))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least a share of all documents does not exceed."""
    total = sums.agg(F.max("docs_from")).first()[0] or 0
    upto = F.lit(total) - F.col("docs_from") + F.col("n_docs")
    return sums.agg(*[F.min(F.when(upto >= F.ceil(F.lit(total) * x), F.col("length"))).alias(f"q{x}") for x in shares])
