"""Mixing sources to target weights by temperature (operator 3).

A source's share of all tokens is raised to an exponent and normalised. The exponent is found by
bisection: the largest one (closest to the natural shares) whose mixture reaches a target
entropy and asks no source for more than a limit of repetitions. The weights are realised as
budgeted block permutations: the budget is dealt in blocks, each block takes every source's
share, and a source's documents come in a pseudo-random permutation, a new one for each
repetition. The last repetition ends where the source's budget does.

Beside the count of words, everything is DataFrame operations. Running totals over a source are made of buckets: sums of
hash ranges, totals of those, and running totals inside one bucket, so that a source that holds
a third of all rows is never one task's work.

Defined results: a null source is a source of its own; documents without tokens (null, empty or blank
texts) are part of no mixture; a source without tokens gets no weight; repeated rows are each
dealt, next to one another; an empty table, or one without tokens, gives an empty mixture; with one
source its weight is 1. A target entropy beyond log2 of the number of sources is met as nearly
as exponent 0, equal weights, allows, and the limit of repetitions holds in any case: a budget beyond the limit
times all tokens falls to that, and the weights are the natural shares.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm import words as W
from postmill.llm.session import arrow, saved, tune

#: Documents in a bucket of a source, about; buckets that one range of totals holds.
BUCKET_DOCS, RANGE = 4_000, 1_000
BLOCK_TOKENS = 1_000_000
SEED = 17


@dataclass(frozen=True)
class Target:
    #: Least entropy of the mixture, as a share of the greatest possible, log2 of the number of sources.
    entropy: float = 0.95
    #: Most times that a source may be repeated.
    repetitions: float = 4.0
    #: Tokens of the mixture; None: as many as the corpus has.
    budget: int | None = None


def affordable(total: int, target: Target) -> int:
    """The budget, or the most that the limit of repetitions allows of so many tokens."""
    return min(target.budget or total, math.floor(target.repetitions * total))


def weights(tokens: dict[str | None, int], target: Target) -> tuple[float, dict[str | None, float]]:
    """The exponent and the normalised weights. Shares are scaled by the greatest, so no power overflows."""
    positive = {s: n for s, n in tokens.items() if n}
    if not positive:
        return 1.0, {}
    total, top = sum(positive.values()), max(positive.values())
    budget = affordable(total, target)
    aim = target.entropy * math.log2(len(positive))

    def at(x: float) -> dict[str | None, float]:
        raw = {s: (n / top) ** x for s, n in positive.items()}
        z = sum(raw.values())
        return {s: r / z for s, r in raw.items()}

    def entropy(w: dict[str | None, float]) -> float:
        return -sum(p * math.log2(p) for p in w.values() if p > 0)

    def repeats(w: dict[str | None, float]) -> float:
        return max(w[s] * budget / n for s, n in positive.items())

    # Entropy falls and repetition of the smallest source falls as the exponent grows from 0 to 1.
    low, high = 0.0, 1.0
    for _ in range(60):  # the largest exponent that reaches the entropy
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(at(mid)) >= aim else (low, mid)
    exponent = 1.0 if entropy(at(1.0)) >= aim else low
    if repeats(at(exponent)) > target.repetitions:  # the smallest one beyond it that keeps the limit
        low, high = exponent, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if repeats(at(mid)) <= target.repetitions else (mid, high)
        exponent = high
    return exponent, at(exponent)


def _counted(text: pa.Array) -> pa.Array:
    data, offsets = W.utf8(text)
    inside = W.NOT_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] = inside[starts]
    return pa.array(W.per_doc(first, offsets))


def n_tokens(text):
    """Words of a text, runs of anything but ASCII white space, counted in its bytes."""
    return arrow(_counted, T.LongType())(text)


def _running(rows: DataFrame, keys: list[str], of: str) -> DataFrame:
    """rows (one for each bucket) with ``before``: the sum of ``of`` over the earlier buckets of the same keys."""
    rows = rows.withColumn("range", F.col("bucket").cast("bigint") - F.pmod(F.col("bucket"), F.lit(RANGE)))
    ranges = rows.groupBy(*keys, "range").agg(F.sum(of).alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("base", F.coalesce(earlier, F.lit(0))).drop("sum")
    inside = F.sum(of).over(Window.partitionBy(*keys, "range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(ranges, [*keys, "range"]).select(*keys, "bucket", (F.col("base") + F.col("inside")).alias("before"))


def mix(docs: DataFrame, target: Target | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture: one row for each use of a document, with its source, tokens, repetition (epoch), block
    and place, a number that orders the rows of a block."""
    spark = tune(docs.sparkSession)
    target = target or Target()
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"), n_tokens(F.col(text_col).cast("string")).alias("n_tokens"))
    own = saved(own.where("n_tokens > 0"), "tokens")
    totals = own.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()  # a row for each source
    _, share = weights({r.source: r.n for r in totals}, target)
    budget = affordable(sum(r.n for r in totals), target)
    blocks = max(1, -(-budget // block_tokens))
    plan = [(r.source, int(round(share[r.source] * budget)), r.n, max(1, -(-r.docs // BUCKET_DOCS))) for r in totals]
    plan = spark.createDataFrame(plan, "source string, quota bigint, supply bigint, buckets bigint")
    plan = plan.withColumn("epochs", F.ceil(F.col("quota") / F.col("supply")))
    uses = own.join(F.broadcast(plan), "source")  # a row for each source
    uses = uses.withColumn("epoch", F.explode(F.expr("if(epochs > 0, sequence(0, int(epochs) - 1), array())")))
    uses = uses.withColumn("order", F.xxhash64("doc_id", "epoch", F.lit(SEED)))
    uses = uses.withColumn("bucket", F.floor((F.shiftright("order", 32) + F.lit(2**31)) * F.col("buckets") / F.lit(2.0**32)))
    sums = uses.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = _running(sums, ["source", "epoch"], "sum")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    uses = uses.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, ["source", "epoch", "bucket"])
    uses = uses.withColumn("at", F.col("epoch") * F.col("supply") + F.col("before") + F.col("inside")).where("at < quota")
    # A block takes an equal part of every source's quota; a use belongs to the block where it begins.
    uses = uses.withColumn("block", F.floor(F.col("at").cast("double") * blocks / F.col("quota")).cast("bigint"))
    place = F.xxhash64("doc_id", "epoch", "block", F.lit(SEED + 1))
    source = F.when(F.col("source") != "", F.substr("source", F.lit(2)))
    return uses.select("doc_id", source.alias("source"), "n_tokens", F.col("epoch").cast("bigint").alias("epoch"), "block", place.alias("place"))
