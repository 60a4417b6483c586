"""Learned decision lists for document quality (operator 5).

One Arrow pass turns each whole text into counts. All labelled rows teach an ordered list of
threshold conjunctions by sequential covering: each rule is grown on two thirds of the rows
that are left, condition by condition, by the gain of information, and pruned on the other
third. Rows stay in a table: for a condition tasks count the bad and good rows of each value,
and the driver sees those counts alone. Values whose first eleven significant bits agree (they
differ by less than a thousandth) are counted together, so no threshold falls between them. The list becomes ordered
Spark conditional expressions, so the verdict on every document is a plain column.

Defined results: a null or empty text has no words, all counts 0, and fails the base rule;
labels that are null or missing teach nothing; without usable labels the list is empty and
only the base rule decides; repeated rows are judged each on their own and alike; columns
other than the text are never read by the judgement. A text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm import words as W
from postmill.llm.session import arrow, discard, saved, tune

#: Bits of a double below those that tell values apart, and bits of what is left.
DROPPED, LEFT = 42, 21
#: Values of a task before they are counted.
PENDING = 1 << 18
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?;:\"'()[]{}=_~^\\/+@`")] = True


def _doubled(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def count(col: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of the batch."""
    data, offsets = W.utf8(col)
    w = W.split(col, W.NOT_SPACE, lower=False)
    lines = W.split(col, W.NOT_NEWLINE, lower=False)
    spaceless = np.zeros(len(data) + 1, dtype=np.int64)
    in_word = W.NOT_SPACE[data]
    np.cumsum(in_word, out=spaceless[1:])
    full = spaceless[lines.ends] > spaceless[lines.starts]
    salt = W.fmix(np.arange(1, len(offsets) + 1, dtype=W.U64))
    line_key, line_doc = (lines.hashes ^ salt[lines.doc])[full], lines.doc[full]
    n_lines = np.bincount(line_doc, minlength=len(col))
    first = np.unique(line_key, return_index=True)[1]
    tri, start = W.windows(w, 3)
    again = start[_doubled(tri ^ salt[w.doc[start]])]
    covered = np.zeros(len(w.hashes), dtype=bool)
    for k in range(3):
        covered[again + k] = True
    by_byte = {
        "word_chars": in_word & ((data & 0xC0) != 0x80),
        "n_symbols": _SYMBOL[data],
        "n_upper": _UPPER[data],
        "n_digits": _DIGIT[data],
        "n_marks": _MARK[data],
    }
    return {
        "n_words": w.counts,
        "n_dup_lines": n_lines - np.bincount(line_doc[first], minlength=len(col)),
        "n_repeat_words": W.per_doc(covered, w.at),
        "n_lines": n_lines,
    } | {k: W.per_doc(v, offsets) for k, v in by_byte.items()}


def _stats(text: pa.Array) -> pa.Array:
    counts = count(text)
    return pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], names=list(COUNTS))


def stats(text: Column) -> Column:
    """The counts of a text as a struct."""
    return arrow(_stats, STATS)(text)


def features(s: Column) -> dict[str, Column]:
    """What rules may test, as ratios of the counts in the struct s."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    return {
        "words": s["n_words"].cast("double"),
        "symbol_ratio": s["n_symbols"] / words,
        "dup_line_ratio": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeat_ratio": s["n_repeat_words"] / words,
        "upper_ratio": s["n_upper"] / chars,
        "digit_ratio": s["n_digits"] / chars,
        "mark_ratio": s["n_marks"] / words,
        "words_per_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
    }


FEATURES = ("words", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "words_per_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.threshold if self.above else f[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def fits(rule: Rule, f: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.column(f) for c in rule), F.lit(True))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys once each, with their bad and good rows and their least and greatest value."""
    key, bad, good, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return key, bad, good, lo, hi
    return (key[first], *(f.reduceat(v[order], first) for f, v in ((np.add, bad), (np.add, good), (np.minimum, lo), (np.maximum, hi))))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bad and good rows of a task (column 0: bad, then a column for each feature) by feature and value."""
    parts, pending = [tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, float, float))], 0
    for batch in batches:
        bad = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(len(FEATURES)):
            v = batch.column(k + 1).to_numpy() + 0.0  # none is negative, so their bits are in their order
            parts.append((k << LEFT | v.view(np.int64) >> DROPPED, bad, 1 - bad, v, v))
        pending += len(bad) * len(FEATURES)
        if pending > PENDING:
            parts, pending = [_summed(parts)], 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(parts)], names=["key", "bad", "good", "lo", "hi"])


def _by_value(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """key, bad, good, lo, hi of all rows, in the order of features and values: at most some thousands for each feature."""
    each = rows.select("bad", *FEATURES).mapInArrow(_values, "key bigint, bad bigint, good bigint, lo double, hi double")
    got = each.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    order = np.argsort(got.column("key").to_numpy())
    return tuple(got.column(c).to_numpy()[order] for c in ("key", "bad", "good", "lo", "hi"))


def _best(counted: tuple[np.ndarray, ...], spread: list[float]) -> tuple[Condition | None, int]:
    """The condition of the largest gain, at a tie the one in the widest gap between values; and the good rows that it holds."""
    best, most, left = None, (1e-9, 0.0), 0
    for k, name in enumerate(FEATURES):
        bad, good, lo, hi = (x[counted[0] >> LEFT == k] for x in counted[1:])
        p0, n0 = int(bad.sum()), int(good.sum())
        if not p0 or not n0:
            return None, n0
        mid, gap = (hi[:-1] + lo[1:]) / 2, (lo[1:] - hi[:-1]) / spread[k]
        mid = np.where(mid < lo[1:], mid, hi[:-1])
        below, good_below = np.cumsum(bad)[:-1], np.cumsum(good)[:-1]
        for above, p, n in ((True, p0 - below, n0 - good_below), (False, below, good_below)):
            share = np.maximum(p, 1) / np.maximum(p + n, 1)
            gain = np.round(np.where(p > 0, p * (np.log2(share) - np.log2(p0 / (p0 + n0))), 0.0), 6)
            if len(gain):
                i = int(np.lexsort((-np.arange(len(gain)), gap, gain))[-1])
                if (found := (float(gain[i]), float(gap[i]))) > most:
                    best, most, left = Condition(name, above, float(mid[i])), found, int(n[i])
    return best, left


def _grow(rows: DataFrame, spread: list[float], longest: int) -> Rule:
    """Adds the best condition until no good row is covered."""
    f, rule, good = {k: F.col(k) for k in FEATURES}, (), 1
    while len(rule) < longest and good:
        best, good = _best(_by_value(rows.where(fits(rule, f))), spread)
        if best is None:
            break
        rule = (*rule, best)
    return rule


def _worth(p: int, n: int) -> float:
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: DataFrame, longest: int = 4, rules: int = 24, precision: float = 0.95) -> list[Rule]:
    """Ordered rules that name bad rows, from a table of bad, pruning (both booleans) and the features. A rule is kept
    while, on all rows it is left with, its share of bad ones is at least precision; the first that falls short ends the list."""
    out: list[Rule] = []
    f, bad, pruning = {k: F.col(k) for k in FEATURES}, F.col("bad"), F.col("pruning")
    whole = rows.agg(F.count_if(bad).alias("bad"), *[F.stddev_pop(k).alias(k) for k in FEATURES]).first()
    left, n_bad = rows, whole["bad"]
    spread = [whole[k] or 1.0 for k in FEATURES]
    while len(out) < rules and n_bad >= 5:
        rule = _grow(left.where(~pruning), spread, longest)
        if not rule:
            break
        hits = [fits(rule[: k + 1], f) for k in range(len(rule))]
        got = left.agg(*[F.count_if(h & which) for h in hits for which in (bad & pruning, ~bad & pruning, bad, ~bad)]).first()
        n = [got[4 * k : 4 * k + 4] for k in range(len(rule))]
        while len(rule) > 1 and _worth(*n[len(rule) - 2][:2]) >= _worth(*n[len(rule) - 1][:2]):
            rule = rule[:-1]
        p, wrong = n[len(rule) - 1][2:]
        if p < 5 or p < precision * (p + wrong):
            break
        out.append(rule)
        left, n_bad = left.where(~hits[len(rule) - 1]), n_bad - p
    return out


def verdict(rules: list[Rule], s: Column) -> Column:
    """Ordered conditional expression: false at the first rule that fits, else true."""
    f, out = features(s), None
    for rule in rules:
        test = fits(rule, f)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Learns the list from all labelled documents; label 0 is bad."""
    tune(docs.sparkSession)
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), stats(F.col(text_col).cast("string")).alias("s")).join(picked, "id")  # counts are joined, not texts
    rows = rows.select((F.col("y") == 0).alias("bad"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 2).alias("pruning"), *[v.cast("double").alias(k) for k, v in features(F.col("s")).items()])
    rows = saved(rows, "quality-rows")
    rules = learn(rows)
    discard(rows)
    return rules


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the base counts, base_failed and kept."""
    tune(docs.sparkSession)
    s = F.col("s")
    judged = docs.select(F.col(id_col).alias("doc_id"), stats(F.col(text_col).cast("string")).alias("s"))
    return judged.select("doc_id", *[s[c].alias(c) for c in COUNTS[:5]], base_failed(s).alias("base_failed"), (~base_failed(s) & verdict(rules, s)).alias("kept"))


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    tune(docs.sparkSession)
    s = "__quality_stats"
    return docs.withColumn(s, stats(F.col(text_col).cast("string"))).where(~base_failed(F.col(s)) & verdict(rules, F.col(s))).drop(s)
