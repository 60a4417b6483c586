"""Toxicity by noisy-channel deobfuscation (operator 6).

A token that may be disguised becomes a character lattice: look-alike digits and signs may
stand for letters, runs of a letter may be shorter, separators inside may vanish, and runs of
single letters are one token. Viterbi decoding under a character trigram model, learned from
all labelled documents, restores the likeliest word. Restored words and their beginnings
are looked up in a lexicon, learned from all labels: a feature counts where the lower bound of
its share of toxic documents is high. Two documents in three say which features enter it and with which share, the third
what such evidence is worth. The counts are of every document: those of features that can still reach the bound are taken, and what
falls short of it by all its toxic documents and a quarter of the clean ones can't, since more clean ones only lower it. Documents with
the same two longest tokens, as copies of one another have, count once, so words that merely accompany toxic ones there aren't learned.
A stem that several different words of a text share is a feature of its own.

Defined results: a null or empty text holds no feature and gets the lowest score; labels that
are null or missing teach nothing; without labels every score is 0; repeated rows are
scored each on their own and alike. Texts and tokens are read whole, and no state of a lattice is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.session import arrow, discard, release, saved, tune

#: Beginnings of words that are features, in letters.
STEMS = (4, 5, 6, 7)
#: Different words with the same stem that make a feature.
SHARED = (2, 3)
#: Toxic documents that a feature needs, and the least lower bound (of LIMIT_Z deviations) of its share of toxic ones.
LEAST_DOCS, LEAST_SHARE, LIMIT_Z = 5, 0.35, 3.0
#: Tokens remembered by a worker.
REMEMBERED = 200_000
THRESHOLD = 0.3

# Letters that digits and signs may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
RUN = re.compile(r"(.)\1*", re.S)
# Letters with separators between, from and to anything that isn't a letter, or an apostrophe within a word.
SINGLES = re.compile(r"(?<![^\W_])(?<![^\W_]['’])(?:[\w@$!|+][\s.\-_*]+){2,}[\w@$!|+](?!['’]?[^\W_])")
# Two single letters in a row, as any of those have: quicker to look for.
NEAR = re.compile(r"[\s.\-_*][\w@$!|+][\s.\-_*]+[\w@$!|+](?![^\W_])")
DOUBLE = re.compile(r"(.)\1+")
TRIPLE = re.compile(r"(.)\1\1")
EDGES = re.compile(r"^(?:[^\w@$!|+€£¡]|([@$!|+€£¡])\1+)+|(?:[^\w@$]|([@$])\2+)+$")


@dataclass
class CharModel:
    """Character trigrams with interpolation by the number of different followers."""

    cost: dict[str, dict[str, float]] = field(default_factory=dict)
    unseen: float = 12.0

    @staticmethod
    def learn(seen: dict[str, dict[str, int]]) -> CharModel:
        """seen: how often each letter follows each context of up to two letters."""
        alphabet = len(seen.get("", ())) + 1
        prob: dict[str, dict[str, float]] = {}
        for context in sorted(seen, key=len):
            c, total, kinds = seen[context], sum(seen[context].values()), len(seen[context])
            shorter = prob.get(context[1:], {}) if context else {}
            prob[context] = {x: (n + kinds * (shorter.get(x, 1e-5) if context else 1 / alphabet)) / (total + kinds) for x, n in c.items()}
        return CharModel({k: {x: -math.log(p) for x, p in v.items()} for k, v in prob.items()})

    def step(self, context: str, c: str) -> float:
        got = self.cost.get(context, {}).get(c)
        if got is not None:
            return got
        got = self.cost.get(context[1:], {}).get(c)
        return got + 2.5 if got is not None else self.cost.get("", {}).get(c, self.unseen) + 5.0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of equal characters may stand for, with the channel's cost."""
    out = []
    for m in RUN.finditer(token):
        c, n = m[1], len(m[0])
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options += [(c, 0.0 if n != 2 else 2.0)] + ([(c * 2, 0.0 if n == 2 else 1.0)] if n > 1 else [])
        for x in LOOKALIKE.get(c, ""):
            options += [(x, 1.0)] + ([(x * 2, 1.5)] if n > 1 else [])
        if c.isdigit():
            options.append(("", 6.0 + n))
        elif not c.isalpha():
            options.append(("", 1.5))
        out.append(options)
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest restored word: Viterbi over the lattice, a state being the last two letters. Of equally likely
    ways into a state that of the least earlier state, then of the first option, is taken."""
    states, back = {"^^": 0.0}, []
    for options in lattice(token):
        after: dict[str, float] = {}
        came: dict[str, tuple[str, str]] = {}
        for context, cost in sorted(states.items()):
            for letters, channel in options:
                total, last = cost + channel, context
                for c in letters:
                    total += model.step(last, c)
                    last = last[1] + c
                if last not in after or total < after[last]:
                    after[last] = total
                    came[last] = (context, letters)
        states = after
        back.append(came)
    at = min((cost + model.step(context, "$"), context) for context, cost in states.items())[1]
    out = []
    for came in reversed(back):
        at, letters = came[at]
        out.append(letters)
    return "".join(reversed(out))


def restored(token: str, model: CharModel) -> list[str]:
    """The words that a lower-case token may be: itself without its edges, its parts, its decoding."""
    core = token if token.isalpha() else EDGES.sub("", token)
    if core.isalpha():
        if not TRIPLE.search(core):
            return [core]
    elif not any(c.isalpha() for c in core):
        return []
    parts = [p for p in re.split(r"[\W\d_]+", core) if len(p) > 2]
    return list(dict.fromkeys([*parts, decode(core, model)]))


def features(word: str) -> list[str]:
    """A word and its beginnings; ``=`` marks a whole word."""
    return [f"={word}", *(word[:k] for k in STEMS if len(word) >= k)]


def of_words(words: set[str]) -> set[str]:
    """Features of a text: those of its words, and ``stem#k`` where k different words share a stem."""
    out, stems = set(), Counter()
    for w in words:
        own = features(w)
        out.update(own)
        stems.update(own[1:])
    out.update(f"{s}#{k}" for s, n in stems.items() for k in SHARED if n >= k)
    return out


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens, runs of single letters joined to one more."""
    low = text.lower()
    out = set(low.split())
    if NEAR.search(low):
        out.update(re.sub(r"[\s.\-_*]+", "", m[0]) for m in SINGLES.finditer(low))
    return out


@dataclass
class Model:
    chars: CharModel
    #: Share of toxic documents among those with the feature, smoothed.
    lexicon: dict[str, float]
    #: The same among documents without any feature.
    rest: float
    #: And among those with so many words of the lexicon, of which the best has a share in this class.
    classes: dict[tuple[int, int], float] = field(default_factory=dict)
    _doubled: set[str] = field(default_factory=set)
    _stems: set[str] = field(default_factory=set)
    _starts: set[str] = field(default_factory=set)
    _plain: set[str] = field(default_factory=set)
    _words: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        self._doubled = {DOUBLE.sub(r"\1", f.lstrip("="))[:4] for f in self.lexicon}
        self._stems = {f.partition("#")[0] for f in self.lexicon}
        self._starts = {s.lstrip("=")[:4] for s in self._stems}

    def words(self, token: str) -> list[str]:
        """Restored words of a token that have a feature of the lexicon, or share a stem that may become one."""
        found = restored(token, self.chars)
        if len(found) == 1 and found[0][:4] not in self._starts and not DOUBLE.search(found[0]):
            return []  # most words, quickly
        for w in list(found):  # a double letter may be one too many
            if DOUBLE.search(w) and (s := DOUBLE.sub(r"\1", w))[:4] in self._doubled:
                found.append(s)
        return [w for w in found if w[:4] in self._starts and any(f in self._stems for f in features(w))]

    def told(self, own: set[str]) -> dict[str, list[str]]:
        """The tokens that have such words, with them."""
        out = {}
        for t in own - self._plain:
            ws = self._words.get(t)
            if ws is None:
                ws = self.words(t)
                if ws:
                    if len(self._words) < REMEMBERED:
                        self._words[t] = ws
                else:
                    if len(self._plain) >= REMEMBERED:
                        self._plain.clear()
                    if len(t) < 40:
                        self._plain.add(t)
            if ws:
                out[t] = ws
        return out

    def evidence(self, own: set[str]) -> tuple[int, float]:
        """How many different words of these tokens are in the lexicon, and the best share of their features."""
        found = {w for ws in self.told(own).values() for w in ws}
        return len(found), max((self.lexicon.get(f, 0.0) for f in of_words(found)), default=0.0)

    def score(self, text: str | None) -> float:
        n, best = self.evidence(tokens(text)) if text else (0, 0.0)
        return self.classes.get(kind(n, best), best) if best else self.rest


def kind(n: int, best: float) -> tuple[int, int]:
    """The class of such evidence."""
    return min(n, 3), sum(best >= x for x in (0.6, 0.75, 0.85, 0.92, 0.97))


def lower_bound(good: int, bad: int, z: float = LIMIT_Z) -> float:
    """Of the share bad / (good + bad): Wilson's."""
    n = good + bad
    p = bad / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


TOKENS = T.StructType([T.StructField("w", T.ArrayType(T.StringType())), T.StructField("c", T.StringType())])


def _token_lists(text: pa.Array) -> pa.Array:
    """Tokens of each text, and its two longest ones."""
    own = [sorted(tokens(t)) if t else [] for t in text.to_pylist()]
    longest = [" ".join(nsmallest(2, ws, key=lambda t: (-len(t), t))) for ws in own]
    return pa.StructArray.from_arrays([pa.array(own, pa.list_(pa.string())), pa.array(longest, pa.string())], names=["w", "c"])


# A trigram as a number: 21 bits a character, the last one lowest.
BITS, LOW = 21, (1 << 21) - 1
#: Trigrams of a task before they are counted.
PENDING = 1 << 20


def _trigrams(words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of the words between their marks, and how often each word counts."""
    text = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 3
    at = np.ones(len(text), dtype=bool)
    start = np.cumsum(length) - length
    at[start] = at[start + 1] = False
    at = np.flatnonzero(at)
    return text[at - 2] << 2 * BITS | text[at - 1] << BITS | text[at], np.repeat(times, length - 2)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each trigram is in the words of a task's token lists (column 0)."""
    keys, times, pending = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    for batch in batches:
        counted = pc.value_counts(batch.column(0).flatten())
        pairs = [(w, n) for t, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True) if (w := t if t.isalpha() else EDGES.sub("", t)).isalpha()]
        if pairs:
            k, n = _trigrams([w for w, _ in pairs], np.array([n for _, n in pairs], dtype=np.int64))
            keys, times, pending = [*keys, k], [*times, n], pending + len(k)
        if pending > PENDING:
            k, n = _summed(keys, times)
            keys, times, pending = [k], [n], 0
    k, n = _summed(keys, times)
    yield pa.record_batch({"k": pa.array(k), "n": pa.array(n)})


def _char_model(tokens: DataFrame) -> CharModel:
    """Of all words in the lists of a table's one column; a row of the driver for each trigram of letters."""
    seen: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for r in tokens.mapInArrow(_followers, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect():
        a, b, c = chr(r.k >> 2 * BITS), chr(r.k >> BITS & LOW), chr(r.k & LOW)
        for context in (a + b, b, ""):
            seen[context][c] += r.n
    return CharModel.learn(seen)


class _Once:
    """What make() gives, one a task, so that it remembers tokens from batch to batch and goes with the task."""

    def __init__(self, make: Callable):
        self.make, self.made = make, None

    def __call__(self):
        if self.made is None:
            self.made = self.make()
        return self.made


def _short_of(good, bad, slack: float = 1e-9):
    """A column: whether the bound of LEAST_SHARE is missed, whatever clean documents are still to be counted."""
    n, z = good + bad, LIMIT_Z
    p = bad / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) < LEAST_SHARE - slack


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """i, t (text) and y of all labelled documents. Both are dealt by id at any size: labels pass through no driver,
    and what is between tasks grows with the texts alone."""
    picked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(picked.hint("merge"), "i")


def _able(learning: DataFrame, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features (f) that may enter the lexicon, of a table of y, c and what each() makes features of: all but those that
    miss the bound by all toxic documents and a quarter of the clean ones. It holds every feature that reaches it by all."""
    bad = each(learning.where("y")).groupBy("f").agg(F.countDistinct("c").alias("bad")).where(F.col("bad") >= LEAST_DOCS)
    few = each(learning.where("not y").where(F.pmod("c", F.lit(4)) == 0).dropDuplicates(["c"])).groupBy("f").agg(F.count("*").alias("good"))
    return bad.join(few, "f", "left").where(~_short_of(F.coalesce("good", F.lit(0)), F.col("bad"))).select("f")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from all labelled documents; label 1 is toxic."""
    spark = tune(docs.sparkSession)
    sc = spark.sparkContext
    rows = _labelled(docs, labels, id_col, text_col, label_col)
    rows = rows.select((F.col("y") == 1).alias("y"), (F.pmod(F.xxhash64("i", F.lit(7)), F.lit(3)) != 0).alias("learning"), arrow(_token_lists, TOKENS)("t").alias("x"))
    rows = saved(rows.select("y", "learning", "x.w", F.xxhash64("x.c").alias("c")), "toxicity-tokens")
    release(spark)  # the texts between tasks
    chars = _char_model(rows.select("w"))
    sent = sc.broadcast(chars)
    known = _Once(dict)

    def words_of(token: str) -> list[str]:
        memo = known()
        got = memo.get(token)
        if got is None:
            got = restored(token, sent.value)
            if len(memo) < REMEMBERED and len(token) < 40:
                memo[token] = got
        return got

    def every(ws: pa.Array) -> pa.Array:
        own = ({w for t in x or [] for w in words_of(t)} for x in ws.to_pylist())
        return pa.array([list(of_words(w)) for w in own], pa.list_(pa.string()))

    exploded = F.explode(arrow(every, T.ArrayType(T.StringType()))("w")).alias("f")
    able = {r.f: 1.0 for r in _able(rows.where("learning"), lambda some: some.select("c", exploded)).collect()}  # the lexicon, and what may enter it
    release(spark)
    may = sc.broadcast((chars, able))
    able_here = _Once(lambda: Model(*may.value, 0.0))

    def named(ws: pa.Array) -> pa.Array:
        m, out = able_here(), []
        for x in ws.to_pylist():
            own = m.told(set(x or []))
            out.append((list(own), [f for f in of_words({w for t in own for w in restored(t, m.chars)}) if f in m.lexicon]))
        return pa.StructArray.from_arrays([pa.array([w for w, _ in out], pa.list_(pa.string())), pa.array([f for _, f in out], pa.list_(pa.string()))], names=["w", "f"])

    lists = T.StructType([T.StructField("w", T.ArrayType(T.StringType())), T.StructField("f", T.ArrayType(T.StringType()))])
    near = saved(rows.select("y", "learning", "c", arrow(named, lists)("w").alias("x")).select("y", "learning", "c", "x.w", "x.f"), "toxicity-features")
    counted = near.where("learning")
    counts = counted.select("y", "c", F.explode("f").alias("f")).groupBy("f").agg(F.countDistinct(F.when(F.col("y"), F.col("c"))).alias("bad"), F.countDistinct(F.when(~F.col("y"), F.col("c"))).alias("good")).collect()
    lexicon = {r.f: (r.bad + 1) / (r.bad + r.good + 2) for r in sorted(counts) if r.bad >= LEAST_DOCS and lower_bound(r.good, r.bad) >= LEAST_SHARE}
    told = sc.broadcast((chars, lexicon))
    told_here = _Once(lambda: Model(*told.value, 0.0))
    has = arrow(lambda fs: pa.array([any(f in told.value[1] for f in x or []) for x in fs.to_pylist()], pa.bool_()), T.BooleanType())
    missed, n = counted.select("y", has("f").alias("has")).where("not has").agg(F.count_if("y"), F.count("*")).first()
    model = Model(chars, lexicon, (missed + 0.1) / (n + 1) if n else 0.0)

    def evidence(ws: pa.Array) -> pa.Array:
        m = told_here()
        got = [m.evidence(set(x or [])) for x in ws.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([min(k, 3) for k, _ in got], pa.int64()), pa.array([p for _, p in got], pa.float64())], names=["n", "p"])

    both = T.StructType([T.StructField("n", T.LongType()), T.StructField("p", T.DoubleType())])
    judged = near.where("not learning").select("y", arrow(evidence, both)("w").alias("e")).groupBy("e.n", "e.p").agg(F.count("*").alias("rows"), F.count_if("y").alias("bad"))
    seen: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for r in judged.orderBy("n", "p").collect():  # a row for each share in the lexicon
        x = seen[kind(r.n, r.p)]
        x[0], x[1], x[2] = x[0] + r.rows, x[1] + r.bad, x[2] + r.p * r.rows
    model.classes = {k: (bad + 2 * p / n) / (n + 2) for k, (n, bad, p) in seen.items() if p}
    for b in (sent, may, told):
        b.destroy()
    discard(rows, near)
    return model


def scorer(docs: DataFrame, model: Model):
    """score(text) as a function of a column."""
    sent = tune(docs.sparkSession).sparkContext.broadcast((model.chars, model.lexicon, model.rest, model.classes))
    here = _Once(lambda: Model(*sent.value))

    def score(text: pa.Array) -> pa.Array:
        m = here()
        return pa.array([m.score(t) for t in text.to_pylist()], pa.float64())

    return arrow(score, T.DoubleType())


def report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, score, predicted."""
    out = docs.select(F.col(id_col).alias("doc_id"), scorer(docs, model)(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, as they are."""
    s = "__toxicity"
    return docs.withColumn(s, scorer(docs, model)(F.col(text_col).cast("string"))).where(F.col(s) < THRESHOLD).drop(s)
