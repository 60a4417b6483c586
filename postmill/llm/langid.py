"""Language identification by cross-parsing entropy (operator 4).

For each language a suffix automaton accepts every substring of a bounded labelled text.
A document is parsed greedily into longest matches against each automaton; the language
that needs the fewest phrases, each weighted by the bits of a position in its labelled
text, wins. Thousands of text pieces walk the automata at once as numpy columns.

Texts are read whole: letters are lower-cased, everything else becomes one space. A long text is parsed
in lanes of LANE symbols at once; then the parse of each lane goes on into the next, until a phrase of it
begins where one begins there, from where on both are the same. So the phrases are those of the whole text.

Defined results: ``und`` with score 0 for a null text or one without letters, and where no
labelled text exists; rows without a language, or with an empty text, teach nothing; equal
costs go to the language that comes first in code-point order; repeated rows are predicted
each on their own and alike.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm import words as W
from postmill.llm.session import arrow, tune

#: The bound of the labelled sample: documents of each language, and symbols in all. Documents are learned in pieces of
#: so many characters, as they are parsed; if not all fit, those of the smallest hash, from wherever in the documents.
SAMPLE_DOCS, TRAIN_SYMBOLS, PIECE = 60, 30_000, 512
#: Distinct letters with a column in the tables of transitions; those of rarer ones are found by sorted keys.
ALPHABET = 94
#: Symbols of a lane, and of the texts parsed at once, a longer one alone.
LANE, CHUNK = 512, 1 << 21
PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for anything else."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, 0 for a run of other characters, and each text's offsets."""
    data, offsets = W.utf8(col)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    at = points[offsets]
    low = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[at] = True
    keep = low != 0
    keep[1:] |= (low[:-1] != 0) & ~edge[1:-1]  # the first of other characters after a letter
    kept = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    return low[keep], kept[at]


def automaton(text: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of text: for symbols below size a row for each state, -1 where there is none,
    for others rows of state, symbol and next state."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(moves), size), -1, dtype=np.int32)
    rare = []
    for state, out in enumerate(moves):
        for c, to in out.items():
            if c < size:
                table[state, c] = to
            else:
                rare.append((state, c, to))
    return table, np.array(rare, np.int64).reshape(-1, 3)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: Learned letters in order, and their symbol numbers, the most frequent letter's first; 0 is the space, 1 any other letter.
    letters: np.ndarray
    codes: np.ndarray
    #: All automata one below the other, then a state without transitions; roots[k] is the first state of language k.
    table: np.ndarray
    roots: np.ndarray
    #: Bits that a phrase costs in each language.
    bits: np.ndarray
    #: Transitions by symbols beyond the table's columns: state * span + symbol in order, and the next state.
    keys: np.ndarray
    goes: np.ndarray

    @property
    def span(self) -> int:
        return len(self.letters) + 2

    def numbers(self, low: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.letters, low), max(0, len(self.letters) - 1))
        known = self.letters[k] == low if len(self.letters) else np.zeros(len(low), bool)
        code = self.codes[k] if len(self.letters) else np.ones(len(low), np.int64)
        return np.where(low == 0, 0, np.where(known, code, 1)).astype(np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states by the symbols c, one for each column, -1 where there is none."""
        width = self.table.shape[1]
        rare = c >= width
        if not rare.any():
            return self.table.ravel()[state * width + c]
        to = self.table.ravel()[state * width + np.where(rare, 1, c)]
        key = state[..., rare].astype(np.int64) * self.span + c[rare]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        to[..., rare] = np.where(self.keys[at] == key, self.goes[at], -1)
        return to

    def walk(self, state: np.ndarray, root: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states by the symbols c, and where a new phrase begins with them."""
        to = self.step(state, c)
        miss = to < 0
        if miss.any():
            fresh = self.step(np.broadcast_to(root, state.shape), c)
            to = np.where(miss, np.where(fresh < 0, len(self.table) - 1, fresh), to)
        return to, miss


def train(texts: list[tuple[str, str]], limit: int = TRAIN_SYMBOLS) -> Model:
    """texts: (language, text), in the order in which they fill each language's limit; what doesn't fit whole is left out."""
    by: dict[str, list[np.ndarray]] = {}
    low, at = symbols(pa.array([t for _, t in texts], pa.large_string()))
    for k, (lang, _) in enumerate(texts):
        own = by.setdefault(lang, [])
        room = limit - sum(map(len, own))
        if 0 < at[k + 1] - at[k] < room:
            own.append(np.append(low[at[k] : at[k + 1]], np.uint32(0)))
    langs = sorted(k for k, own in by.items() if own)
    joined = {k: np.concatenate(by[k]) for k in langs}
    letters, count = np.unique(np.concatenate([v[v > 0] for v in joined.values()]) if langs else np.zeros(0, np.uint32), return_counts=True)
    codes = np.empty(len(letters), np.int64)
    codes[np.argsort(-count, kind="stable")] = np.arange(len(letters)) + 2
    width = min(len(letters), ALPHABET) + 2
    none = np.zeros(0, np.int64)
    model = Model(langs, letters, codes, np.zeros((0, 0), np.int32), none, np.zeros(0), none, none)
    tables, roots, rare = [], [], [np.zeros((0, 3), np.int64)]
    for k in langs:
        t, more = automaton(model.numbers(joined[k]).tolist(), width)
        base = sum(map(len, tables))
        roots.append(base)
        rare.append(more + np.array([base, 0, base]))
        tables.append(np.where(t >= 0, t + base, -1).astype(np.int32))
    bits = np.array([np.log2(max(2, len(joined[k]))) for k in langs])
    tables.append(np.full((1, width), -1, np.int32))  # where a letter leads that no text has: to no match
    state, c, to = np.concatenate(rare).T
    keys = state * model.span + c
    order = np.argsort(keys)
    return Model(langs, letters, codes, np.concatenate(tables), np.array(roots, np.int64), bits, keys[order], to[order].astype(np.int32))


def phrases(m: Model, low: np.ndarray, at: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Phrases that each text (row) needs in each language (column)."""
    size, roots = np.diff(at), m.roots
    pieces = -(-size // lane)
    owner = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[owner] + nth * lane
    length = np.minimum(lane, at[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    place = np.empty(len(order), np.int64)  # a lane's column
    place[order] = np.arange(len(order))
    sym = m.numbers(low)
    steps = int(length[0]) if len(length) else 0
    state = np.repeat(roots[:, None], len(start), axis=1)
    begins = np.zeros((steps, len(roots), len(start)), bool)  # a phrase, at a symbol, in a language, in a lane
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # lanes longer than t
    for t in range(steps):
        n = active[t]
        state[:, :n], begins[t, :, :n] = m.walk(state[:, :n], roots[:, None], sym[start[:n] + t])
    begins[:1] = True

    def carried(lang: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Carries the phrase at the end of the lane before into lane k; those lanes that it runs through without meeting a beginning."""
        col, s = place[k], state[lang, place[k - 1]]
        live, through = np.arange(len(k)), []
        for t in range(steps):
            over = length[col[live]] <= t
            through.append(live[over])
            live = live[~over]
            if not len(live):
                break
            x, y = lang[live], col[live]
            s[live], miss = m.walk(s[live], roots[x], sym[start[y] + t])
            same = miss & begins[t, x, y]
            begins[t, x, y] = miss
            live = live[~same]
        through = np.concatenate([*through, live])
        state[lang[through], col[through]] = s[through]
        return lang[through], k[through]

    later = np.flatnonzero(nth > 0)
    lang, k = np.repeat(np.arange(len(roots)), len(later)), np.tile(later, len(roots))
    while len(k):
        lang, k = carried(lang, k)
        on = np.append(nth[1:], 0)[k] > 0  # whose end has changed, so the next lane's beginning has
        lang, k = lang[on], k[on] + 1
    count = begins.sum(axis=0)
    return np.stack([np.bincount(owner, weights=count[x, place], minlength=len(size)) for x in range(len(roots))], axis=1).astype(np.int64)


def predict(text: pa.Array, m: Model) -> pa.Array:
    low, at = symbols(text)
    lettered = W.per_doc(low != 0, at) > 0
    if not m.langs:
        lettered[:] = False
        cost = np.zeros((len(at) - 1, 1))
    else:
        parsed = [phrases(m, low[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in W.chunks(at, CHUNK)]
        cost = np.concatenate([np.zeros((0, len(m.langs))), *parsed]) * m.bits
    best = cost.argmin(axis=1)
    least = cost[np.arange(len(cost)), best]
    # The costs' excess, in standard deviations of a count of phrases, as odds against the others.
    odds = np.exp(-(cost - least[:, None]) / np.sqrt(np.maximum(least, 1.0))[:, None])
    score = np.where(lettered, 1.0 / odds.sum(axis=1), 0.0)
    names = [m.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], names=["lang", "score"])


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the labelled rows of docs: for each language the SAMPLE_DOCS of the smallest id hash, in pieces."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where("l is not null and length(t) > 0").withColumn("h", F.xxhash64("i"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "i", F.md5("t")))
    kept = rows.withColumn("n", first).where(F.col("n") <= SAMPLE_DOCS)
    at = F.explode(F.sequence(F.lit(1), F.length("t"), F.lit(PIECE)))
    pieces = kept.select("l", "n", "t", at.alias("at")).select("l", F.xxhash64("n", "at").alias("h"), "n", "at", F.substring("t", F.col("at"), F.lit(PIECE)).alias("t"))
    letters = F.length(F.regexp_replace("t", r"\P{L}+", ""))
    # Letters of the pieces before: as many as fill the limit, and as many again, for those left out.
    before = F.sum(letters).over(Window.partitionBy("l").orderBy("h", "n", "at").rowsBetween(Window.unboundedPreceding, -1))
    got = pieces.where(letters > 0).withColumn("before", before).where(F.coalesce("before", F.lit(0)) < 2 * TRAIN_SYMBOLS).select("l", "h", "n", "at", "t").collect()
    return train([(r.l, r.t) for r in sorted(got)])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score."""
    sent = tune(docs.sparkSession).sparkContext.broadcast(model)  # bounded by TRAIN_SYMBOLS a language
    p = arrow(lambda text: predict(text, sent.value), PREDICTED)
    out = docs.select(F.col(id_col).alias("doc_id"), p(F.col(text_col).cast("string")).alias("p"))
    return out.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
