"""Interpolated modified Kneser-Ney model, counted in Spark and memory-mapped (operator 9).

Different words are counted first, dealt by ranges of their 64-bit hashes, and stored as sorted hash arrays, one
for each shard. A word's rank in them is its number, so what is sorted by number is sorted by hash, and no
two words or grams are ever taken for one another beyond that. Then grams of ``order`` words are counted by tasks in packed
numpy arrays, dealt by the range of the word before the last, merged, and stored in the shared folder: for each shard
and length the contexts as a sorted array of hashes, the number of followers of each, the followers' numbers,
sorted within a context, and their counts. Workers map the files; a batch of texts is scored by binary searches in them.

A gram of k words is a context of k - 1 words and a word. Its number in the longest order is its
count; in a shorter one how many different words precede it, or its count where it begins a text.
Each level's numbers come out of the next longer one's different grams, in the same task: both lie with the word before
the last. Only for a word that makes up more than an eighth of a shard, and for the start, longer grams are spread by
their contexts, pairs by themselves; their shorter grams are dealt once more and lie in files of their own,
and the sums of such a word are kept apart. The corpus is read in ROUNDS, each for a part of the shards, so that no
more than that part of all grams is between tasks at a time.

A level backs off to the one with a context shorter by its first word, the last to the uniform
distribution over the vocabulary and one unknown word. The first token of a text has the start as
its whole context, the second has the start and the first, and so on.

Defined results: a null text is an empty one and has its end as the only token; a word that was
never seen has the unknown word's probability; a word never seen as a context backs off
whole; without training texts every probability is 1 over one unknown word, that is 1; repeated
rows count, and are scored, each on their own. Counts are 64-bit wherever they are summed or stored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm import store
from postmill.llm import words as W
from postmill.llm.session import discard, fresh, partitions, release, saved, tune

END = W.fmix(np.array([0xE0D], W.U64))[0]
#: Tokens counted at once in a task, and rounds in which the corpus is read.
FLUSH, ROUNDS = 2_000_000, 2
#: Bytes of texts scored at once.
SCORED_BYTES = 6 << 20
#: Followers up to which a context's sums are made when asked for, and contexts between two stored offsets.
SHORT, STEP = 64, 16
SCORED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])


def stream(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, words, then one end; and each text's offsets."""
    w = W.split(text)
    n = len(text)
    out = np.full(len(w.hashes) + n, END, dtype=W.U64)
    out[np.arange(len(w.hashes)) + w.doc] = w.hashes
    return out, w.at + np.arange(n + 1)


def shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes."""
    return ((h >> W.U64(32)) * W.U64(shards) >> W.U64(32)).astype(np.int64)


def contexts(words: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of contexts of one, two, ... words; words are numbers, the last of a context first."""
    with np.errstate(over="ignore"):
        out = [W.fmix(words[0].astype(np.int64).view(W.U64) + W.PLACE[52])]
        for w in words[1:]:
            out.append(W.fmix(out[-1] * W.PLACE[50] + W.fmix(w.astype(np.int64).view(W.U64) ^ W.PLACE[51])))
    return out


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    fresh_row = np.zeros(len(cols[0]), bool)
    fresh_row[0] = True
    for c in cols:
        fresh_row[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh_row)


def _sizes(start: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(start, n))


def _summed(cols: list[np.ndarray], n: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of cols (numbers), the first column's order first, and the sums of n, or how many there are."""
    if not len(cols[0]):
        return cols, np.zeros(0, np.int64)
    low, names = [int(c.min()) for c in cols], None
    bits = [max(1, (int(c.max()) - x).bit_length()) for c, x in zip(cols, low, strict=True)]
    if sum(bits) > 63:
        names = [np.unique(c, return_inverse=True) for c in cols]
        low, bits = [0] * len(cols), [max(1, int(len(u) - 1).bit_length()) for u, _ in names]
    if sum(bits) <= 63:  # as one number
        key = np.zeros(len(cols[0]), np.int64)
        for c, x, b in zip([i for _, i in names] if names else cols, low, bits, strict=True):
            key <<= b
            key |= c - x if x else c
        if n is None:
            key.sort()
            start = _starts(key)
            sums = _sizes(start, len(key))
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            start = _starts(key)
            sums = np.add.reduceat(n[order], start)
        key, out = key[start], []
        for k in range(len(cols) - 1, -1, -1):
            out.append((key & ((1 << bits[k]) - 1)) + low[k])
            key >>= bits[k]
        return [names[k][0][c] if names else c for k, c in enumerate(out[::-1])], sums
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    start = _starts(*cols)
    sums = _sizes(start, len(order)) if n is None else np.add.reduceat(n[order], start)
    return [c[start] for c in cols], sums


def _narrow(n: np.ndarray, width: int) -> bytes:
    """Numbers in width bytes each."""
    return np.ascontiguousarray(n.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: np.ndarray) -> np.ndarray:
    """Of rows of bytes."""
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<i8").ravel()


def _pack(n: np.ndarray) -> bytes:
    """Counts: a byte each, those beyond 254 again in full."""
    big = n[n > 254].astype(np.int64)
    return np.minimum(n, 255).astype(np.uint8).tobytes() + big.tobytes()


class _Reader:
    """Of a part: what was written, in order."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def numbers(self, m: int, width: int) -> np.ndarray:
        self.at += m * width
        return _wide(np.frombuffer(self.raw, np.uint8, m * width, self.at - m * width).reshape(m, width))

    def longs(self, m: int) -> np.ndarray:
        self.at += 8 * m
        return np.frombuffer(self.raw, np.int64, m, self.at - 8 * m)

    def counts(self, m: int) -> np.ndarray:
        n = self.numbers(m, 1)
        big = n == 255
        n[big] = self.longs(int(big.sum()))
        return n


def _dealt(by: np.ndarray, shards: int, build) -> pa.RecordBatch:
    """Rows (shard, part) where build(slice) makes a part; by is ascending."""
    ends = np.searchsorted(by, np.arange(shards + 1))
    full = [(s, slice(int(ends[s]), int(ends[s + 1]))) for s in range(shards) if ends[s + 1] > ends[s]]
    return pa.record_batch({"shard": pa.array([s for s, _ in full], pa.int32()), "part": pa.array([build(x) for _, x in full], pa.binary())})


def _gathered(batches) -> dict[int, list[bytes]]:
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(s, []).append(x)
    return by


def _flushed(batches, take, done):
    held, size = [], 0
    for batch in batches:
        got = take(batch.column(0))
        held.append(got)
        size += len(got[0])
        if size >= FLUSH:
            yield done([np.concatenate(x) for x in zip(*held, strict=True)])
            held, size = [], 0
    if held:
        yield done([np.concatenate(x) for x in zip(*held, strict=True)])


def _count_words(shards: int):
    def done(cols):
        h, n = np.unique(cols[0], return_counts=True)
        return _dealt(shard(h, shards), shards, lambda x: np.int64(len(h[x])).tobytes() + h[x].tobytes() + _pack(n[x]))

    return lambda batches: _flushed(batches, lambda text: stream(text)[:1], done)


def _slim(n: np.ndarray) -> np.ndarray:
    """In the smallest type that holds all; a reader sees it by the file's size."""
    top = int(n.max()) if n.size else 0
    return n.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(t).max))


def _merge_words(folder: str):
    """Writes each shard's words and counts; returns how many there are, and the most frequent ones' places."""

    def f(batches):
        for s, parts in _gathered(batches).items():
            hs, ns = [], []
            for x in map(_Reader, parts):
                m = int(x.longs(1)[0])
                hs.append(x.longs(m).view(W.U64))
                ns.append(x.counts(m))
            h, n = np.concatenate(hs), np.concatenate(ns)
            order = np.argsort(h, kind="stable")
            h = h[order]
            start = _starts(h)
            h, n = h[start], np.add.reduceat(n[order], start)
            store.write(folder, f"word-{s}", h)
            store.write(folder, f"count-{s}", _slim(n))
            top = np.argsort(-n)[: 64 * 8]
            yield pa.record_batch({"shard": pa.array([s] * len(top), pa.int32()), "kinds": pa.array([len(h)] * len(top)), "total": pa.array([int(n.sum())] * len(top)), "place": pa.array(top), "n": pa.array(n[top])})

    return f


@dataclass
class Words:
    """The numbered words: files of hashes in folder, and the first number of each shard. The start's number is kinds.
    hot: the numbers, ascending, of words whose grams are spread, the start's among them."""

    folder: str
    shards: int
    first: np.ndarray
    hot: np.ndarray
    _files: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def kinds(self) -> int:
        return int(self.first[-1])

    @property
    def width(self) -> int:
        """Bytes of a number."""
        return max(1, -(-self.kinds.bit_length() // 8))

    def __getstate__(self):
        return self.__dict__ | {"_files": {}}

    def file(self, name: str, s: int | None, dtype) -> np.ndarray:
        key = name if s is None else f"{name}-{s}"
        if key not in self._files:
            self._files[key] = store.read(self.folder, key, dtype)
        return self._files[key]

    def slim(self, name: str, s: int, n: int) -> np.ndarray:
        """What _slim made for n values."""
        raw = self.file(name, s, np.uint8)
        return raw.view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n])

    def look(self, h: np.ndarray, *names: str) -> list[np.ndarray]:
        """The numbers of words of ascending hashes h, -1 for those that aren't there, and the values beside them."""
        out = [np.full(len(h), -1, np.int64), *(np.zeros(len(h), np.int64) for _ in names)]
        ends = np.searchsorted(shard(h, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.first) > 0)).tolist():
            own, mine = self.file("word", s, W.U64), h[ends[s] : ends[s + 1]]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            hit = np.flatnonzero(own[at] == mine)
            out[0][ends[s] + hit] = self.first[s] + at[hit]
            for values, name in zip(out[1:], names, strict=True):
                values[ends[s] + hit] = self.slim(name, s, len(own))[at[hit]]
        return out

    def is_hot(self, number: np.ndarray) -> np.ndarray:
        return self.hot[np.minimum(np.searchsorted(self.hot, number), len(self.hot) - 1)] == number

    def where(self, before: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        """The shards of grams of these words, the one before the last first. Those of a hot word there are dealt by the
        whole context, pairs, whose context it is, by the pair."""
        out = np.searchsorted(self.first, before[0], side="right") - 1
        apart = np.flatnonzero(self.is_hot(before[0]))
        if len(apart):
            out[apart] = shard(contexts([word[apart], before[0][apart]] if len(before) == 1 else [c[apart] for c in before])[-1], self.shards)
        return out


def _parts(words: Words, cols: list[np.ndarray], n: np.ndarray, low: int = 0, high: int | None = None) -> pa.RecordBatch:
    """Different grams of one level and their numbers, dealt out to the shards from low to below high. cols: words before the
    last, the nearest first, then the last; rows are sorted by them."""
    by = words.where(cols[:-1], cols[-1])
    mine = (by >= low) & (by < (words.shards if high is None else high))
    if not mine.all():
        by, n, cols = by[mine], n[mine], [c[mine] for c in cols]
    if (by[1:] < by[:-1]).any():
        order = np.argsort(by, kind="stable")
        by, n, cols = by[order], n[order], [c[order] for c in cols]

    def build(x):
        start = _starts(cols[0][x])
        head = np.array([len(cols), len(start), len(n[x])], np.int64)
        runs = _pack(_sizes(start, len(n[x])))
        return head.tobytes() + _narrow(cols[0][x][start], words.width) + runs + b"".join(_narrow(c[x], words.width) for c in cols[1:]) + _pack(n[x])

    return _dealt(by, words.shards, build)


def _unpacked(x: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    r = _Reader(x)
    level, heads, m = r.longs(3).tolist()
    first = r.numbers(heads, width)
    cols = [np.repeat(first, r.counts(heads))]
    cols += [r.numbers(m, width) for _ in range(level - 1)]
    return cols, r.counts(m)


def _count_grams(words: Words, order: int, low: int, high: int):
    """Grams of order words, and the shorter ones that begin a text: those have nothing before them to count.
    Only of the shards from low to below high."""

    def take(text):
        tokens, at = stream(text)
        place = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
        return tokens, np.minimum(place, order).astype(np.int8)

    def done(cols):
        h, own = np.unique(cols[0], return_inverse=True)
        number, place = np.append(words.look(h)[0], words.kinds), cols[1]
        home, hot = np.searchsorted(words.first, number, side="right") - 1, words.is_hot(number)
        got = []
        for k in range(2, order + 1):
            pick = np.flatnonzero(place >= k - 2 if k == order else place == k - 2)
            last = np.where(place[pick] > 0, own[np.maximum(pick - 1, 0)], len(h))
            mine = hot[last] | (home[last] >= low) & (home[last] < high)  # hot ones are sorted out with all others of their kind
            pick, last = pick[mine], last[mine]
            before = [last, *(np.where(place[pick] >= j, own[np.maximum(pick - j, 0)], len(h)) for j in range(2, k))]
            different, n = _summed([*before, own[pick]], None)  # in the order of hashes, which is that of numbers
            got.append(_parts(words, [number[c] for c in different], n, low, high))
        return pa.Table.from_batches(got).combine_chunks().to_batches()

    def f(batches):
        for made in _flushed(batches, take, done):
            yield from made

    return f


def _spilled(n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n in bytes, at most top, and the places and values of those beyond."""
    big = np.flatnonzero(n >= top)
    return np.minimum(n, top).astype(np.uint8), big, n[big]


def _stored(folder: str, name: str, width: int, cols: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes different grams, sorted; returns the place of each context's first gram, and its sums: how many numbers are one,
    two and more, and all together."""
    start = _starts(*cols[:-1])
    size, ctx = _sizes(start, len(n)), contexts([c[start] for c in cols[:-1]])[-1]
    by = np.argsort(ctx)
    ctx, size, place = ctx[by], size[by], start[by]
    start = np.cumsum(size) - size
    order = np.arange(len(n)) - np.repeat(start - place, size)
    word, n = cols[-1][order], n[order]
    follow = np.stack([np.add.reduceat(x.astype(np.int64), start) for x in (n == 1, n == 2, n > 2, n)], axis=1)
    long = np.flatnonzero(size > SHORT)
    runs, *more = _spilled(size, 255)
    store.write(folder, f"{name}-runs", np.append(runs, np.zeros(-len(runs) % STEP, np.uint8)))
    for kind, value in zip(("long-at", "long-size"), more, strict=True):
        store.write(folder, f"{name}-{kind}", value)
    for kind, value in zip(("n", "big-at", "big-n"), _spilled(n, 255), strict=True):
        store.write(folder, f"{name}-{kind}", value)
    store.write(folder, f"{name}-context", ctx)
    store.write(folder, f"{name}-offset", start[::STEP])
    store.write(folder, f"{name}-word", np.frombuffer(_narrow(word, width) + bytes(8 - width), np.uint8))
    store.write(folder, f"{name}-sums-at", long)
    store.write(folder, f"{name}-sums", np.ascontiguousarray(follow[long]))
    return place, follow


_FOUND = "kind int, level int, shard int, word bigint, x bigint, y bigint, z bigint, total bigint, part binary"


def _merge_grams(words: Words, level: int, name: str):
    """Writes the grams of a level, and those of all shorter ones but of hot words. Returns parts of the latter (kind 3),
    parts of predecessor numbers of words (kind 0), hot words' followers (kind 1: word, three numbers, sum), and how many
    grams of a level (kind 2) have each small number."""

    def f(batches):
        for s, parts in _gathered(batches).items():
            rows: list[tuple] = []
            held: dict[int, list] = {}
            for x in parts:
                held.setdefault(int(np.frombuffer(x, np.int64, 1)[0]), []).append(x)
            made = None  # of the level above
            for k in range(level, 1, -1):
                got = [_unpacked(x, words.width) for x in held.pop(k, [])] + ([made] if made else [])
                made = None
                if not got:
                    continue
                cols, n = _summed([np.concatenate(c) for c in zip(*(g[0] for g in got), strict=True)], np.concatenate([g[1] for g in got]))
                if k < level:  # what is spread by words has come together only where no word is hot
                    apart = words.is_hot(cols[0])
                    if apart.any():
                        out = _parts(words, [c[apart] for c in cols], n[apart])
                        rows += [(3, k, int(t), 0, 0, 0, 0, 0, part) for t, part in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
                        cols, n = [c[~apart] for c in cols], n[~apart]
                        if not len(n):
                            continue
                first, follow = _stored(words.folder, f"gram{k}{name}-{s}", words.width, cols, n)
                if k == 2:
                    last = cols[0][first]
                    rows += [(1, k, 0, int(w), *x, None) for w, x in zip(last[words.is_hot(last)].tolist(), follow[words.is_hot(last)].tolist(), strict=True)]
                rows += [(2, k, s, m, int((n == m).sum()), 0, 0, 0, None) for m in (1, 2, 3, 4)] + [(2, k, s, 0, len(n), 0, 0, 0, None)]
                if k == 2:
                    (w,), m = _summed([cols[1]], None)
                    out = _dealt(np.searchsorted(words.first, w, side="right") - 1, words.shards, lambda x, w=w, m=m: np.int64(len(w[x])).tobytes() + _narrow(w[x], words.width) + _pack(m[x]))
                    rows += [(0, 1, int(t), 0, 0, 0, 0, 0, part) for t, part in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
                else:
                    made = _summed([*cols[:-2], cols[-1]], None)
            cols = list(zip(*rows, strict=True))
            kind = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kind, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return f


def _merge_before(words: Words):
    """Writes how many different words precede each word; returns how many words have each small number."""

    def f(batches):
        for s, parts in _gathered(batches).items():
            n = np.zeros(int(words.first[s + 1] - words.first[s]), np.int64)
            for x in map(_Reader, parts):
                m = int(x.longs(1)[0])
                at = x.numbers(m, words.width) - words.first[s]
                n[at] += x.counts(m)
            assert n.all(), "a word without predecessors"
            store.write(words.folder, f"before-{s}", _slim(n))
            yield pa.record_batch({"k": pa.array([1, 2, 3, 4, 0, -1]), "n": pa.array([*(int((n == k).sum()) for k in (1, 2, 3, 4)), int(n.sum()), int((n > 2).sum())])})

    return f


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's for counts of one, two, and more; where a count of counts is 0, the nearest sane value."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else k * 0.5)
    return out[0], out[1], out[2]



@dataclass
class Model:
    """What a worker needs beside the files in words.folder."""

    words: Words
    #: Tokens, texts and different pairs seen in training.
    tokens: int
    texts: int
    pairs: int
    #: Of grams of two words, of three, and so on.
    gram_discounts: list[tuple[float, float, float]]
    word_discounts: tuple[float, float, float]
    #: Share of the uniform distribution in the words' own.
    rest: float
    hot_follow: np.ndarray
    #: Names of the files of each level, with a shard: those of hot words' shorter grams have an h.
    held: set[str] = field(default_factory=set)

    @property
    def order(self) -> int:
        return len(self.gram_discounts) + 1

    @property
    def kinds(self) -> int:
        return self.words.kinds

    def runs(self, file: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the followers of the contexts at these places begin, and how many there are."""
        get = lambda kind, dtype: self.words.file(f"{file}-{kind}", None, dtype)
        small = get("runs", np.uint8)
        step = at // STEP
        begin = get("offset", np.int64)[step] + np.where(np.arange(STEP) < (at - step * STEP)[:, None], small.reshape(-1, STEP)[step], 0).sum(axis=1, dtype=np.uint32)
        size = small[at].astype(np.int64)
        big = get("long-at", np.int64)
        if len(big):
            wide = get("long-size", np.int64)
            over = np.concatenate([[0], np.cumsum(wide - 255)])
            k = np.searchsorted(big, at)
            begin += over[k] - over[np.searchsorted(big, step * STEP)]
            full = np.flatnonzero(size == 255)
            size[full] = wide[k[full]]
        return begin, size

    def values(self, file: str, at: np.ndarray) -> np.ndarray:
        n = self.words.file(f"{file}-n", None, np.uint8)[at].astype(np.int64)
        full = np.flatnonzero(n == 255)
        if len(full):
            places = self.words.file(f"{file}-big-at", None, np.int64)
            n[full] = self.words.file(f"{file}-big-n", None, np.int64)[np.searchsorted(places, at[full])]
        return n

    def sums(self, file: str, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the contexts at these places: how many numbers are one, two and more, and all together."""
        out = np.zeros((len(at), 4), np.int64)
        long = np.flatnonzero(size > SHORT)
        if len(long):
            places = self.words.file(f"{file}-sums-at", None, np.int64)
            out[long] = self.words.file(f"{file}-sums", None, np.int64).reshape(-1, 4)[np.searchsorted(places, at[long])]
        short = np.flatnonzero(size <= SHORT)
        if len(short):
            m = size[short]
            first = np.cumsum(m) - m
            n = self.values(file, np.arange(int(m.sum())) - np.repeat(first, m) + np.repeat(begin[short], m))
            for k, x in enumerate((n == 1, n == 2, n > 2, n)):
                out[short, k] = np.add.reduceat(x.astype(np.int64), first)
        return out

    def ranges(self, name: str, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of contexts of these hashes, where their followers lie, and how many there are, 0 for those that aren't there."""
        names = self.words.file(f"{name}-context", None, W.U64)
        begin, size = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64)
        order = np.argsort(ctx)
        at = np.empty(len(ctx), np.int64)
        at[order] = np.minimum(np.searchsorted(names, ctx[order]), len(names) - 1)
        there = np.flatnonzero(names[at] == ctx)
        begin[there], size[there] = self.runs(name, at[there])
        return at, begin, size

    def files(self, where: np.ndarray, level: int, hot: np.ndarray):
        """The rows of each file, by shard and whether the word before the last is hot, and its name."""
        code = where * 2 + (hot & (level < self.order))
        order = np.argsort(code.astype(np.int16) if self.words.shards < 1 << 14 else code, kind="stable")
        start = _starts(code[order])
        for a, m in zip(start.tolist(), _sizes(start, len(order)).tolist(), strict=True):
            s, apart = divmod(int(code[order[a]]), 2)
            name = f"gram{level}{'h' * apart}-{s}"
            if name in self.held:
                yield name, order[a : a + m]

    def found(self, name: str, begin: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The numbers of grams whose followers lie in these ranges, by binary search for the word, 0 for those that aren't there."""
        width = self.words.width
        raw = self.words.file(f"{name}-word", None, np.uint8)
        raw = np.ndarray(((len(raw) - 8) // width + 1,), "<i8", raw, strides=(width,))  # and the first bytes of the next ones
        only = (1 << 8 * width) - 1
        lo, hi = begin.copy(), begin + size
        live = np.flatnonzero(size > 1)  # to the last follower that isn't greater
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            up = (raw[mid] & only) <= word[live]
            lo[live[up]], hi[live[~up]] = mid[up], mid[~up]
            live = live[hi[live] - lo[live] > 1]
        n = np.zeros(len(word), np.int64)
        pick = np.flatnonzero(size > 0)
        pick = pick[(raw[lo[pick]] & only) == word[pick]]
        n[pick] = self.values(name, lo[pick])
        return n

    def probabilities(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(token | those before it in its text) of each token, the training counts of different tokens, and which one each is."""
        e = np.array([0.0, *self.word_discounts])
        h, own = np.unique(tokens, return_inverse=True)
        number, count, n = self.words.look(h, "count", "before")
        uniform = 1.0 / (self.kinds + 1)
        p = (np.maximum(n - e[np.minimum(n, 3)], 0.0) / max(self.pairs, 1) + (self.rest if self.pairs else 1.0) * uniform)[own]
        number = np.append(number, self.kinds)
        place = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
        # Contexts in this batch are numbered; -1 is one that was never seen, which has no longer one that was. Each is
        # known by a token that follows it.
        context = np.where(place > 0, np.append(0, own[:-1])[: len(own)], len(h)) if self.pairs else np.full(len(tokens), -1)
        context[number[context] < 0] = -1
        for k, ds in enumerate(self.gram_discounts, 2):
            use = np.flatnonzero(context >= 0)
            if not len(use):
                break
            example = np.full(int(context.max()) + 1, -1)
            example[context[use]] = use
            held = np.flatnonzero(example >= 0)
            first = example[held]
            before = [np.where(place[first] >= j, number[own[np.maximum(first - j, 0)]], self.kinds) for j in range(1, k)]
            ctx, hot = contexts(before)[-1], self.words.is_hot(before[0])
            begin, size = np.zeros(len(example), np.int64), np.zeros(len(example), np.int64)
            sums, where = np.zeros((len(example), 4), np.int64), np.zeros(len(example), np.int64)
            spread = hot if k == 2 else np.zeros(len(hot), bool)  # whose followers lie in several shards
            one = np.flatnonzero(~spread)
            where[held[one]] = self.words.where([c[one] for c in before], before[0][one])
            for name, pick in self.files(where[held[one]], k, hot[one]):
                mine = held[one[pick]]
                places, begin[mine], size[mine] = self.ranges(name, ctx[one[pick]])
                there = np.flatnonzero(size[mine] > 0)
                sums[mine[there]] = self.sums(name, places[there], begin[mine[there]], size[mine[there]])
            sums[held[spread]] = self.hot_follow[np.searchsorted(self.words.hot, before[0][spread])]
            is_hot, is_spread, hashes = (np.zeros(len(example), x.dtype) for x in (hot, spread, ctx))
            is_hot[held], is_spread[held], hashes[held] = hot, spread, ctx

            use = use[sums[context[use], 3] > 0]
            key, gram = context[use] * (len(h) + 1) + own[use], np.arange(len(use))
            some = use
            if k < self.order:  # grams that are contexts next are told apart
                _, some, gram = np.unique(key, return_index=True, return_inverse=True)
                some = use[some]
            c, word, mine = np.zeros(len(some), np.int64), number[own[some]], context[some]
            near = np.flatnonzero(~is_spread[mine])
            for name, pick in self.files(where[mine[near]], k, is_hot[mine[near]]):
                x = near[pick]
                c[x] = self.found(name, begin[mine[x]], size[mine[x]], word[x])
            far = np.flatnonzero(is_spread[mine])
            if len(far):
                last = np.where(place[some[far]] > 0, number[own[np.maximum(some[far] - 1, 0)]], self.kinds)
                for name, pick in self.files(self.words.where([last], word[far]), k, np.ones(len(far), bool)):
                    x = far[pick]
                    c[x] = self.found(name, *self.ranges(name, hashes[mine[x]])[1:], word[x])
            n, d = c[gram], np.array([0.0, *ds])
            total = np.maximum(sums[:, 3], 1)
            left = (sums[:, 0] * ds[0] + sums[:, 1] * ds[1] + sums[:, 2] * ds[2]) / total  # of each context
            p[use] = np.maximum(n - d[np.minimum(n, 3)], 0.0) / total[context[use]] + left[context[use]] * p[use]
            if k < self.order:
                ended = np.full(len(tokens) + 1, -1)
                ended[use + 1] = np.where(n > 0, gram, -1)
                context = np.where(place >= k - 1, ended[:-1], -1)
        return p, count, own

    def score(self, text: pa.Array) -> pa.Array:
        tokens, at = stream(text)
        p, count, own = self.probabilities(tokens, at)
        sums = [np.add.reduceat(x, at[:-1]) if len(text) else x for x in ((count > 0).astype(np.int64)[own], np.log10((count + 1) / (self.tokens + self.kinds + 1))[own], np.log10(p))]
        return pa.StructArray.from_arrays([pa.array(np.diff(at)), *map(pa.array, sums)], names=["n_tokens", "n_known", "base", "score"])


def fit(docs: DataFrame, text_col: str = "text", order: int = 2, rounds: int = ROUNDS) -> Model:
    """Counts all of docs, grams of up to order words, and stores the model in the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = tune(docs.sparkSession)
    folder = fresh(spark, "ngram-lm")
    shards = parts = partitions(docs)
    text = docs.select(F.col(text_col).cast("string").alias("t"))
    deal = "shard int, part binary"
    told = saved(text.mapInArrow(_count_words(shards), deal).repartition(parts, "shard").mapInArrow(_merge_words(folder), "shard int, kinds bigint, total bigint, place bigint, n bigint"), "lm-words")
    size, tokens = np.zeros(shards, np.int64), 0
    for r in told.groupBy("shard").agg(F.first("kinds").alias("kinds"), F.first("total").alias("total")).collect():
        size[r.shard], tokens = r.kinds, tokens + r.total
    first = np.concatenate([[0], np.cumsum(size)])
    hot = [int(first[r.shard]) + r.place for r in told.where(F.col("n") > tokens / (8 * shards)).select("shard", "place").collect()]  # 8 a shard at most
    words = Words(folder, shards, first, np.array(sorted([*hot, int(first[-1])]), np.int64))
    discard(told)
    release(spark)

    sent = spark.sparkContext.broadcast(words)  # a number a shard, and the hot ones
    found = []
    for r in range(rounds):
        low, high = shards * r // rounds, shards * (r + 1) // rounds
        count = lambda b, low=low, high=high: _count_grams(sent.value, order, low, high)(b)
        made = text.mapInArrow(count, deal).repartition(parts, "shard").mapInArrow(lambda b: _merge_grams(sent.value, order, "")(b), _FOUND)
        found.append(saved(made, "lm-grams"))
        release(spark)
    for level in range(order - 1, 1, -1):  # of hot words: of one length a job, as the next comes from it
        more = found[0].where("kind = 3")
        for x in found[1:]:
            more = more.union(x.where("kind = 3"))
        merge = lambda b, level=level: _merge_grams(sent.value, level, "h")(b)
        made = more.where(F.col("level") == level).select("shard", "part").repartition(parts, "shard").mapInArrow(merge, _FOUND)
        found.append(saved(made, "lm-grams"))
        release(spark)

    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    often: dict[int, dict[int, int]] = {k: {} for k in range(2, order + 1)}
    for r in every.where("kind = 2").groupBy("level", "word").agg(F.sum("x").alias("x")).collect():
        often[r.level][r.word] = r.x
    held = set()
    for x, h in ((x, "h" * (i >= rounds)) for i, x in enumerate(found)):
        held |= {f"gram{r.level}{h}-{r.shard}" for r in x.where("kind = 2").select("level", "shard").distinct().collect()}
    follow = {r.word: (r.x, r.y, r.z, r.total) for r in every.where("kind = 1").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("x", "y", "z", "total"))).collect()}
    before = every.where("kind = 0").select("shard", "part").repartition(parts, "shard").mapInArrow(lambda b: _merge_before(sent.value)(b), "k bigint, n bigint")
    rare = {r.k: r.n for r in before.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    discard(*found)
    release(spark)
    pairs = often[2].get(0, 0)
    e = discounts(*(rare.get(k, 0) for k in (1, 2, 3, 4)))
    rest = sum(d * n for d, n in zip(e, (rare.get(1, 0), rare.get(2, 0), rare.get(-1, 0)), strict=True)) / max(pairs, 1)
    hot_follow = np.array([follow.get(k, (0, 0, 0, 0)) for k in words.hot.tolist()], np.int64).reshape(-1, 4)
    gram_discounts = [discounts(*(often[k].get(m, 0) for m in (1, 2, 3, 4))) for k in range(2, order + 1)]
    texts = follow.get(words.kinds, (0, 0, 0, 0))[3]
    return Model(words, tokens, texts, pairs, gram_discounts, e, rest, hot_follow, held)


_here: dict[str, Model] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, tokens, known tokens, the base score and the model's log10 probability."""
    sent = tune(docs.sparkSession).sparkContext.broadcast(model)  # a few numbers a shard

    def model_here() -> Model:
        folder = sent.value.words.folder
        if folder not in _here:  # a worker keeps its maps from batch to batch
            _here.clear()
            _here[folder] = sent.value
        return _here[folder]

    def scored(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SCORED_BYTES:  # many texts at once look up what they share once
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    def told(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        got = model_here().score(rows.column(1).combine_chunks())
        return pa.RecordBatch.from_arrays([rows.column(0).combine_chunks(), *got.flatten()], names=["doc_id", "n_tokens", "n_known", "base", "score"])


    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    out = own.mapInArrow(scored, T.StructType([own.schema["doc_id"], *SCORED.fields]))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of all scored texts together, of the model and of the base."""
    p = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.agg(p("score").alias("perplexity"), p("base_score").alias("base_perplexity"))
