"""Benchmark decontamination with an FM-index for each shard of the corpus (operator 10).

A shard is an Arrow batch of whole documents. Its words become numbers of the benchmark's
vocabulary. Only runs of vocabulary words that are at least as long as the shortest test
phrase can hold an occurrence, so the index holds those runs, with separators between;
that loses nothing, whatever the benchmark. Every distinct test phrase is searched backwards
through wavelet-tree ranks, its occurrences are located by sampled suffix positions, and the
occurrences of a document are merged into removal spans.

Defined results: null texts and items have no words; an item without words has no window;
a benchmark row without an item_id still marks words but is not counted or listed as an item; ids are of any type and kept as strings; equal
items, windows and rows count once each; an empty benchmark hits nothing, and the hash is
then that of the empty string. The phrases are broadcast in blocks of at most BLOCK_WORDS
words, so what is broadcast is bounded for any benchmark.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm import words as W
from postmill.llm.fmindex import FMIndex
from postmill.llm.session import arrow, saved, tune

WINDOW = 13
#: Words of test phrases searched in one pass over the corpus, about 100 bytes of driver memory each.
BLOCK_WORDS = 400_000
#: Words of one index; a shard with more is indexed in parts of whole documents.
INDEX_WORDS = 1_000_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Phrases:
    """Distinct test phrases over a vocabulary of sorted word hashes."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    #: Pairs (phrase, item), by phrase; those of phrase i are item_at[i]:item_at[i+1].
    item_at: np.ndarray
    items: np.ndarray
    #: Ids of the items that items numbers.
    names: pa.Array


def phrases(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    """The windows of the items; one of fewer words, but not none, is a window as a whole."""
    w = W.split(pa.array([t for _, t in rows], pa.large_string()), W.ALNUM)
    vocabulary = np.unique(w.hashes)
    ids = np.searchsorted(vocabulary, w.hashes)
    names = sorted({i for i, _ in rows if i is not None})
    number = {i: k for k, i in enumerate(names)}
    owners: dict[tuple[int, ...], set[int]] = {}
    for k, (item, _) in enumerate(rows):
        own = ids[w.at[k] : w.at[k + 1]].tolist()
        for i in range(max(1, len(own) - window + 1) if own else 0):
            at = owners.setdefault(tuple(own[i : i + window]), set())
            if item is not None:
                at.add(number[item])
    patterns = np.zeros((len(owners), window), dtype=np.int64)
    for k, p in enumerate(owners):
        patterns[k, : len(p)] = p
    lengths = np.array([len(p) for p in owners], dtype=np.int64)
    sizes = np.array([len(x) for x in owners.values()], dtype=np.int64)
    items = np.array([i for x in owners.values() for i in sorted(x)], dtype=np.int64)
    return Phrases(vocabulary, patterns, lengths, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), items, pa.array(names, pa.string()))


def _runs(inside: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true within documents, of least length."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[at] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1] = after[-1:] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... size[0] of them, then those of lo[1]."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def occurrences(w: W.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in the documents of w: word index and phrase."""
    none = np.zeros(0, np.int64)
    if not len(p.patterns) or not len(w.hashes):
        return none, none
    ids = np.minimum(np.searchsorted(p.vocabulary, w.hashes), len(p.vocabulary) - 1)
    inside = p.vocabulary[ids] == w.hashes
    starts, ends = _runs(inside, w.at, int(p.lengths.min()))
    found = []
    i = 0
    while i < len(starts):
        filled = np.cumsum(ends[i:] - starts[i:] + 1)
        j = i + max(1, int(np.searchsorted(filled, INDEX_WORDS, side="right")))
        size = ends[i:j] - starts[i:j]
        word = _ranges(starts[i:j], size)
        to = np.arange(len(word)) + np.repeat(np.arange(j - i), size)  # one separator after each run
        text = np.zeros(len(word) + (j - i), dtype=np.int64)
        origin = np.zeros(len(text), dtype=np.int64)
        text[to], origin[to] = ids[word] + 1, word
        index = FMIndex(text, len(p.vocabulary) + 1)
        lo, hi = index.search(p.patterns + 1, p.lengths)
        hit = np.flatnonzero(hi > lo)
        size = hi[hit] - lo[hit]
        found.append((origin[index.locate(_ranges(lo[hit], size))], np.repeat(hit, size)))
        i = j
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (none, none)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def scan(text: pa.Array, p: Phrases) -> pa.Array:
    """FOUND for each text."""
    w = W.split(text, W.ALNUM)
    at, phrase = occurrences(w, p)
    change = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + p.lengths[phrase] if len(at) else at, -1)
    starts, ends = _runs(np.cumsum(change[:-1]) > 0, w.at, 1)
    doc = np.searchsorted(w.at, starts, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(starts - w.at[doc]), pa.array(ends - w.at[doc])], names=["start", "stop"])
    pair = np.unique(np.stack([np.searchsorted(w.at, at, side="right") - 1, phrase]), axis=1)
    size = p.item_at[pair[1] + 1] - p.item_at[pair[1]] if pair.size else np.zeros(0, np.int64)
    item = np.unique(np.stack([np.repeat(pair[0], size), p.items[_ranges(p.item_at[pair[1]], size)]]), axis=1) if size.sum() else np.zeros((2, 0), np.int64)
    n = len(text)
    return pa.StructArray.from_arrays(
        [pa.array(w.counts, pa.int64()), _lists(spans, np.bincount(doc, minlength=n)), _lists(p.names.take(pa.array(item[1], pa.int64())), np.bincount(item[0].astype(np.int64), minlength=n))],
        names=["n_words", "spans", "items"],
    )


def _digest(items: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(",".join(sorted(x or [])).encode()).hexdigest() for x in items.to_pylist()], pa.string())


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS):
    """Blocks of items whose texts have at most about block_words words together, one item at least."""
    rows, size = [], 0
    picked = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    for r in picked.toLocalIterator():  # one partition at a time
        n = len(r.t or "") // 2 + 1  # words at most
        if rows and size + n > block_words:
            yield phrases(rows)
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += n
    yield phrases(rows)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _joined(found: list[pa.Array]) -> pa.Array:
    """FOUND of several blocks of phrases for the same texts, as one."""
    rows = [[x.as_py() for x in f] for f in found]
    out = []
    for same in zip(*rows, strict=True):
        spans = _merged([(s["start"], s["stop"]) for x in same for s in x["spans"]])
        out.append({"n_words": same[0]["n_words"], "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted({i for x in same for i in x["items"]})})
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
    return pa.array(out, kind)


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "found", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column of FOUND, in place of any that docs has of that name: number of words, merged spans of hit words, item ids.
    Further blocks of a large benchmark are passes over the corpus, each with its own broadcast."""
    spark = tune(docs.sparkSession)
    names = []
    for k, p in enumerate(blocks(benchmark, block_words=block_words)):
        sent = spark.sparkContext.broadcast(p)
        docs = docs.withColumn(f"__hits_{k}", arrow(lambda text, sent=sent: scan(text, sent.value), FOUND)(F.col(text_col).cast("string")))
        names.append(f"__hits_{k}")
        if k:
            docs = docs.withColumn(names[0], arrow(lambda a, b: _joined([a, b]), FOUND)(F.col(names[0]), F.col(names[k]))).drop(names[k])
            docs = saved(docs, "hits")
    return docs.drop(out).withColumnRenamed(names[0], out)


def n_hit(found: str):
    return F.aggregate(F.col(found)["spans"], F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, hit words, items, their digest, and whether it is contaminated."""
    f = hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text")
    f = f.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit("found").alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"), arrow(_digest, T.StringType())("found.items").alias("items_sha256"))
    return f.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, as they are."""
    f = hits(docs, benchmark, text_col, "__found").withColumn("__n_hit", n_hit("__found"))
    return f.where(~((F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__found.n_words")))).drop("__found", "__n_hit")


def _cut(text: pa.Array, found: pa.Array) -> pa.Array:
    data, offsets = W.utf8(text)
    w, out = W.split(text, W.ALNUM), []
    for k, f in enumerate(found.to_pylist()):
        if not text[k].is_valid:
            out.append(None)
            continue
        at, parts = int(offsets[k]), []
        for s in f["spans"]:
            parts.append(data[at : w.starts[w.at[k] + s["start"]]].tobytes())
            at = int(w.ends[w.at[k] + s["stop"] - 1])
        out.append(b"".join([*parts, data[at : offsets[k + 1]].tobytes()]).decode())
    return pa.array(out, pa.string())


def cut(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the removal spans cut out of their texts."""
    f = hits(docs, benchmark, text_col, "__found")
    return f.withColumn(text_col, arrow(_cut, T.StringType())(F.col(text_col).cast("string"), F.col("__found"))).drop("__found")
