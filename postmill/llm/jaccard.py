"""N-gram Jaccard join as a blocked sparse matrix product (operator 7).

The document by n-gram incidence matrix is multiplied with its transpose only where a pair can
reach the threshold:

1. All grams are counted, as sorted arrays dealt by ranges of hashes. Those that COMMON texts or more hold, or as many
   more as bring them down to MAX_COMMON, fix one order of all grams: rare ones first, by powers of two. The result
   is exact for any such order.
2. Equal sets are one row, named by a 64-bit key of the set. A row keeps the first grams in
   that order, as many as a partner must share one of, and BANDS hashes of pairs of minima.
3. Clusters are collapsed first: rows that share a band are joined to the least of them, connected
   ones are a group, and each block of a group, with one row that all its blocks have, is multiplied.
   That is linear in the rows. Rows linked so far have one label; what this misses, the next steps find.
   Rows have met if they are in one group of a single block, whose pairs are all decided, or have one label.
4. Postings of the first grams are dealt by gram as packed arrays. Pairs of rows that haven't met accumulate
   how many of their first grams they share; those whose sizes, places or number of shared grams rule
   the threshold out are dropped. For grams of more than LONG texts, by their count or by their list, each member is paired
   with the least one only; lists whose rows have all met are left out.
5. Connected rows of those pairs make groups. The whole sets of a group are split into
   blocks, and each pair of blocks is a task that accumulates overlap counts by sparse
   products, drops pairs below the size-derived bound and returns a spanning forest of the links.
6. Components of all links are the classes. No link between different sets is lost.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their
own class; a text of fewer than five words is one gram; repeated rows and equal sets are one
class; a class is named by its least non-null id (null if it has none); an empty table gives none.
Rows that share an id, or have none, count each by its own text. Different sets are told apart by 64-bit hashes of
their grams. A class of any size is spread over tasks: sums are combined before they are dealt, and joins on labels
have a table on either side, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm import words as W
from postmill.llm.components import components
from postmill.llm.session import arrow, discard, partitions, release, saved, tune

GRAM = 5
#: Similarity at which rows link, as a fraction.
NUM, DEN = 80, 100
#: The count from which grams are ordered, and how many may be.
COMMON, MAX_COMMON = 4, 1_000_000
#: Grams counted, or postings packed, at once in a task.
FLUSH = 2_000_000
#: The longest list of postings, and the greatest count, whose pairs are formed.
LONG = 64
#: Rows and grams of one task's sets; a larger group is split into blocks of half of that.
TASK_ROWS, TASK_GRAMS = 2048, 4_000_000
#: Candidate ids, or labels, that may be broadcast.
MAX_BROADCAST = 500_000
#: Hashes of two minima each that collapse clusters.
BANDS = 4

LONGS = T.ArrayType(T.LongType())
FIRST = T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("grams", LONGS), T.StructField("bands", LONGS)])


def sets(text: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of all texts, ascending in each, the offsets of each text, and its key."""
    w = W.split(text)
    h, start = W.windows(w, gram)
    doc = np.searchsorted(w.at, start, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < gram))
    if len(short):
        alone = np.array([W.windows(W.Words(w.hashes[w.at[i] : w.at[i + 1]], np.array([0, w.counts[i]]), w.starts, w.ends), int(w.counts[i]))[0][0] for i in short], dtype=W.U64)
        h, doc = np.concatenate([h, W.fmix(alone ^ W.PLACE[63])]), np.concatenate([doc, short])
    at = np.zeros(len(text) + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=len(text)), out=at[1:])
    out, keys, size = [], np.zeros(len(text), dtype=W.U64), np.zeros(len(text), dtype=np.int64)
    h = h[np.argsort(doc, kind="stable")] if len(short) else h
    with np.errstate(over="ignore"):
        for i in range(len(text)):
            own = np.unique(h[at[i] : at[i + 1]])
            out.append(own)
            size[i] = len(own)
            keys[i] = W.fmix(W.fmix(own ^ W.PLACE[62]).sum(dtype=W.U64) + W.U64(len(own)) * W.PLACE[61])
    return np.concatenate(out) if out else np.zeros(0, W.U64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), keys


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fewest shared grams at which rows of sizes a and b link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix(n: np.ndarray) -> np.ndarray:
    """How many of a row's first grams a partner must share one of."""
    return np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)


def _counted(shards: int):
    """Counts of the grams of a task's texts, equal texts once, as parts (grams ascending, counts) of each shard."""

    def told(held):
        g, n = np.unique(np.concatenate(held), return_counts=True)
        by = ((g >> W.U64(32)) * W.U64(shards) >> W.U64(32)).astype(np.int64)
        ends = np.searchsorted(by, np.arange(shards + 1))
        full = [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        return pa.record_batch({"shard": pa.array([s for s, _, _ in full], pa.int32()), "part": pa.array([g[a:b].tobytes() + n[a:b].astype(np.int32).tobytes() for _, a, b in full], pa.binary())})

    def f(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            g, at, keys = sets(batch.column(0))
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    seen.add(k)
                    held.append(g[at[i] : at[i + 1]])
                    size += len(held[-1])
            if size >= FLUSH:
                yield told(held)
                seen, held, size = set(), [], 0
        if size:
            yield told(held)

    return f


def _summed(batches):
    """Grams of COMMON texts or more, and log2 of how many."""
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(s, []).append(x)
    for s in sorted(by):
        parts = by.pop(s)
        g = np.concatenate([np.frombuffer(x, W.U64, len(x) // 12) for x in parts])
        n = np.concatenate([np.frombuffer(x, np.int32, offset=len(x) // 12 * 8) for x in parts])
        order = np.argsort(g)
        g, n = g[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        n = np.add.reduceat(n, start)
        often = n >= COMMON
        yield pa.record_batch({"gram": pa.array(g[start][often].view(np.int64)), "c": pa.array(np.log2(n[often]).astype(np.int32))})


def common_grams(docs: DataFrame, text_col: str, parts: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The common grams, ascending, and the class (log2 of the count) of each."""
    told = docs.select(F.col(text_col).cast("string")).mapInArrow(_counted(4 * parts), "shard int, part binary")
    told = saved(told.repartition(parts, "shard").mapInArrow(_summed, "gram bigint, c int"), "common")
    release(docs.sparkSession)
    least, room = 0, MAX_COMMON if most is None else most
    for r in told.groupBy("c").count().orderBy(F.desc("c")).collect():  # 64 rows at most
        room -= r["count"]
        if room < 0:
            least = r["c"] + 1
            break
    got = told.where(F.col("c") >= least).toArrow()  # MAX_COMMON rows of two numbers
    discard(told)
    g, c = got.column("gram").to_numpy().view(W.U64), got.column("c").to_numpy()
    order = np.argsort(g)
    return g[order], c[order].astype(np.int8)


def _classes(g: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    names, c = common
    if not len(names):
        return np.zeros(len(g), np.int8)
    k = np.minimum(np.searchsorted(names, g), len(names) - 1)
    return np.where(names[k] == g, c[k], np.int8(0))


def _often(g: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether so many texts hold a gram that its pairs aren't formed."""
    return _classes(g, common) >= math.log2(LONG)


def bands(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each set: BANDS hashes, each of the set's minima under two orders of all grams."""
    full = np.diff(at) > 0
    out = np.zeros((len(full), BANDS), dtype=W.U64)
    if not full.any():
        return out
    with np.errstate(over="ignore"):
        least = [np.minimum.reduceat(g * W.PLACE[30 + k], at[:-1][full]) for k in range(2 * BANDS)]
        for b in range(BANDS):
            out[full, b] = W.fmix(least[2 * b] + W.fmix(least[2 * b + 1]) + W.PLACE[b])
    return out


def _first(text: pa.Array, common: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    g, at, keys = sets(text)
    n, minima = np.diff(at), bands(g, at)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((_classes(g, common), doc))  # stable: grams ascend within a class
    place = np.arange(len(g)) - np.repeat(at[:-1], n)
    p = prefix(n)
    g = g[order][place < np.repeat(p, n)]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]), pa.int32()), pa.array(g.view(np.int64)))
    own = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(minima.ravel().view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(keys.view(np.int64)), lists, own], names=["n", "key", "grams", "bands"])


def _packed(common: tuple[np.ndarray, np.ndarray], shards: int):
    """Postings (gram, key, size, place, met) of a task's rows, packed by shard. A row that has met itself only has
    a positive size; only the names of others' meetings are packed."""

    def dealt(held):
        gram, key, n, place, met = (np.concatenate(x) for x in zip(*held, strict=True))
        # Common grams are not paired where they meet, so their postings need not meet.
        by = np.where(_often(gram, common), W.fmix(gram ^ key), W.fmix(gram)) % W.U64(shards)
        order = np.argsort(by, kind="stable")
        ends = np.cumsum(np.bincount(by.astype(np.int64), minlength=shards))
        gram, key, place, met = gram[order], key[order], place[order].astype(np.int32), met[order]
        n = np.where(met != key, -n[order], n[order]).astype(np.int32)
        full = [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)) if b > a]
        parts = [np.int64(b - a).tobytes() + b"".join(x[a:b].tobytes() for x in (gram, key, n, place)) + met[a:b][n[a:b] < 0].tobytes() for _, a, b in full]
        return pa.record_batch({"shard": pa.array([s for s, _, _ in full], pa.int32()), "part": pa.array(parts, pa.binary())})

    def f(batches):
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            keys, n, lists, mets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            fresh = []
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if fresh:
                own = lists.take(pa.array(fresh))
                count = pc.list_value_length(own).to_numpy()
                where = np.repeat(np.array(fresh), count)
                gram = own.flatten().to_numpy().view(W.U64)
                held.append((gram, keys[where].view(W.U64), n[where], np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count), mets[where].view(W.U64)))
                size += len(gram)
            if size >= FLUSH:
                yield dealt(held)
                seen, held, size = set(), [], 0
        if size:
            yield dealt(held)

    return f


def _unpacked(parts: list[bytes]):
    out = []
    for x in parts:
        m = int(np.frombuffer(x, np.int64, 1)[0])
        gram, key, n, place = np.frombuffer(x, W.U64, m, 8), np.frombuffer(x, W.U64, m, 8 + 8 * m), np.frombuffer(x, np.int32, m, 8 + 16 * m), np.frombuffer(x, np.int32, m, 8 + 20 * m)
        met = key.copy()
        met[n < 0] = np.frombuffer(x, W.U64, offset=8 + 24 * m)
        out.append((gram, key, np.abs(n), place, met))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _candidates(common: tuple[np.ndarray, np.ndarray]):
    """Pairs (kind 0) of rows that haven't met in a shard's short lists, with how many first grams they share there, and whether
    one of those may be the first of enough; members (kind 1: gram, key, met, whether it is common) of common and long ones."""

    def paired(parts):
        gram, key, n, place, met = _unpacked(parts)
        order = np.lexsort((key, gram))
        gram, key, n, place, met = gram[order], key[order], n[order].astype(np.int64), place[order].astype(np.int64), met[order]
        fresh = np.ones(len(gram), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
        gram, key, n, place, met = gram[fresh], key[fresh], n[fresh], place[fresh], met[fresh]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(np.concatenate([start, [len(gram)]]))
        common_here = _often(gram[start], common)
        mixed = np.minimum.reduceat(met, start) != np.maximum.reduceat(met, start)
        hot = common_here | (mixed & (size > LONG))
        member = np.repeat(hot, size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        short = ~hot & mixed
        for m in np.unique(size[short]):
            i, j = np.triu_indices(int(m), 1)
            at = start[short & (size == m)][:, None]
            left.append((at + i).ravel())
            right.append((at + j).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        other = met[a] != met[b]
        a, b = a[other], b[other]
        sized = (DEN * n[a] >= NUM * n[b]) & (DEN * n[b] >= NUM * n[a])
        a, b = a[sized], b[sized]
        swap = key[a] > key[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        able = np.minimum(n[a] - place[a], n[b] - place[b]) >= least_overlap(n[a], n[b])
        order = np.lexsort((key[b], key[a]))
        a, b, able = a[order], b[order], able[order]
        first = np.flatnonzero(np.concatenate([[True], (key[a][1:] != key[a][:-1]) | (key[b][1:] != key[b][:-1])])) if len(a) else np.zeros(0, np.int64)
        shared = np.diff(np.concatenate([first, [len(a)]])) if len(a) else first
        any_able = np.logical_or.reduceat(able, first) if len(a) else np.zeros(0, bool)
        rest = np.minimum(n[a] - place[a], n[b] - place[b]) - 1  # falls along the common order, so the least is that of the last shared gram
        rest = np.minimum.reduceat(rest, first) if len(a) else rest
        a, b = a[first], b[first]
        m = int(member.sum())
        cols = {
            "kind": np.concatenate([np.zeros(len(a), np.int32), np.ones(m, np.int32)]),
            "a": np.concatenate([key[a], gram[member]]).view(np.int64),
            "b": np.concatenate([key[b], key[member]]).view(np.int64),
            "na": np.concatenate([n[a], n[member]]),
            "nb": np.concatenate([n[b], n[member]]),
            "shared": np.concatenate([shared, np.zeros(m, np.int64)]),
            "rest": np.concatenate([rest, np.zeros(m, np.int64)]),
            "able": np.concatenate([any_able, np.repeat(common_here, size)[member]]),
            "met": np.concatenate([key[a], met[member]]).view(np.int64),
        }
        return pa.record_batch({k: pa.array(v) for k, v in cols.items()})

    def f(batches):
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(s, []).append(x)
        for s in sorted(by):
            yield paired(by.pop(s))

    return f


def _pairs(found: DataFrame) -> DataFrame:
    """Pairs of short lists that may still link, by two bounds of their overlap.

    Say the first grams of one row end before those of the other: all its shared ones among them are first grams of the
    other too, so the overlap is at most those plus the rest of that row. And what is shared beyond the last
    gram that they share in a short list is at most what either row has beyond it. Long lists may hide shared grams
    before that one, common grams only after it."""
    members = found.where("kind = 1").select(F.col("b").alias("key"), "able")
    hot = members.groupBy("key").agg(F.count("*").alias("hot"), F.count_if(~F.col("able")).alias("long"))
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("shared").alias("shared"), F.min("rest").alias("rest"), F.bool_or("able").alias("able"))
    least = f"(({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN})"
    for x in "ab":
        pairs = pairs.where("able").join(hot.select(F.col("key").alias(x), F.col("hot").alias(f"hot_{x}"), F.col("long").alias(f"long_{x}")), x, "left")
    past = lambda n: f"(({NUM} * {n} + {DEN - 1}) div {DEN} - 1)"
    hidden = lambda k: f"least(coalesce({k}_a, 0), coalesce({k}_b, 0))"
    pairs = pairs.where(f"shared + {hidden('hot')} + greatest({past('na')}, {past('nb')}) >= {least}")
    return pairs.where(f"shared + {hidden('long')} + rest >= {least}").select("a", "b")


def product(rows: list[np.ndarray], first: np.ndarray, second: np.ndarray, known: np.ndarray | None = None, met: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of the first block and rows of the second (masks); rows
    known to be connected have equal labels, and pairs of equal met are decided already. Overlaps of one row with all others
    are accumulated from the postings of its grams."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    gram, name, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    order = np.argsort(name, kind="stable")
    posted = owner[order]
    at = np.concatenate([[0], np.cumsum(often)])
    mine = np.split(name, np.cumsum(size)[:-1])
    label = np.arange(len(rows)) if known is None else known.copy()
    links = []
    for i in np.flatnonzero(first):
        other = second & (label != label[i]) & (DEN * size >= NUM * size[i]) & (NUM * size <= DEN * size[i])
        if met is not None:
            other &= met != met[i]
        if not other.any():
            continue
        own = mine[i][often[mine[i]] > 1]
        n = often[own]
        flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[own], n)
        overlap = np.bincount(posted[flat], minlength=len(rows))
        for j in np.flatnonzero(other & (overlap >= least_overlap(size[i], size))):
            if label[j] != label[i]:
                links.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return links


def _multiplied(batches):
    """Links of each task (group, i, j) of block pairs; rows come sorted by task."""

    def done(rows):
        keys = np.array([r[1] for r in rows])
        keys, pick = np.unique(keys, return_index=True)
        own = [rows[p] for p in pick]
        in_i = np.array([r[2] in (r[0][1], None) for r in own])
        in_j = np.array([r[2] in (r[0][2], None) for r in own])
        known = np.unique(np.array([r[3] for r in own]), return_inverse=True)[1]
        met = np.array([r[4] for r in own])
        return [(int(keys[a]), int(keys[b])) for a, b in product([np.frombuffer(r[5], W.U64) for r in own], in_i, in_j, known, met)]

    def told(out):
        return pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    task, rows, out = None, [], []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(7)]
        lists = batch.column(7)
        for k, (group, i, j, key, block, label, met) in enumerate(zip(*cols, strict=True)):
            if (group, i, j) != task:
                if rows:
                    out += done(rows)
                task, rows = (group, i, j), []
            rows.append((task, key, block, label, met, lists[k].as_py()))
        if len(out) > 10_000:
            yield told(out)
            out = []
    if rows:
        out += done(rows)
    yield told(out)


def _reread(batches):
    """Whole sets of the rows wanted, each once a task. Columns: text, the key wanted, what goes with it."""
    seen: set[int] = set()
    for batch in batches:
        g, at, keys = sets(batch.column(0))
        keys, own = keys.view(np.int64).tolist(), batch.column(1).to_pylist()
        pick = []
        for i, k in enumerate(own):
            if keys[i] == k and k not in seen:
                seen.add(k)
                pick.append(i)
        rest = batch.select(list(range(1, batch.num_columns))).take(pa.array(pick, pa.int64()))
        grams = pa.array([g[at[i] : at[i + 1]].tobytes() for i in pick], pa.binary())
        yield pa.RecordBatch.from_arrays([*rest.columns, grams], names=[*rest.schema.names, "grams"])


def _linked(own: DataFrame, wanted: DataFrame, parts: int, name: str) -> DataFrame:
    """Links (a, b) that the products find. wanted: key, rep (the least id of its documents), group, label, met, block,
    and the tasks ``to`` (pairs of blocks) that its set goes to; block is null for a row of every block."""
    spark = own.sparkSession
    # One document of each key is read again. Its id finds it, and its key tells it from others of that id; where no
    # document of a key has an id, those without are searched by the key alone.
    few = wanted.count() <= MAX_BROADCAST
    rows = wanted.select(F.col("key").alias("own"), "rep", "group", "label", "met", "block", "to")
    kind = "own bigint, `group` bigint, label bigint, met bigint, block int, `to` array<struct<i: int, j: int>>, grams binary"
    columns = ["text", "own", "group", "label", "met", "block", "to"]
    ids = rows.where("rep is not null")
    found = own.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("rep")).select(*columns).mapInArrow(_reread, kind)
    nameless = rows.where("rep is null")
    if not nameless.isEmpty():
        key = arrow(lambda text: pa.array(sets(text)[2].view(np.int64)), T.LongType())
        again = own.where("doc_id is null").select("text", key("text").alias("k")).join(F.broadcast(nameless) if few else nameless, F.col("k") == F.col("own"))
        found = found.union(again.select(*columns).mapInArrow(_reread, kind))
    tasks = found.withColumn("t", F.explode("to")).select("group", "t.i", "t.j", F.col("own").alias("key"), "block", "label", "met", "grams")
    links = saved(tasks.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "key").mapInArrow(_multiplied, "a bigint, b bigint"), name)
    release(spark)
    return links


def _blocked(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (key, n, group, ...) with the number of blocks of the group, and each row's block; and the saved table of sizes."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    whole_task = (F.col("rows") <= TASK_ROWS) & (F.col("grams") <= TASK_GRAMS)
    blocks = F.greatest(F.ceil(2 * F.col("rows") / TASK_ROWS), F.ceil(2 * F.col("grams") / TASK_GRAMS))
    sizes = saved(sizes.select("group", F.when(whole_task, 1).otherwise(blocks).cast("int").alias("blocks")), "sizes")
    return groups.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), sizes


def _collapsed(own: DataFrame, distinct: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Links within clusters, in linear work: not all of them; and (key, group) of those whose pairs within a group are
    all decided. distinct: key, n, rep, bands."""
    hashes = distinct.select("key", F.posexplode("bands").alias("band", "value"))
    least = hashes.groupBy("band", "value").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    least = saved(least.select("band", "value", "least"), "bands")
    groups = components(hashes.join(least, ["band", "value"]).where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")))
    wanted = groups.withColumnRenamed("node", "key").withColumnRenamed("label", "group").join(distinct.select("key", "n", "rep"), "key")
    grouped = saved(wanted, "grouped")
    wanted, sizes = _blocked(grouped)
    hub = F.col("key") == F.col("group")  # a group is named by one of its rows
    spots = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    to = F.transform(spots, lambda x: F.struct(x.alias("i"), x.alias("j")))
    wanted = saved(wanted.select("key", "rep", "group", F.col("key").alias("label"), F.col("key").alias("met"), F.when(~hub, F.col("block")).alias("block"), to.alias("to"), "blocks"), "wanted")
    links = _linked(own, wanted, parts, "cluster-links")
    decided = saved(wanted.where("blocks = 1").select("key", "group"), "decided")
    discard(least, groups, grouped, sizes, wanted)
    return links, decided


def _named(own: DataFrame) -> DataFrame:
    """(doc_id, n, key, label) of every row; rows of one class have one label. own: doc_id, text."""
    spark = tune(own.sparkSession)
    parts = partitions(own)
    common = common_grams(own, "text", parts)
    sent = spark.sparkContext.broadcast(common)  # MAX_COMMON grams at most
    first = saved(own.select("doc_id", arrow(lambda t: _first(t, sent.value), FIRST)("text").alias("s")).select("doc_id", "s.*"), "first-grams")
    distinct = saved(first.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    links, decided = _collapsed(own, distinct, parts)
    linked = components(links).withColumnRenamed("node", "key")
    labels = saved(decided.join(linked, "key", "full").select("key", F.coalesce("label", "key").alias("label"), F.coalesce("group", "label").alias("met")), "labels")

    few = labels.count() <= MAX_BROADCAST
    met = labels.select("key", "met")
    rows = first.where("n > 0").select("key", "n", "grams").join(F.broadcast(met) if few else met, "key", "left")
    rows = rows.select("key", "n", "grams", F.coalesce("met", "key").alias("met"))
    postings = rows.mapInArrow(lambda b: _packed(sent.value, 8 * parts)(b), "shard int, part binary")
    found = saved(postings.repartition(parts, "shard").mapInArrow(lambda b: _candidates(sent.value)(b), "kind int, a bigint, b bigint, na bigint, nb bigint, shared bigint, rest bigint, able boolean, met bigint"), "candidates")
    release(spark)
    members = found.where("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("key"), "met")
    least = saved(members.groupBy("gram").agg(F.min("key").alias("least"), F.min("met").alias("l"), F.max("met").alias("m")).where("l < m").select("gram", "least"), "least")
    stars = members.join(least, "gram").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    groups = components(_pairs(found).union(stars))  # node: key, label: group
    discard(found, least)

    wanted = groups.withColumnRenamed("node", "key").withColumnRenamed("label", "group").join(distinct.select("key", "n", "rep"), "key")
    wanted = wanted.join(F.broadcast(labels) if few else labels, "key", "left").withColumn("label", F.coalesce("label", "key")).withColumn("met", F.coalesce("met", "key"))
    grouped = saved(wanted, "grouped")
    wanted, sizes = _blocked(grouped)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    wanted = saved(wanted.select("key", "rep", "group", "label", "met", "block", pairs.alias("to")), "wanted")
    more = _linked(own, wanted, parts, "links")
    discard(linked)
    linked = components(links.union(more)).withColumnRenamed("node", "key")

    named = first.select("doc_id", "n", "key").join(linked, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = saved(named, "named")
    discard(first, distinct, decided, labels, grouped, sizes, wanted, links, more, groups, linked)
    return named


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    named = _named(_own(docs, id_col, text_col))
    least = saved(named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    full = named.where("n > 0").join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, as it is: that of the least id, or without any id where the class has none, and of
    several such with different sets that of the least key. Documents with the empty set are no copies and all stay."""
    named = _named(_own(docs, id_col, text_col))
    best = saved(named.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best")), "best")
    out = named.where("n > 0").join(best, "label").where("not (doc_id <=> best.doc_id and key = best.key)")
    out = saved(out.select(F.col("doc_id").alias("__jaccard_id"), F.col("key").alias("__jaccard_key")).distinct(), "dropped")
    # Where an id names one row, it decides alone; rows that share one, or have none, are told apart by their keys.
    shared = saved(named.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__jaccard_id")), "shared")
    plain = out.where("__jaccard_id is not null").join(shared, "__jaccard_id", "left_anti").select("__jaccard_id")
    single = docs.where(F.col(id_col).isNotNull()).join(plain, F.col(id_col) == F.col("__jaccard_id"), "left_anti")
    nameless = docs.where(F.col(id_col).isNull())
    if shared.isEmpty():
        if named.where("doc_id is null").isEmpty():
            return single
        several = nameless
    else:
        several = docs.join(shared, F.col(id_col) == F.col("__jaccard_id"), "left_semi").union(nameless)
        single = single.join(shared, F.col(id_col) == F.col("__jaccard_id"), "left_anti")
    key = T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.LongType())])
    several = several.withColumn("__jaccard_set", arrow(_set_key, key)(F.col(text_col).cast("string")))
    empty = several.where("__jaccard_set.n = 0").drop("__jaccard_set")
    full = several.where("__jaccard_set.n > 0").join(out, F.col(id_col).eqNullSafe(F.col("__jaccard_id")) & (F.col("__jaccard_set.key") == F.col("__jaccard_key")), "left_anti")
    return single.union(empty).union(full.withColumn("__jaccard_key", F.col("__jaccard_set.key")).dropDuplicates([id_col, "__jaccard_key"]).drop("__jaccard_set", "__jaccard_key"))


def _set_key(text: pa.Array) -> pa.Array:
    _, at, keys = sets(text)
    return pa.StructArray.from_arrays([pa.array(np.diff(at)), pa.array(keys.view(np.int64))], names=["n", "key"])
