"""Order-dependent deduplication against a store.

Rows arrive in the order of ``seq``. A row merges into a stored row with its fingerprint, else its URL
key, else its id; a row that merges contributes no keys. So the rows that are stored are the
lexicographically first maximal independent set of the conflict graph. A pass looks at all keys of one
kind at once: rows are sorted by key and arrival, and the first row of a key needs to wait for it no longer. A row that waits for
none of its keys is stored, and what shares a key with it goes when that kind is looked at, at the latest. What a pass finds stays true, as rows only
go, so passes take kinds in turn, an exchange each. Where they settle too little, what is left falls apart into connected components of shared keys, which don't
touch one another: those of at most SHARE rows are dealt over tasks, each of which takes its rows in their order, the rule itself. Only larger components go
through further passes. A key that is alone in its kind is not looked at again; a row without any key conflicts with none.
A step ends in a written table; the shuffles of those before it are dropped, and tables that nothing reads any more are deleted, so that disk holds one step at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from postmill.functions.url import url_key
from postmill.runtime import discard, release, written

#: Keys in order of precedence.
KEYS = ("fingerprint", "url_key", "id")
#: Rows of a component that one task may settle, and about as many of all its components; with their keys some tens of megabytes.
SHARE = 200_000
#: Rows that a task of a pass sorts, rows that the passes of one job exchange if it has several, and buckets of hashes by which the rows of keys are counted.
ROWS, CHAIN, BUCKETS = 1_000_000, 2_000_000, 1 << 12


def with_url_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("url_key", url_key(F.col("apply_url"), F.col("resolved_domain")))


def _long(rows: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """(columns, kind, key): a row for each key that isn't null; kind is its place in the order of precedence."""
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(k).alias("key")) for n, k in enumerate(keys)])
    return rows.select(*columns, F.inline(each)).where("key is not null")


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """df as a written table, and as counted on the way: settled rows, undecided ones, and the kinds that still matter to any row."""
    seen = Observation()
    return written(df.observe(seen, F.count_if(F.col("tell") == 0).alias("settled"), F.count_if(F.col("tell") != 0).alias("n"), F.coalesce(F.bit_or("tell"), F.lit(0)).alias("kinds")), name), seen.get


def _open(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with two sets of kinds as bits: ``wait``, where an earlier row may hold the row's key, and ``tell``, where another row may have it."""
    own = sum(F.when(F.col(k).isNotNull(), 1 << n).otherwise(0) for n, k in enumerate(keys))
    return rows.select("seq", *keys, own.alias("wait"), own.alias("tell"))


def _hot(left: DataFrame, keys: tuple[str, ...], n: int, share: int) -> int:
    """The kinds, as bits, of which a key may have more than ``share`` rows; those left out have none, since keys are counted by buckets of hashes."""
    if n <= share:
        return 0
    buckets = [left.where(f"(tell & {1 << k}) <> 0").select(F.lit(k).alias("kind"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")) for k, key in enumerate(keys)]
    full = reduce(DataFrame.union, buckets).groupBy("kind", "bucket").count().where(F.col("count") > share + 2 * n // BUCKETS)
    return sum(1 << r.kind for r in full.select("kind").distinct().collect())


def _pass(left: DataFrame, keys: tuple[str, ...], k: int, n: int, hot: bool) -> DataFrame:
    """left after a look at all keys of one kind. The first row of a key waits for it no longer; if it waits for none, it is stored and the others of
    the key go. A key that is hot is no task of its own: its first row is aggregated and joined, which costs about twice the time."""
    key, bit = keys[k], 1 << k
    has, rest = f"(tell & {bit}) <> 0", "(held & ~{0}) = 0".format(bit)
    if hot:
        heads = left.where(has).groupBy(key).agg(F.min("seq").alias("head"), F.min_by("wait", "seq").alias("held"), (F.count("*") == 1).alias("alone"))
        seen = left.where(has).join(heads, key).withColumn("first", F.col("seq") == F.col("head"))
    else:
        group = (F.when(F.expr(has), F.col(key)), F.when(~F.expr(has), F.col("seq")))  # rows without the key are spread
        tasks = -(-n // ROWS)
        if tasks > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            left = left.repartition(tasks, *group)
        w = Window.partitionBy(*group).orderBy("seq")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = left.withColumns({"first": F.row_number().over(w) == 1, "held": F.first("wait").over(upto), "alone": F.lead("seq").over(w).isNull()})
    now = seen.where(f"first or not ({has}) or not ({rest})").select(
        "seq", *keys,
        F.expr(f"if({has} and first, wait & ~{bit}, wait)").alias("wait"),
        F.expr(f"if({has} and first and (alone or {rest}), tell & ~{bit}, tell)").alias("tell"),
    )
    return now.unionByName(left.where(f"not ({has})")) if hot else now


def components(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(seq, label): the least seq that shared keys lead to. Every pass takes the least label of all neighbours, lets the row that gave the
    old label have it too, and then takes that label's own label, so that passes grow with the logarithm of the longest way."""
    long = _long(rows, keys, "seq")
    least = long.groupBy("kind", "key").agg(F.min("seq").alias("other"))
    pairs = long.join(least, ["kind", "key"]).where("seq <> other").select("seq", "other").distinct()
    edges = written(pairs.select(F.explode(F.array(F.struct("seq", "other"), F.struct(F.col("other").alias("seq"), F.col("seq").alias("other")))).alias("e")).select("e.*"), "edges")
    labels = written(rows.select("seq", F.col("seq").alias("label")), "labels")
    release(rows.sparkSession)
    while True:
        after, n = _lower(edges, labels)
        discard(labels)
        release(rows.sparkSession)
        labels = after
        if not n:
            discard(edges)
            return labels


def _lower(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The labels after one pass, and how many it changed."""
    near = edges.join(labels.withColumnRenamed("seq", "other"), "other").groupBy("seq").agg(F.min("label").alias("near"))
    told = labels.join(near, "seq", "left")
    hook = told.where("near < label").groupBy(F.col("label").alias("seq")).agg(F.min("near").alias("hook"))  # a label hears of lower ones through all its rows
    lower = told.join(hook, "seq", "left").select("seq", "label", F.least("label", F.coalesce("near", "label"), F.coalesce("hook", "label")).alias("low"))
    jump = labels.select(F.col("seq").alias("low"), F.col("label").alias("next"))
    seen = Observation()
    moved = lower.join(jump, "low").select("seq", F.least("low", "next").alias("now"), "label").observe(seen, F.count_if(F.col("now") != F.col("label")).alias("n"))
    return written(moved.select("seq", F.col("now").alias("label")), "labels"), seen.get["n"]


def _in_order(rows: DataFrame, keys: tuple[str, ...], tasks: int) -> DataFrame:
    """The rows that are stored, found one after another within the tasks that hold their components."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: list[set] = [set() for _ in keys]
        for b in batches:
            kept = []
            for values in zip(*[b[k] for k in keys], strict=True):
                own = [(t, v) for t, v in zip(taken, values, strict=True) if not pd.isna(v)]
                free = not any(v in t for t, v in own)
                kept.append(free)
                if free:
                    for t, v in own:
                        t.add(v)
            yield b[kept].drop(columns="label")

    columns = rows.select("seq", *keys)
    return rows.select("seq", *keys, "label").repartition(tasks, "label").sortWithinPartitions("seq").mapInPandas(f, columns.schema)


def leaders(rows: DataFrame, keys: tuple[str, ...] = KEYS, share: int = SHARE) -> DataFrame:
    """The rows (seq and keys) that are stored when rows arrive by seq and nothing is stored before."""
    spark, done, left = rows.sparkSession, [], None

    def step(df: DataFrame) -> dict:
        """df becomes what is left, and the table before it goes; what df settles is stored."""
        nonlocal left
        table, seen = _kept(df, "undecided")
        if left is not None:
            discard(left)
        if seen["settled"] or not done:
            done.append(written(table.where("tell = 0").select("seq", *keys), "first"))
        release(spark)
        left = table.where("tell <> 0")
        return seen

    seen, hot, before = step(_open(rows, keys)), -1, None
    while n := seen["n"]:
        hot = hot and _hot(left, keys, n, share)  # keys only lose rows
        kinds = [k for k in (len(keys) - 1, *range(len(keys) - 1)) if seen["kinds"] >> k & 1]  # ids first, as they are mostly alone
        batch = 1 if hot else min(8, max(1, CHAIN // n))
        turns = kinds * max(1, batch // len(kinds))
        for i in range(0, len(turns), batch):
            df = left
            for k in turns[i : i + batch]:
                df = _pass(df, keys, k, seen["n"], bool(hot >> k & 1))
            seen = step(df)
        before, start, n = n, before, seen["n"]
        if start is None or not n or 6 * n <= 5 * before:  # passes that settle a sixth of the rows cost less than the search for components
            continue
        labels = components(left, keys)
        large = labels.groupBy("label").count().where(F.col("count") > share).select("label")
        placed = written(left.select("seq", *keys).join(labels, "seq").join(large.withColumn("large", F.lit(True)), "label", "left"), "placed")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // max(1, share)))
        discard(labels)
        release(spark)
        done.append(written(_in_order(placed.where("large is null"), keys, tasks), "settled"))
        seen, before = step(_open(placed.where("large"), keys)), None
        discard(placed)
    discard(left)
    return reduce(DataFrame.union, done)


def assign(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """incoming with ``target``: the id of the stored row, or ``seq`` (as new_seq) of the earlier arrival, that it merges
    into; both null for a row to insert. Both sides need scraped_at, id and the keys; incoming needs seq. Of the store only keys that arrive are looked at."""
    long = _long(incoming, keys, "seq")
    known = _long(stored.withColumn("stored_id", F.col("id")), keys, "stored_id", "scraped_at").join(long.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    known = known.groupBy("kind", "key").agg(F.min(F.struct("scraped_at", "stored_id")).alias("best"))
    hits = written(long.join(known, ["kind", "key"]).select("seq", "kind", F.col("best.stored_id").alias("target")), "hits")
    new = written(leaders(incoming.join(hits.select("seq"), "seq", "left_anti"), keys), "leaders")
    led = _long(new, keys, "seq").groupBy("kind", "key").agg(F.min("seq").alias("new_seq"))
    earlier = long.join(led, ["kind", "key"]).where("new_seq < seq")
    # The first kind of key decides; for one kind, what is stored comes before what is new.
    choice = F.struct("kind", F.col("new_seq").isNotNull().alias("new"), "target", "new_seq")
    both = hits.withColumn("new_seq", F.lit(None).cast("bigint")).unionByName(earlier.select("seq", "kind", F.lit(None).cast("string").alias("target"), F.col("new_seq").cast("bigint")))
    chosen = both.groupBy("seq").agg(F.min(choice).alias("best")).select("seq", "best.target", "best.new_seq")
    return incoming.join(chosen, "seq", "left")


def _told(assigned: DataFrame) -> DataFrame:
    """(id, new_time, new_sources) of every row that others merge into."""
    inserts = assigned.where("target is null and new_seq is null")
    name = inserts.select(F.col("seq").alias("new_seq"), F.col("id").alias("new_id"))
    merges = assigned.where("target is not null or new_seq is not null").join(name, "new_seq", "left").select(F.coalesce("target", "new_id").alias("id"), "seq", F.col("scraped_at").alias("t"), F.col("source").alias("s"))
    # The first arrival of each source counts for the order, the last arrival of all for the time.
    per = merges.groupBy("id", "s").agg(F.min("seq").alias("first"), F.max(F.struct("seq", "t")).alias("last"))
    told = per.groupBy("id").agg(F.max("last").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda x: x["s"]).alias("sources"))  # a row for each source
    return told.select("id", F.col("last.t").alias("new_time"), F.col("sources").alias("new_sources"))


def _after(rows: DataFrame, columns: list[str]) -> DataFrame:
    more = F.filter(F.coalesce("new_sources", F.array().cast("array<string>")), lambda s: s != F.col("source"))
    return rows.withColumns({"scraped_at": F.coalesce("new_time", "scraped_at"), "merged_sources": F.array_distinct(F.concat("merged_sources", more))}).select(*columns)


def _inserted(assigned: DataFrame, columns: list[str]) -> DataFrame:
    return assigned.where("target is null and new_seq is null").withColumn("merged_sources", F.array().cast("array<string>")).select(*columns)


def merged(assigned: DataFrame, stored: DataFrame) -> DataFrame:
    """The store after the arrivals: stored rows and inserted ones, each with the time of its last
    merge and the other sources that were merged into it, in order of arrival."""
    rows = stored.unionByName(_inserted(assigned, stored.columns))
    return _after(rows.join(_told(assigned), "id", "left"), stored.columns)


def changed(assigned: DataFrame, stored: DataFrame) -> DataFrame:
    """Of ``merged`` only the rows that the arrivals change or add."""
    told, columns = _told(assigned), stored.columns
    return _after(stored.join(told, "id"), columns).unionByName(_after(_inserted(assigned, columns).join(told, "id", "left"), columns))


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: the one-key case in one pass."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
