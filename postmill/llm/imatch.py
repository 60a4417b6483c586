"""Document fingerprints by I-Match (operator 11), in DataFrame functions only.

Terms are lower-cased ASCII-separated words. Those whose inverse document frequency, in bits, lies within a band make the
lexicon: too common terms say nothing, too rare ones break a fingerprint at every slip. Each of many randomised subsets of the
lexicon, some dense and some sparse, gives one hash: that of the text's distinct terms in the subset, sorted. A fingerprint is the list of these
hashes, each after its subset's number, of all subsets that have a term of the text, and the likeness of two is the share of equal ones among the subsets in which either text has a term. Sparse subsets
survive large edits and long texts, dense ones tell short texts apart.

The band bounds the lexicon: at most mean distinct terms a text x 2^most terms have that frequency, whatever the number of texts. It is
broadcast while its rows, which are counted, are below BROADCAST_TERMS, and joined by a shuffle beyond.

Defined results: a null text is an empty one; texts without any term of a subset (empty ones too) get ``ff`` and the hash of all their distinct
terms, which is like nothing but itself. Equal texts have equal fingerprints. Documents stand in the order of falling doc_id, null
ids last, then of the text's hash; after the last comes the first. Rows with the same id and text are one document in that order, and each gives a row of
the result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.session import discard, partitions, release, saved

#: Least and most bits of inverse document frequency: terms of at most a quarter and at least a 2,048th of all documents.
BAND = (2, 11)
#: One term in so many is in a subset, and so many subsets of that kind.
SUBSETS = ((32, 8), (128, 24), (512, 40), (2048, 24))
#: Rows of a lexicon that is broadcast; some hundred bytes each.
BROADCAST_TERMS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hex digits of a subset's number and of its hash, and what stands for the number where all terms are hashed.
NUMBER, DIGITS, NO_SUBSET = 2, 4, "ff"


def terms(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SEPARATORS)), "")


def rates(subsets=SUBSETS) -> list[int]:
    return [rate for rate, n in subsets for _ in range(n)]


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[int, int] = BAND, subsets=SUBSETS) -> DataFrame:
    """(term, subsets): the terms within the band, with the numbers, two hex digits, of the subsets that each is in."""
    n, of = docs.count(), rates(subsets)
    found = docs.select(F.explode(terms(F.col(text_col).cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    found = found.where((F.col("df") * 2 ** band[0] <= n) & (F.col("df") * 2 ** band[1] >= n))
    # A digest of 32 digits has the draws of eight subsets, four digits each; a term is in a subset where they are below 1 / rate.
    digests = F.transform(F.sequence(F.lit(0), F.lit((len(of) - 1) // 8)), lambda k: F.md5(F.concat("term", F.lit(":"), k.cast("string"))))
    below = F.array(*[F.lit(f"{(1 << 16) // rate:04x}") for rate in of])
    drawn = lambda d, k: F.filter(F.sequence(k * 8, k * 8 + 7), lambda j: F.substring(d, (j - k * 8) * 4 + 1, F.lit(4)) < F.get(below, j))
    names = F.array(*[F.lit(f"{j:02x}") for j in range(len(of))])
    return found.select("term", F.transform(F.flatten(F.transform(digests, drawn)), lambda j: F.get(names, j)).alias("subsets"))


def whole(text: Column) -> Column:
    """What stands for the hashes of a text without terms of any subset."""
    return F.concat(F.lit(NO_SUBSET), F.md5(F.array_join(F.sort_array(terms(text)), " ")))


def likeness(a: Column, b: Column) -> Column:
    x, y = (F.regexp_extract_all(c, F.lit(f".{{{NUMBER + DIGITS}}}"), F.lit(0)) for c in (a, b))
    subsets = lambda c: F.transform(c, lambda t: F.left(t, F.lit(NUMBER)))
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(subsets(x), subsets(y)))
    return F.when(a == b, F.lit(1.0)).when(F.startswith(a, F.lit(NO_SUBSET)) | F.startswith(b, F.lit(NO_SUBSET)), F.lit(0.0)).otherwise(share)


#: The key of a document, of the next one and of the one before: no id, the falling id, the text's hash. Never null, and plain
#: columns, so that one exchange serves all joins and groups.
KEY, NEXT, BEFORE = ([f"{x}_{i}" for i in ("last", "down", "hash")] for x in ("own", "next", "before"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = i.isNull(), F.coalesce(F.bitwise_not(i), F.lit(0).cast("bigint")), F.xxhash64(text)
    return docs.select(*[c.alias(n) for c, n in zip(parts, KEY, strict=True)], text.alias("text"))


def _renamed(of: list[str], to: list[str]) -> list[Column]:
    return [F.col(a).alias(b) for a, b in zip(of, to, strict=True)]


def _ring(keyed: DataFrame) -> DataFrame:
    """Every document's key with its copies, its neighbours' keys in the order, which closes to a ring, and before_n, the length of the one before. Only
    keys and lengths move, into ranges; where a range ends, the first of the next range follows."""
    keys = keyed.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max(F.char_length("text")).alias("n"))
    ranged = saved(keys.repartitionByRange(*KEY).withColumn("p", F.spark_partition_id()), "ranged")
    me = F.struct(*KEY, "n")
    ends = ranged.groupBy("p").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    line, all_ = Window.orderBy("p"), Window.partitionBy(F.lit(0))  # a row for each range
    ends = ends.select("p", F.coalesce(F.lead("first").over(line), F.min("first").over(all_)).alias("after"), F.coalesce(F.lag("last").over(line), F.max("last").over(all_)).alias("ahead"))
    own = Window.partitionBy("p").orderBy(*KEY)
    near = ranged.withColumns({"f": F.lead(me).over(own), "b": F.lag(me).over(own)}).join(F.broadcast(ends), "p")
    f, b = F.coalesce("f", "after"), F.coalesce("b", "ahead")
    of = lambda x, names: [x[k].alias(n) for k, n in zip(KEY, names, strict=True)]
    out = saved(near.select(*KEY, "copies", *of(f, NEXT), *of(b, BEFORE), b["n"].alias("before_n")), "ring")
    discard(ranged)
    release(keyed.sparkSession)
    return out


def prints(docs: DataFrame, lex: DataFrame, id_col: str = "doc_id", text_col: str = "text", subsets=SUBSETS) -> DataFrame:
    """Fingerprints, as bytes, of all texts and of their edited texts, the last half of each replaced by the start of the next document's."""
    keyed = _keyed(docs, id_col, text_col)
    ring = _ring(keyed)
    # One exchange of all texts by their key, read by every branch below; only the starts that others need move again.
    texts = keyed.repartition(partitions(docs) * 4, *KEY).dropDuplicates(KEY)
    placed = texts.join(ring, KEY)
    given = placed.select(*_renamed(BEFORE, KEY), F.left("text", F.floor(F.col("before_n") / 2).cast("int")).alias("given"))
    n = F.char_length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.col("given"))

    words = texts.join(given, KEY).select(*KEY, F.explode(F.array(F.struct(F.lit(False).alias("e"), terms(F.col("text")).alias("w")), F.struct(F.lit(True).alias("e"), terms(edited).alias("w")))).alias("x"))
    words = words.select(*KEY, "x.e", F.explode("x.w").alias("term"))
    hits = words.join(F.broadcast(lex) if lex.count() <= BROADCAST_TERMS else lex, "term").select(*KEY, "e", F.explode("subsets").alias("s"), "term")
    hashed = hits.groupBy(*KEY, "e", "s").agg(F.left(F.md5(F.array_join(F.sort_array(F.collect_list("term")), " ")), F.lit(DIGITS)).alias("hash"))
    listed = lambda e: F.array_join(F.sort_array(F.collect_list(F.when(F.col("e") == e, F.concat("s", "hash")))), "")
    told = hashed.groupBy(*KEY).agg(F.nullif(listed(False), F.lit("")).alias("own"), F.nullif(listed(True), F.lit("")).alias("other"))
    facts = placed.join(given, KEY).join(told, KEY, "left")
    done = facts.select(
        *KEY, *NEXT, "copies", n.cast("bigint").alias("n_chars"), F.unhex(F.sha2(edited, 256)).alias("edited_sha256"),
        F.unhex(F.coalesce("own", whole(F.col("text")))).alias("fingerprint"), F.unhex(F.coalesce("other", whole(edited))).alias("edited_fingerprint"),
    )
    out = saved(done, "prints")
    discard(ring)
    release(docs.sparkSession)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[int, int] = BAND, subsets=SUBSETS) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and how like it is to that and to the next document's."""
    lex = saved(lexicon(docs, text_col, band, subsets), "lexicon")
    release(docs.sparkSession)
    found = prints(docs, lex.where(F.size("subsets") > 0), id_col, text_col, subsets)
    discard(lex)
    rows = found.join(found.select(*_renamed(KEY, NEXT), F.col("fingerprint").alias("following")), NEXT)
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint", "following")}
    rows = rows.withColumns(hexed).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        F.when(~F.col(KEY[0]), F.bitwise_not(F.col(KEY[1]))).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
