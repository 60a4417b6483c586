"""URL filter by a blocked Bloom filter and an exact hash join (operator 1).

Two lists: rules, a host and a beginning of a path, fit their host and all subdomains; and, where the caller has them, exact
URLs, compared in canonical form. Candidates of a URL are its host's suffixes and, of hosts that rules name, the path
beginnings of the lengths that rules of that host have; and the URL's own canonical form. Each kind of candidate
passes a blocked Bloom filter (one block of 512 bits for each key), and possible hits go to an exact
hash join with the list, which removes false positives. A listed URL wins over rules, unless the caller puts rules first, and of rules the longest. URLs that
nothing fits get the filter's own verdict: not listed, hence allowed.

A filter is a table (block, eight words). It is broadcast where its size allows, as is the list of hosts; beyond
MAX_BROADCAST_MB they are joined by shuffle. Distinct hosts and paths are looked up once.

Defined results: a URL that is null or lacks ``://`` has an empty host and path, no canonical form, fits no rule but
one of an empty host and path, and else is allowed; of equal rules or URLs with different verdicts the one that blocks wins;
null ones are left out; an empty rule table allows everything; repeated rows are judged each on their own and alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each rule, and bits that a key sets in its block.
BITS, HASHES = 16, 6
MAX_BROADCAST_MB = 64


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bits (0 to 511) there."""
    h = F.xxhash64(key, F.lit(1))
    g = F.xxhash64(key, F.lit(2))
    return F.pmod(h, F.lit(blocks)), [F.shiftrightunsigned(g, 9 * k).bitwiseAND(F.lit(511)) for k in range(HASHES)]


def bloom(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """The filter of n distinct keys as a table (block, w0 .. w7), and its number of blocks."""
    blocks = max(1, math.ceil(n * BITS / 512))
    block, bits = _bits(F.col(key), blocks)
    ones = keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    words = [F.bit_or(F.when(F.shiftright("bit", 6) == k, F.expr("shiftleft(1L, int(bit & 63))")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(8)]
    return ones.groupBy("block").agg(*words), blocks


def possible(rows: DataFrame, key: str, table: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter may hold."""
    block, bits = _bits(F.col(key), blocks)
    small = blocks * 72 <= MAX_BROADCAST_MB << 20
    both = rows.withColumn("block", block).join(F.broadcast(table) if small else table, "block")
    test = F.lit(True)
    for b in bits:
        word = F.element_at(F.array(*[F.col(f"w{k}") for k in range(8)]), (F.shiftright(b, 6) + 1).cast("int"))
        test = test & (F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return both.where(test).select(*rows.columns)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _percent(c: Column) -> Column:
    """Escapes of unreserved characters decoded, the others in upper case; a bare percent sign stays."""

    def one(x: Column) -> Column:
        code, rest = F.conv(F.left(x, F.lit(2)), 16, 10).cast("int"), F.substr(x, F.lit(3))
        said = F.char(code)
        return F.when(~x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), x)).when(said.rlike("[A-Za-z0-9._~-]"), F.concat(said, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.left(x, F.lit(2))), rest))

    parts = F.split(c, "%")
    return F.when(F.contains(c, F.lit("%")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))).otherwise(c)


def _undotted(path: Column) -> Column:
    """The path without its segments ``.`` and ``..``."""
    steps = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    last = F.element_at(steps, -1).isin(".", "..")
    whole = F.concat(F.lit("/"), F.array_join(F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no user, default port, last dot of the host, fragment or empty query; escapes and dot
    segments resolved, ``/`` for an empty path. Null without ``://``."""

    def named(scheme: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(host_of(url), "(?s)^.*@", ""), ":$", "")
        port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise("$^")
        return F.concat(scheme, F.lit("://"), F.regexp_replace(F.regexp_replace(host, port, ""), r"\.(?=:\d+$|$)", ""))

    site = _bound(lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), named)
    path = _bound(_bound(path_of(url), _percent), _undotted)
    query = _bound(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]+)", 1), _percent)
    return F.when(F.contains(url, F.lit("://")), F.concat(site, _bound(path, lambda p: F.when(p == "", "/").otherwise(p)), query))


def _ends(host: Column, longest: int) -> Column:
    """The host and its suffixes at dots, of at most ``longest`` characters."""
    labels = F.split(F.right(host, F.lit(longest + 1)), r"\.")
    first = F.when(F.length(host) > longest, 2).otherwise(1)  # what is cut off ends within a label, or at its dot
    ends = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(first <= F.size(labels), ends).otherwise(F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= MAX_BROADCAST_MB << 20 else df


def _by_rules(own: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """(host, path, best) of the distinct hosts and paths that rules fit."""
    hosts = listed.groupBy("rule_host").agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"))  # a path's lengths are few
    size = hosts.agg(F.count("*").alias("n"), F.max(F.length("rule_host")).alias("longest"), F.sum(F.size("lengths")).alias("cells"), F.sum(F.octet_length("rule_host")).alias("bytes")).first()
    seen = own.select("host", "path").distinct()
    ends = seen.withColumn("rule_host", F.explode(_ends(F.col("host"), size.longest)))
    ends = possible(ends, "rule_host", *bloom(hosts, "rule_host", size.n))
    ends = ends.join(_small(hosts, 1, size.n * 64 + size.cells * 8 + size.bytes), "rule_host")
    tries = F.transform(F.filter("lengths", lambda p: p <= F.length("path")), lambda p: F.concat("rule_host", F.lit("\n"), F.left("path", p)))
    tried = ends.select("host", "path", F.explode(tries).alias("key"))
    hits = possible(tried, "key", *bloom(listed, "key", n)).join(listed, "key")
    rule = F.concat("rule_host", "rule_path")
    # At equal lengths, which cannot be of one URL unless hosts and paths differ, the longer host wins.
    return hits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), "verdict")).alias("best"))


def _by_urls(own: DataFrame, urls: DataFrame) -> DataFrame:
    """own, which has its url's canonical form as key, with ``exact``: the verdict of the listed URL that equals it, else null."""
    listed = urls.where("verdict is not null").select(canonical(F.col("url").cast("string")).alias("key"), "verdict").where("key is not null").groupBy("key").agg(F.max("verdict").alias("exact"))
    size = listed.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    if not size.n:
        return own.withColumn("exact", F.lit(None).cast("string"))
    found = possible(own.where("key is not null").select("key").distinct(), "key", *bloom(listed, "key", size.n)).join(listed, "key")
    # Rows without a canonical form never meet in one task.
    none = own.where("key is null").withColumn("exact", F.lit(None).cast("string"))
    return own.where("key is not null").join(_small(found, 1, size.n * 64 + size.bytes), "key", "left").select(*none.columns).unionByName(none)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", urls: DataFrame | None = None, rules_first: bool = False) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict. rules: host, path, verdict (allow or block). urls: url, verdict; a page
    whose URL equals one of them has its canonical form as rule. With rules_first the list decides only where no rule does,
    rule is a rule's or null, and a last column, listed, has the canonical form of a listed URL."""
    listed = rules.where("host is not null and path is not null and verdict is not null")
    listed = listed.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block is the greater
    listed = listed.withColumn("key", F.concat("rule_host", F.lit("\n"), "rule_path"))
    n = listed.count()
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), *([] if urls is None else [canonical(url).alias("key")]))
    out = own if urls is None else _by_urls(own, urls)
    exact, key = (F.lit(None).cast("string"),) * 2 if urls is None else (F.col("exact"), F.when(F.col("exact").isNotNull(), F.col("key")))
    fit, said = F.col("best.rule"), F.col("best.verdict")
    if n:
        out = out.join(_by_rules(own, listed, n), ["host", "path"], "left")
    else:
        fit = said = F.lit(None).cast("string")
    rule, verdict = (fit, F.coalesce(said, exact)) if rules_first else (F.coalesce(key, fit), F.coalesce(exact, said))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"), *([key.alias("listed")] if rules_first else []))
