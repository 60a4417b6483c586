"""Operators 1, 2, 3, 7, 9 and the pipeline on small tables, against brute force."""

import hashlib
import io
import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postmill.llm import jaccard, mixing, ngram_lm, urlfilter, warc
from postmill.llm.queries import QUERIES, SQL
from postmill.llm.components import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


# --- 1


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    rng = random.Random(5)
    rules = [(f"{rng.choice('abcdef')}{i % 9}.{t}", f"/{rng.choice('xyz')}" * (i % 3), rng.choice(["allow", "block"])) for i, t in enumerate(["com", "net", "a0.com"] * 60)]
    rules = list({r[:2]: r for r in [*rules, ("com", "/", "allow"), ("", "", "allow")]}.values())
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'w.', 'A.b.'])}{rng.choice('abcdef')}{rng.randrange(9)}.{rng.choice(['com', 'NET', 'a0.com'])}{rng.choice(['', '/', '/x', '/x/x', '/y/z?q', '#/x'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://x", "http://", "http://" + "a." * 5000 + "com/x", "x://b1.com/x://y", urls[0]]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    df = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, df).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in urlfilter.judge(pages, df.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), df).count() == 0


def test_canonical_urls(spark):
    same = {
        "http://example.com/": ["HTTP://Example.COM", "http://user:pw@example.com:80/", "http://example.com.", "http://example.com:/#top", "http://example.com?", "http://example.com/a/.."],
        "https://example.com/a/b?q=%2F~": ["https://example.com:443/a/./x/../b?q=%2f%7e", "https://example.com/%61/b?q=%2F~#f", "https://example.com/../a/b?q=%2F~"],
        "http://example.com:443/A%20%zz/": ["http://example.com:443/A%20%zz/", "http://EXAMPLE.com:443/A%20%zz/b/%2e%2E"],
        "ftp://h/a/.b/..c": ["FTP://h/a/.b/..c"],
    }
    cases = [(u, want) for want, us in same.items() for u in [want, *us]] + [(None, None), ("", None), ("no scheme", None)]
    got = spark.createDataFrame(cases, "url string, want string").select("url", "want", urlfilter.canonical(F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == [(r.url, r.want) for r in got]


def test_listed_urls_win_over_rules(spark):
    pages = spark.createDataFrame([(0, "http://a.com/x/../y"), (1, "http://a.com/y/more"), (2, "https://b.com:443"), (3, None), (None, "http://a.com/y"), (5, "HTTP://A.com/y#z"), (6, "plain")], "page_id bigint, url string").withColumn("key", F.lit("clash"))
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([("http://a.com/y", "allow"), ("https://B.com/", "allow"), ("https://b.com", "block"), ("no", "block"), (None, "block"), ("http://a.com/y", None)], "url string, verdict string")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in urlfilter.judge(pages, rules, urls=urls).collect())
    y, b = ("http://a.com/y", "allow"), ("https://b.com/", "block")
    assert got == [("0", *y), ("1", "com/", "block"), ("2", *b), ("3", None, "allow"), ("5", *y), ("6", None, "allow"), ("None", *y)]
    assert {r.rule for r in urlfilter.judge(pages, rules, urls=urls.limit(0)).collect()} == {"com/", None}
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0), urls=urls).collect()} == {"allow", "block"}


def test_rules_before_listed_urls(spark):
    pages = spark.createDataFrame([(0, "http://a.com/x/../y"), (1, "http://b.net/y#z"), (2, "http://b.net/z"), (3, None), (None, "HTTP://B.net:80/y")], "page_id bigint, url string")
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    urls = spark.createDataFrame([("http://a.com/y", "block"), ("http://b.net/y", "block")], "url string, verdict string")
    got = sorted((str(r.page_id), r.rule, r.verdict, r.listed) for r in urlfilter.judge(pages, rules, urls=urls, rules_first=True).collect())
    b = (None, "block", "http://b.net/y")
    assert got == [("0", "com/", "allow", "http://a.com/y"), ("1", *b), ("2", None, "allow", None), ("3", None, "allow", None), ("None", *b)]
    none = urlfilter.judge(pages, rules.limit(0), urls=urls.limit(0), rules_first=True).collect()
    assert len(none) == 5 and {(r.rule, r.verdict, r.listed) for r in none} == {(None, "allow", None)}


def test_the_query_on_urls_in_many_forms_is_its_sql(spark, tmp_path):
    import duckdb

    hosts = ["Example.COM", "u:p@example.org:80", "b.net.", "x.org:443", "b.net:8080", "a.b.net"]
    ways = ["", "/", "/fr/a", "/a/./b/../c", "/..", "/%7e/%2f", "/A%20%zz", "/en/..?q=%41", "?", "#top", "/x/%2E%2e?%"]
    urls = [f"{s}://{h}{w}" for s in ("http", "HTTPS", "ftp") for h in hosts for w in ways] + [None, "", "no scheme", "http://b.net/é%C3%A9"]
    spark.createDataFrame(list(enumerate(urls * 2)), "page_id bigint, url string").withColumn("html", F.lit("")).write.parquet(f"{tmp_path}/pages.parquet")
    d = duckdb.connect()
    d.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = d.execute(SQL["op1_url_filter"])
    names = [x[0] for x in want.description]
    got = [tuple(r[n] for n in names) for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall())) and len({r[names.index("listed")] for r in got}) > 5


def test_rules_of_many_lengths(spark):
    rules = [(f"{'h' * (i % 40 + 1)}{i}.com", "/" + "p" * (i * 7 % 300), "block" if i % 2 else "allow") for i in range(4_000)]
    urls = [f"http://www.{h}{p}/more" for h, p, _ in rules[::50]] + [f"http://x{h}{p}" for h, p, _ in rules[::90]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judged(u, rules)[2:] for i, u in enumerate(urls)}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    table, blocks = urlfilter.bloom(keys, "key", 2000)
    other = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert urlfilter.possible(keys, "key", table, blocks).count() == 2000
    assert urlfilter.possible(other, "key", table, blocks).count() < 200


# --- 2


def test_warc(spark, tmp_path):
    html = "<html><title>A &amp; B</title><script>var x='<p>';</script><style>p{}</style><!-- no --><body><p>One  two</p><p>Three&nbsp;<a href='x'>four</a></p></body></html>"
    pages = spark.createDataFrame([(1, "http://a/x", html), (2, None, None), (3, "http://b", ""), (4, "http://c", "é<br>☃" * 20_000), (1, "http://a/x", html)], "page_id bigint, url string, html string").withColumn("block", F.lit("clash"))
    source = warc.responses(pages)
    out = warc.derive(source).collect()
    assert len(out) == 10
    one = {r.record_type: r for r in out if r.page_id == 1}
    assert one["conversion"].block == "A & B\nOne two\nThree four"
    assert "links: 1\r\n" in one["metadata"].block and "title: A &amp; B\r\n" in one["metadata"].block
    ids = {r.page_id: r.record_id for r in source.collect()}
    assert all(r.refers_to == ids[r.page_id] and r.content_length == len(r.block.encode()) and r.source_headers.startswith("HTTP/1.1") for r in out)
    # Exact round trip through gzip members, and through a file.
    blob = b"".join(bytes(r.member) for r in warc.serialised(warc.derive(source)).orderBy("page_id", "record_type").select("member").collect())
    back = warc.members(io.BufferedReader(io.BytesIO(blob)))
    want = sorted(out, key=lambda r: (r.page_id, r.record_type))
    assert [(h["warc-type"], h["warc-record-id"].strip("<>"), h["warc-refers-to"].strip("<>"), h["warc-block-digest"], b.decode()) for h, b in back] == [(r.record_type, r.record_id, r.refers_to, r.block_digest, r.block) for r in want]
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {}\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    (tmp_path / "a.warc").write_bytes(head.format(len(body)).encode() + body + b"\r\n\r\n")
    read = warc.parse(spark, str(tmp_path))
    r = read.first()
    assert (r.record_type, r.record_id, r.http_headers, r.payload) == ("response", "urn:x", "HTTP/1.1 200 OK\r\nX: y", "<p>hi</p>")
    assert warc.derive(read, ()).where("record_type = 'conversion'").first().block == "hi"
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


# --- 3


def test_weights():
    tokens = {"a": 1000, "b": 100, "c": 10, "none": 0}
    x, w = mixing.weights(tokens, mixing.Target(entropy=0.9, repetitions=100))
    h = -sum(p * math.log2(p) for p in w.values())
    assert 0 < x < 1 and abs(sum(w.values()) - 1) < 1e-9 and abs(h - 0.9 * math.log2(3)) < 1e-6 and "none" not in w
    _, w = mixing.weights(tokens, mixing.Target(entropy=1.0, repetitions=3))
    assert max(w[s] * 1110 / tokens[s] for s in w) <= 3 + 1e-9
    x, w = mixing.weights(tokens, mixing.Target(entropy=0.0))
    assert x == 1.0 and w == pytest.approx({s: n / 1110 for s, n in tokens.items() if n})
    # A budget that the limit doesn't allow falls to what it does, with normalised weights.
    x, w = mixing.weights(tokens, mixing.Target(entropy=0.9, repetitions=2, budget=10**12))
    assert mixing.affordable(sum(tokens.values()), mixing.Target(repetitions=2, budget=10**12)) == 2 * sum(tokens.values())
    assert abs(sum(w.values()) - 1) < 1e-9 and all(abs(w[s] - n / sum(tokens.values())) < 1e-9 for s, n in tokens.items() if n)
    assert mixing.weights({}, mixing.Target()) == (1.0, {}) and mixing.weights({"a": 5}, mixing.Target())[1] == {"a": 1.0}


def test_mixing(docs_of):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), "en", "big" if i % 3 else f"s{i % 7}") for i in range(900)]
    rows += [(2000, None, "en", "big"), (2001, "", "en", "s1"), (2002, "x y", "en", None), (2003, " a\tb\x0bc ", "en", "big"), (5, rows[5][1], "en", rows[5][3])]
    docs = docs_of(rows, ("epoch", "block", "bucket", "order"))
    target = mixing.Target(entropy=0.97, repetitions=2.5)
    got = mixing.mix(docs, target, block_tokens=2000).collect()
    supply = Counter()
    for _, t, _, s in rows:
        supply[s] += len(words_of(t))
    _, w = mixing.weights({s: n for s, n in supply.items()}, target)
    budget, dealt, per_block = sum(supply.values()), Counter(), defaultdict(Counter)
    for r in got:
        dealt[r.source] += r.n_tokens
        per_block[r.block][r.source] += r.n_tokens
    for s, p in w.items():
        assert 0 <= dealt[s] - round(p * budget) < 30
    assert len(per_block) == -(-budget // 2000)
    for b in per_block.values():
        assert all(abs(b[s] - p * budget / len(per_block)) < 62 for s, p in w.items())
    # Every earlier repetition is whole, and each row is dealt once in it.
    for s in w:
        epochs = Counter(r.epoch for r in got if r.source == s)
        n = sum(1 for r in rows if r[3] == s and words_of(r[1]))
        assert all(k == n for e, k in epochs.items() if e < max(epochs))
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5), target, block_tokens=2000).collect()))
    assert mixing.mix(docs_of([])).count() == 0 and mixing.mix(docs_of([(1, " ", "en", "a")])).count() == 0


# --- 7


def shingles(t):
    w = words_of(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)]


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("tight", [False, True])
def test_jaccard(docs_of, monkeypatch, tight):
    rng = random.Random(7)
    if tight:  # small limits, so that common grams, long lists and several blocks all occur
        for k, v in {"LONG": 3, "COMMON": 6, "MAX_COMMON": 40, "TASK_ROWS": 7, "FLUSH": 900}.items():
            monkeypatch.setattr(jaccard, k, v)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    texts = []
    for n in (1, 2, 3, 12, 40):
        base = [rng.choice(vocabulary) for _ in range(120)]
        texts += [near(rng, base, rng.randrange(0, 7)) for _ in range(n)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 150]))]) for _ in range(25)]
    texts += [texts[0]] * 4 + [texts[0].upper().replace(" ", "\n"), None, "", " \t", "a", "A", "a b", "a b c d e", "x " * 3000, "x " * 2000, "x x x x x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[3], (None, texts[0]), (None, None)]
    got = Counter(tuple(r) for r in jaccard.classes(docs_of(rows, ("key", "n", "label", "grams", "group"))).collect())
    assert got == Counter(classes(rows))


def test_jaccard_of_missing_and_repeated_ids(docs_of):
    rng = random.Random(17)
    base = [[f"b{k}_{i}" for i in range(120)] for k in range(4)]
    rows = [(None, near(rng, base[0], 1)), (None, near(rng, base[0], 1)), (4, near(rng, base[0], 1))]
    rows += [(k, near(rng, base[1], 1)) for k in (5, 6)] + [(k, near(rng, base[2], 1)) for k in (5, 6)]
    rows += [(5, near(rng, base[3], 1)), (None, near(rng, base[3], 1)), (None, "of no other's words at all")]
    got = Counter(tuple(r) for r in jaccard.classes(docs_of(rows)).collect())
    assert got == Counter(classes(rows))
    assert sum(n for (_, _, component), n in got.items() if component == 4) == 3


def test_jaccard_keeps_one_of_each_class(docs_of):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(3, t), (1, t), (2, "other text of some words here"), (2, "other text of some words here"), (None, t), (4, None), (5, "")]
    out = jaccard.keep(docs_of(rows, ("component_id",)))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "4", "5"] and out.columns[-1] == "component_id"
    assert jaccard.classes(docs_of([])).count() == 0


def test_jaccard_keeps_by_id_and_text(docs_of):
    a, b, c, d = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    one = lambda words, k: " ".join([*words[:-1], f"z{k}"])
    rows = [(0, one(c, 0)), (1, one(c, 0)), (1, one(b, 0)), (2, one(a, 0)), (2, one(a, 1)), (2, one(d, 0)), (None, one(d, 1)), (None, None), (None, "lone words")]
    rows += [(None, "null ids only, with enough words"), (None, "null ids only, with enough words"), (2, ""), (2, "")]
    left = Counter((r.doc_id, r.text) for r in jaccard.keep(docs_of(rows)).collect())
    own = Counter(rows)
    assert all(n <= own[r] for r, n in left.items())
    assert left[(0, one(c, 0))] == 1 and left[(1, one(c, 0))] == 0 and left[(1, one(b, 0))] == 1  # a copy goes, its namesake stays
    assert left[(2, one(a, 0))] + left[(2, one(a, 1))] == 1 and left[(2, one(d, 0))] == 1 and left[(None, one(d, 1))] == 0
    assert left[(None, None)] == 1 and left[(None, "lone words")] == 1 and left[(None, "null ids only, with enough words")] == 1 and left[(2, "")] == 2
    assert jaccard.keep(docs_of([])).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300)]
    up = {x: x for e in edges for x in e}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        up[top(a)] = top(b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == set(up)
    assert len({(top(x), got[x]) for x in up}) == len({top(x) for x in up}) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 2, bytes that are no UTF-8


def test_warc_keeps_headers_and_digests(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{}>\r\n{}Content-Length: {}\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nX: caf\xe9\r\n\r\n<p>caf\xe9</p>"
    with (tmp_path / "a.warc").open("wb") as out:
        for name, said in (("a", ""), ("b", "WARC-Payload-Digest: sha1:ABC\r\n")):
            out.write(head.format(name, said, len(body)).encode() + body + b"\r\n\r\n")
    made = warc.serialised(warc.derive(warc.parse(spark, str(tmp_path)), ()))
    back = warc.members(io.BufferedReader(io.BytesIO(b"".join(bytes(r.member) for r in made.collect()))))
    raw = "sha256:" + hashlib.sha256(b"<p>caf\xe9</p>").hexdigest()
    assert sorted((h["warc-refers-to"], h["warc-source-payload-digest"]) for h, _ in back) == [("<urn:a>", raw)] * 2 + [("<urn:b>", "sha1:ABC")] * 2
    assert {json.loads(h["warc-source-http-headers"]) for h, _ in back} == {"HTTP/1.1 200 OK\r\nX: caf\xe9"}
    assert all(b"source-content-length: 11\r\n" in b for h, b in back if h["warc-type"] == "metadata")


# --- 9


def test_kneser_ney(docs_of):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("a b c d e f g h i j k l m n o p".split()[: 3 + i % 14]) for i in range(n))
    train = [(i, say(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "The  A\tthe"), (102, "The  A\tthe"), (103, "z" * 40_000)]
    test = train[:10] + [(200, "unseen words a b"), (201, None), (202, "q " * 5000)]
    model = ngram_lm.fit(docs_of(train, ("score", "t")))
    c1, c2, ctx = Counter(), Counter(), Counter()
    for _, t in train:
        w = [*words_of(t), "</s>"]
        c1.update(w)
        c2.update(zip(["<s>", *w], w, strict=False))
        ctx.update(["<s>", *w][:-1])
    cc = Counter(w for _, w in c2)
    n, v = c1.total(), len(c1)
    assert (model.tokens, model.kinds, model.pairs, model.texts) == (n, v, len(c2), len(train))
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, e = ngram_lm.discounts(*of(c2)), ngram_lm.discounts(*of(cc))
    rest = sum(e[min(x, 3) - 1] for x in cc.values()) / len(c2)

    def p(u, w):
        low = (max(cc[w] - e[min(cc[w], 3) - 1], 0) if cc[w] else 0) / len(c2) + rest / (v + 1)
        if not ctx[u]:
            return low
        left = sum(d[min(x, 3) - 1] for (a, _), x in c2.items() if a == u) / ctx[u]
        return (max(c2[u, w] - d[min(c2[u, w], 3) - 1], 0) if c2[u, w] else 0) / ctx[u] + left * low

    assert abs(sum(p("a", w) for w in c1) + p("a", "<unk>") - 1) < 1e-9
    got = ngram_lm.score(docs_of(test, ("score", "s")), model)
    found = {r.doc_id: r for r in got.collect()}
    for i, t in test:
        w = [*words_of(t), "</s>"]
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c1[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w, strict=False)), rel_tol=1e-9)
    few = ngram_lm.perplexity(ngram_lm.score(docs_of(train[:60]), model)).first()
    assert few.perplexity < few.base_perplexity
    empty = ngram_lm.fit(docs_of([]))
    assert ngram_lm.score(docs_of([(1, "a b"), (2, None)]), empty).agg(F.sum("score"), F.sum("base_score")).first()[:] == (0.0, 0.0)


@pytest.mark.parametrize("order", [3, 4])
def test_kneser_ney_of_longer_contexts(docs_of, order):
    rng = random.Random(order)
    often, rare = "a b c d e".split(), [f"w{n}" for n in range(60)]  # of hot words, and of others
    train = [(i, " ".join(rng.choice(often if rng.random() < 0.8 else rare) for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(100, None), (101, "a b c d"), (102, "d c b a")]
    test = train[:20] + [(200, "a unseen b c d e"), (201, None), (202, "e e e e e e")]
    model = ngram_lm.fit(docs_of(train), order=order)
    raw = {k: Counter() for k in range(1, order + 1)}
    for _, t in train:
        w = ["<s>", *words_of(t), "</s>"]
        for k in raw:
            raw[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    number = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        number[k] = Counter(g[1:] for g in raw[k + 1]) + Counter({g: n for g, n in raw[k].items() if k > 1 and g[0] == "<s>"})
    d = {k: ngram_lm.discounts(*(sum(x == m for x in c.values()) for m in (1, 2, 3, 4))) for k, c in number.items()}

    def p(ctx, w):
        own = {g: n for g, n in number[len(ctx) + 1].items() if g[:-1] == ctx}
        low = p(ctx[1:], w) if ctx else 1 / (len(raw[1]) - 1 + 1)
        if not own:
            return low
        n, total, off = own.get((*ctx, w), 0), sum(own.values()), d[len(ctx) + 1]
        return (n and max(n - off[min(n, 3) - 1], 0)) / total + sum(off[min(x, 3) - 1] for x in own.values()) / total * low

    assert abs(sum(p(("a", "b", "c")[: order - 1], w) for (w,) in raw[1] if w != "<s>") + p(("a", "b", "c")[: order - 1], "<unk>") - 1) < 1e-9
    found = {r.doc_id: r.score for r in ngram_lm.score(docs_of(test), model).collect()}
    for i, t in test:
        w = ["<s>", *words_of(t), "</s>"]
        assert math.isclose(found[i], sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w))), rel_tol=1e-9)


def test_kneser_ney_counts_few_long_texts(spark, docs_of):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        for order in (2, 3):
            assert ngram_lm.fit(docs_of([(1, " ".join(f"w{i % 700}" for i in range(1400)))]), order=order).texts == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


# --- pipeline


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
            assert counts[-1] <= counts[-2]
    assert 0 < counts[4] < counts[0]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == Counter(tuple(r) for r in docs.collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, docs_of, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    base = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{base}/documents.parquet").orderBy("doc_id").first().text
    rows = [(1, None), (2, ""), (3, " \n"), (None, text), (None, None), (5, text), (5, text), (6, "x " * 60_000), (7, "lone")]
    clash = ("found", "score", "kept", "key", "label", "n", "component_id", "epoch", "block", "s", "y")
    got = stage(spark, docs_of(rows, clash), base)
    own = Counter(r for r in rows)
    if k < 4:
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
        left = Counter((r.doc_id, r.text) for r in got.collect())
        assert all(n <= own[r] for r, n in left.items())
        if name == "ngram_jaccard":
            assert left == Counter({(1, None): 1, (2, ""): 1, (3, " \n"): 1, (None, None): 1, (5, text): 1, (6, "x " * 60_000): 1, (7, "lone"): 1})
    else:
        assert {r.doc_id for r in got.collect()} <= {None, 5, 6, 7}
    assert stage(spark, docs_of([], clash), base).count() == 0


def test_warc_files_with_codings_and_damage(spark, tmp_path):
    import gzip
    import zlib

    html = "<p>h\xe9</p>"
    chunks = b"4\r\n<p>h\r\n6;x=1\r\n\xc3\xa9</p>\r\n0\r\n\r\n"
    bare = zlib.compressobj(wbits=-15)
    cases = {
        "gzip": ("Content-Encoding: gzip", gzip.compress(html.encode())),
        "raw": ("Content-Encoding: deflate", bare.compress(html.encode()) + bare.flush()),
        "zlib": ("Content-Encoding: deflate", zlib.compress(html.encode())),
        "chunked": ("Transfer-Encoding: chunked", chunks),
        "undone": ("Transfer-Encoding: chunked", html.encode()),
        "latin": ("Content-Type: text/html; charset=ISO-8859-1", html.encode("latin-1")),
        "meta": ("X: y", b"<meta charset='latin-1'>" + html.encode("latin-1")),
        "odd": ("Content-Type: text/html; charset=nope", html.encode()),
        "br": ("Content-Encoding: br", b"\x0b\x02"),
        "broken": ("Content-Encoding: gzip", b"\x1f\x8bxx"),
        "empty": ("Content-Encoding: gzip", b""),
    }

    def record(name, kind, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    made = [record(k, "response", f"HTTP/1.1 200 OK\r\n{h}\r\n\r\n".encode() + b) for k, (h, b) in cases.items()]
    first = record("info", "warcinfo", b"software: x") + record("ask", "request", b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(first + b"".join(made))
    (tmp_path / "b.warc").write_bytes(record("before", "response", b"HTTP/1.1 200 OK\r\n\r\nok") + b"junk\r\n")
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("zipped", "response", b"HTTP/1.1 200 OK\r\n\r\nok")) + gzip.compress(b"x" * 999)[:-9])
    (tmp_path / "d.warc").write_bytes(record("cut", "response", b"HTTP/1.1 200 OK\r\n\r\nlong")[:-6])
    (tmp_path / "e.warc").write_bytes(b"")
    got = {r.record_id: r for r in warc.parse(spark, str(tmp_path)).collect()}
    assert set(got) == {*cases, "before", "zipped"} and {r.record_type for r in got.values()} == {"response"}
    assert {k: r.payload for k, r in got.items()} == {**dict.fromkeys(cases, html), "meta": "<meta charset='latin-1'>" + html, "br": None, "broken": None, "empty": "", "before": "ok", "zipped": "ok"}
    assert all(got[k].payload_length == len(b) and got[k].payload_digest == "sha256:" + hashlib.sha256(b).hexdigest() for k, (_, b) in cases.items())
    bad = sorted((r.path.rsplit("/", 1)[1], r.record_id) for r in warc.damaged(spark, str(tmp_path)).collect())
    assert bad == [("a.warc", "br"), ("a.warc", "broken"), ("b.warc", None), ("c.warc.gz", None), ("d.warc", None)]
    assert warc.derive(warc.parse(spark, str(tmp_path)), ()).count() == 26
