"""Operators 4, 5, 6, 8 and 10 on small tables, against brute force or held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import decontaminate, fmindex, langid, lengths, quality, toxicity
from postmill.llm import words as W

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASH = ("score", "kept", "s", "t", "i", "n_words", "found", "length", "y")
TEXTS = ["", None, "   \n\t ", "One", "a b c a b c a b c\nx\nx\n", "Ünïcode ☃ words\u00a0stay\r\nA", "z" * 70_000, "w " * 30_000, "#a *b $c\x0bd\x0ce", "same text", "same text"]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé☃ \t\n\x1c#1", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    w = W.split(pa.array(texts, pa.string()))
    seen = {}
    for k, t in enumerate(texts):
        own = words_of((t or "").translate(LOW))
        got = w.hashes[w.at[k] : w.at[k + 1]].tolist()
        assert len(own) == len(got)
        for a, b in zip(own, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def counted(t):
    w, lines = words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(docs_of):
    got = quality.judge(docs_of(list(enumerate(TEXTS)), CLASH), []).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: counted(t) for i, t in enumerate(TEXTS)}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed) for r in got)
    assert quality.judge(docs_of([]), []).count() == 0


def test_quality_learns_rules_as_expressions(spark, docs_of):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [f"w{rng.randrange(10**6)}" + ("###" if bad and rng.random() < 0.6 else "") for _ in range(80)]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    docs, told = docs_of(rows), spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id bigint, quality int")
    rules = quality.fit(docs, told)
    assert 0 < len(rules) < 5
    kept = {r.doc_id for r in quality.judge(docs, rules).where("kept").collect()}
    assert kept == {i for i, q in labels if q}
    out = quality.keep(docs_of(rows, ("kept",)), rules)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"] and out.count() == 450
    assert quality.fit(docs, told.limit(0)) == [] and quality.fit(docs.limit(0), told) == []


def test_quality_learns_from_all_labelled_rows(spark, docs_of):
    first = spark.range(9_000).orderBy(F.xxhash64("id"), "id").limit(8_000)
    late = {r.id for r in spark.range(9_000).join(first, "id", "left_anti").where("id % 3 = 0").collect()}  # all bad ones come after the first 8,000
    docs = docs_of([(i, "word ### other" if i in late else "word and other") for i in range(9_000)])
    rules = quality.fit(docs, spark.createDataFrame([(i, int(i not in late)) for i in range(9_000)], "doc_id bigint, quality int"))
    assert len(rules) == 1 and len(late) > 200
    rows = docs.select("doc_id", quality.stats("text").alias("s")).select("doc_id", quality.verdict(rules, F.col("s")).alias("good"))
    assert {r.doc_id for r in rows.where("not good").collect()} == late


def test_quality_counts_rows_by_value(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.3, *[float(rng.choice([0, 1, 2, 1000.2, 1000.3, 3e9])) for _ in quality.FEATURES]) for _ in range(3_000)]
    table = spark.createDataFrame(rows, ["bad", *quality.FEATURES]).repartition(7)
    key, bad, good, lo, hi = quality._by_value(table)
    for k in range(len(quality.FEATURES)):
        at = key >> quality.LEFT == k
        want = [Counter((min(r[k + 1], 1000.2) if r[k + 1] < 2000 else r[k + 1]) for r in rows if r[0] == b) for b in (True, False)]
        assert lo[at].tolist() == sorted(want[0]) and hi[at].tolist() == [0, 1, 2, 1000.3, 3e9]
        assert bad[at].tolist() == [n for _, n in sorted(want[0].items())] and good[at].tolist() == [n for _, n in sorted(want[1].items())]
    best, left = quality._best((key, bad, good, lo, hi), [1.0] * len(quality.FEATURES))
    held = [r for r in rows if (r[quality.FEATURES.index(best.feature) + 1] > best.threshold) == best.above]
    assert left == sum(not r[0] for r in held)


def sentences(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(docs_of):
    rng = random.Random(2)
    parts = {"aa": ["th", "er", "ing", "on"], "bb": ["sch", "ung", "ei", "er"], "cc": ["eau", "que", "ré", "on"]}
    rows = [(i, sentences(rng, parts[k := "abc"[i % 3] * 2], 60), k, "s") for i in range(150)]
    model = langid.fit(docs_of(rows[:90] + [(999, "no language", None, "s"), (998, "", "dd", "s")]))
    assert model.langs == ["aa", "bb", "cc"]
    odd = [(1000, None), (1001, "12 - !"), (1002, ""), (1003, (rows[1][1] + " ") * 200), (1003, (rows[1][1] + " ") * 200)]
    got = {r.doc_id: r for r in langid.identify(docs_of(rows[90:] + odd, CLASH), model).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows[90:]) >= 58
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 3 + ["bb"] and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(docs_of([]))
    assert langid.identify(docs_of([(1, "text")]), none).first().lang_pred == "und"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_cross_parsing(train, text):
    letters = "wxyz"
    own, other = ("".join(letters[c] for c in x) for x in (train, text))
    model = langid.train([("k", own)])
    low, at = langid.symbols(pa.array([other]))
    count, i = 0, 0
    while i < len(other):
        n = 1
        while i + n < len(other) and other[i : i + n + 1] in own:
            n += 1
        count, i = count + 1, i + n
    assert langid.phrases(model, low, at).tolist() == [[count]]
    for lane in (1, 2, 7):
        assert langid.phrases(model, low, at, lane).tolist() == [[count]]


def parsed(own, other):
    count, i = 0, 0
    while i < len(other):
        n = 1
        while i + n < len(other) and other[i : i + n + 1] in own:
            n += 1
        count, i = count + 1, i + n
    return count


def test_cross_parsing_of_many_letters():
    rng = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(400)] + list("abcdefgh")
    words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(150)]
    own = {"ja": "".join(rng.choice(words) for _ in range(300)), "zh": "".join(rng.choice(words)[::-1] for _ in range(300))}
    model = langid.train(list(own.items()))
    assert len(model.letters) > 2 * langid.ALPHABET
    other = ["".join(rng.choice(words) for _ in range(60)), "".join(rng.choice(words)[::-1] for _ in range(60)), "\u9fa0" * 5, "abc"]
    low, at = langid.symbols(pa.array(other))
    assert langid.phrases(model, low, at).tolist() == [[parsed(own[k], x) for k in ("ja", "zh")] for x in other]
    assert [x["lang"] for x in langid.predict(pa.array(other[:2]), model).to_pylist()] == ["ja", "zh"]


def test_lanes_of_several_texts_and_languages():
    rng = random.Random(31)
    own = {k: "".join(rng.choice(k) for _ in range(300)) for k in ("aab", "abc", "bcc")}
    model = langid.train(list(own.items()))
    # The second phrase of the last text runs through many lanes.
    other = ["".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(40)] + ["c" + own["aab"][5:250] + "c" * 9]
    low, at = langid.symbols(pa.array(other))
    want = [[parsed(own[k] + " ", x) for k in model.langs] for x in other]
    for lane in (1, 3, 10, 64, 512):
        assert langid.phrases(model, low, at, lane).tolist() == want


def test_language_of_nine_scripts(docs_of):
    rng = random.Random(32)
    scripts = {"en": 0x61, "el": 0x3B1, "ru": 0x430, "hy": 0x561, "he": 0x5D0, "hi": 0x915, "th": 0xE01, "ja": 0x4E00, "ko": 0xAC00}
    words = {k: ["".join(chr(c + rng.randrange(400 if k in ("ja", "ko") else 20)) for _ in range(rng.randrange(2, 6))) for _ in range(300)] for k, c in scripts.items()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k, "s") for i, k in enumerate(sorted(scripts) * 50)]
    model = langid.fit(docs_of(rows[:270]))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs_of([(i, t) for i, t, _, _ in rows[270:]]), model).collect()}
    assert sum(got[i] == k for i, _, k, _ in rows[270:]) >= 0.97 * 180


def test_language_of_whole_texts(docs_of):
    word = lambda rng, letters: "".join(rng.choice(letters) for _ in range(5))
    rng = random.Random(6)
    late = " ".join(word(rng, "tuvwxyz") for _ in range(1500))
    model = langid.fit(docs_of([(1, "same " * 420 + late, "aa", "s"), (2, "same " * 420 + " ".join(word(rng, "klmnopq") for _ in range(1500)), "bb", "s")]))
    assert set("tuvwxyz") <= {chr(c) for c in model.letters}
    assert langid.identify(docs_of([(3, late[2000:4000])]), model).first().lang_pred == "aa"
    long = langid.fit(docs_of([(k, " ".join(word(rng, "abcdef") for _ in range(20_000)) + " " + "z" * 60_000, "aa", "s") for k in range(3)]))
    assert ord("z") in long.letters.tolist() and 2 ** long.bits[0] > 0.98 * langid.TRAIN_SYMBOLS


@pytest.mark.parametrize("text", ["(d a m n)", "so d a m n, no", '"d.a.m.n"', "d a m n!", "d-- a-- m-- n--", "_d a m n_", "that's d a m n"])
def test_spaced_words_are_joined_beside_any_other_character(text):
    assert "damn" in toxicity.tokens(text)


def test_words_beside_spaced_ones_keep_their_letters():
    assert toxicity.tokens("don't a b c's x") == {"don't", "a", "b", "c's", "x"}


def test_toxicity(spark, docs_of):
    rng = random.Random(3)
    plain = [sentences(rng, ["ba", "ke", "lo", "mi", "nu"], 1) for _ in range(3000)]
    rows, labels = [], []
    for i in range(500):
        w = rng.sample(plain, 40)
        if i % 5 == 0:
            w[rng.randrange(40)] = rng.choice(["grumbok", "wraztin"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    told = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(rows), told)
    assert {"=grumbok", "=wraztin"} <= set(model.lexicon)
    odd = [(600, None), (601, ""), (602, "ke gr0mbok x"), (603, "gruuuumbok!!"), (604, "ba w r a z t i n ke"), (605, "ba g.r.u.m.b.o.k"), (606, "wr@zt1n"), (607, "x" * 50_000), (608, "ke lo mi")]
    got = {r.doc_id: r for r in toxicity.report(docs_of(rows + odd, CLASH), model).collect()}
    assert [i for i, y in labels if got[i].predicted != y] == []
    assert [got[i].predicted for i in (600, 601, 603, 604, 605, 606, 607, 608)] == [0, 0, 1, 1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.keep(docs_of(rows, ("score",)), model)
    assert kept.count() == 400 and kept.columns[-1] == "score"
    none = toxicity.fit(docs_of(rows), told.limit(0))
    assert {r.score for r in toxicity.report(docs_of(odd), none).collect()} == {0.0}


def test_toxicity_learns_from_all_labelled_rows(spark, docs_of):
    rows = [(i, f"word{i}x{'grumbok' * (i % 10 == 0 or i % 37 == 1):>9} ba{i} ke") for i in range(11_000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    learning = {r.doc_id for r in labels.where("pmod(xxhash64(doc_id, 7), 3) <> 0").collect()}
    bad, good = (sum(i in learning and "grumbok" in t and (i % 10 == 0) == toxic for i, t in rows) for toxic in (True, False))
    assert bad > 700 and good > 150 and model.lexicon["=grumbok"] == (bad + 1) / (bad + good + 2)
    text = toxicity.CharModel.learn({"": {"a": 3, "$": 2}, "^": {"a": 2}, "a": {"a": 1, "$": 2}, "^^": {"a": 2}, "^a": {"a": 1, "$": 1}, "aa": {"$": 1}})
    assert toxicity._char_model(spark.createDataFrame([(["a", "aa", "9"],)], "w array<string>")).cost == text.cost


def test_toxicity_deals_texts_by_id_at_any_size(spark, docs_of, capsys):
    docs, labels = docs_of([(1, "a"), (2, "b"), (2, "c"), (3, None), (None, "d")]), spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (4, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    rows = toxicity._labelled(docs, labels, "doc_id", "text", "toxic")
    assert sorted((r.i, r.t or "", r.y) for r in rows.collect()) == [(1, "a", 0), (2, "b", 1), (2, "c", 1), (3, "", 1)]
    rows.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def likeliest(token, model):
    """Every way through the lattice, by its cost."""
    ways = [("", 0.0)]
    for options in toxicity.lattice(token):
        ways = [(text + letters, cost + channel) for text, cost in ways for letters, channel in options]
    out = {}
    for text, cost in ways:
        spelt = f"^^{text}$"
        cost += sum(model.step(spelt[i - 2 : i], spelt[i]) for i in range(2, len(spelt)))
        out[text] = min(cost, out.get(text, cost))
    return out


def test_decoding_is_that_of_all_ways():
    rng = random.Random(33)
    seen = {}
    for w in ["trash", "idiot", "clown", "glass", "boot", "seller", "little"] * 3:
        text = f"^^{w}$"
        for i in range(2, len(text)):
            for k in range(3):
                at = seen.setdefault(text[i - k : i], {})
                at[text[i]] = at.get(text[i], 0) + 1
    model = toxicity.CharModel.learn(seen)
    for token in ["tr4$h", "1d10t", "g|a55", "b00t!", "l1ttl3", "ttrraashh", "c-l-o-w-n", "0", "$$", "a1!2b"] + ["".join(rng.choice("ab1l!0$-ee") for _ in range(rng.randrange(1, 10))) for _ in range(60)]:
        ways = likeliest(token, model)
        assert ways[toxicity.decode(token, model)] <= min(ways.values()) + 1e-9
    assert [toxicity.decode(t, model) for t in ("tr4$h", "1d10t", "c-l-0-w-n")] == ["trash", "idiot", "clown"]
    long = "tr4$h" * 40  # as a whole, not in pieces
    assert toxicity.decode(long, model).startswith("tr") and len(toxicity.decode(long, model)) >= 160


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = "pmod(crc32(cast(doc_id as string)), 4) = 2"
    model = toxicity.fit(docs, labels.where(f"not ({held})"))
    got = toxicity.report(docs.where(held), model).join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.85 * (n[1, 1] + n.get((0, 1), 0))


@pytest.mark.parametrize("seed", range(3))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 5, 400)
    index = fmindex.FMIndex(s, 5)
    patterns, sizes = rng.integers(0, 5, (60, 6)), rng.integers(1, 7, 60)
    lo, hi = index.search(patterns, sizes)
    for p, n, a, b in zip(patterns, sizes, lo, hi, strict=True):
        want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def contaminated(text, items, n=13):
    tok = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    w, hit, found = tok(text), set(), set()
    for i, t in items:
        x = tok(t)
        for k in range(max(1, len(x) - n + 1) if x else 0):
            win = x[k : k + n]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    if i is not None:
                        found.add(i)
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs_of):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(10, say(30)), (2, say(14)), (3, "Three, short words"), (4, ""), (5, None), (None, say(13)), (7, say(20))]
    items += [(8, items[0][1]), (2, items[1][1])]
    rows = [(i, say(100)) for i in range(20)]
    rows += [(100, f"{say(9)} {items[0][1].upper()}! {say(9)}"), (101, items[1][1]), (102, f"x three short WORDS {say(300)}"), (103, items[5][1]), (104, None), (105, ""), (106, (items[6][1] + " x ") * 300), (101, items[1][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.report(docs_of(rows, CLASH), bench).collect()
    want = Counter((i, *contaminated(t, items)) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    found = decontaminate.hits(docs_of(rows), bench, block_words=30).select("doc_id", "found.n_words", decontaminate.n_hit("found").alias("n"), F.size("found.items").alias("k")).collect()
    assert Counter(tuple(r) for r in found) == Counter((i, *contaminated(t, items)[:3]) for i, t in rows)
    kept = decontaminate.keep(docs_of(rows, ("found",)), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in rows if not contaminated(t, items)[4])
    cut = {r.doc_id: r.text for r in decontaminate.cut(docs_of(rows), bench).collect()}
    assert cut[101] == "" and cut[104] is None and "three" not in cut[102]
    assert decontaminate.report(docs_of(rows[:3]), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.report(docs_of([]), bench).count() == 0


def test_lengths(spark, docs_of):
    tiktoken = lengths._encoding(lengths.TOKENIZER, lengths.PATTERN)
    rows = list(enumerate([*TEXTS, "<|endoftext|> is text"] * 2))
    sizes = [len(tiktoken.encode_ordinary(t)) if t else 0 for _, t in rows]
    hist = lengths.histogram(docs_of(rows, CLASH)).cache()
    assert {r["length"]: r.n_docs for r in hist.collect()} == Counter(sizes)
    sums = lengths.suffix_sums(hist)
    for r in sums.collect():
        n = r["length"]
        assert (r.docs_from, r.tokens_from, r.truncated_tokens) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n), sum(min(s, n) for s in sizes))
    for r in lengths.at_limits(hist, [0, 3, 10**6]).collect():
        assert (r.docs_beyond, r.tokens_kept, r.tokens_lost) == (sum(s > r.limit for s in sizes), sum(min(s, r.limit) for s in sizes), sum(max(0, s - r.limit) for s in sizes))
    assert lengths.quantiles(sums, [0.5, 1.0]).first()[:] == (sorted(sizes)[len(sizes) // 2 - 1], max(sizes))
    assert lengths.suffix_sums(lengths.histogram(docs_of([]))).count() == 0


def test_benchmark_ids_of_any_type(spark):
    import hashlib

    texts = [("b-10", "one two three"), ("b-9", "two three"), (None, "four five"), ("b-10", "nine ten")]
    rows = [(1, "zero one two three", None, None), (2, "four five", None, None), (3, "nine ten", None, None), (4, None, None, None)]
    bench = spark.createDataFrame(texts, "item_id string, text string")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    said = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    want = {1: (3, 2, said("b-10", "b-9")), 2: (2, 0, said()), 3: (2, 1, said("b-10")), 4: (0, 0, said())}
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(docs, bench).collect()} == want
    found = {r.doc_id: list(r["items"]) for r in decontaminate.hits(docs, bench, block_words=2).select("doc_id", "found.items").collect()}
    assert found == {1: ["b-10", "b-9"], 2: [], 3: ["b-10"], 4: []}
