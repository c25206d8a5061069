"""The operators against brute force on small tables with nulls, empty and long texts, copies and odd columns."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codonlake.llm import bpe, decontamination, graph, jaccard_join, language_id, license_scan, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter
from codonlake.llm.segments import maximal_segments

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows(spark, sf):
    own = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{i % 997} x{i}" for i in range(30000))
    extra = [None, "", " \n\t ", "a b c", "a b c", "The Same " * 40, "the same " * 40, long, long + " end", "É é ü 漢字 😀 don't we'll 12² 　 x", "cc by mit license, GNU General Public License v3"]
    return own + [(10_000 + i, t) for i, t in enumerate(extra)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, None if d > 10_000 else "en", None, None) for d, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers as P
    import tiktoken

    with open(bpe.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(bpe.vocabulary()).ready()


def test_bpe_is_tiktoken(docs, rows, tik):
    got = {r.doc_id: r for r in bpe.round_trip(docs, bpe.vocabulary()).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = tik.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].lossless) == (len(ids), True)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t''strvmdle12Éé漢")), max_size=30), min_size=1, max_size=4))
def test_bpe_of_any_text(tik, coder, texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, upto = coder.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, t in enumerate(texts):
        own = ids[upto[i] : upto[i + 1]]
        assert own.tolist() == tik.encode_ordinary(t)
        assert coder.decode(own).tobytes() == raw[i]


def test_bpe_lists_and_empty_table(docs, empty, tik, rows):
    enc = bpe.encode(docs.limit(5), bpe.vocabulary()).cache()
    texts = dict(rows)
    for r in enc.collect():
        assert r.ids == tik.encode_ordinary(texts[r.doc_id] or "")
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(enc, bpe.vocabulary()).collect()} == {r.doc_id: texts[r.doc_id] or "" for r in enc.collect()}
    assert bpe.round_trip(empty, bpe.vocabulary()).count() == 0


def quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_rules(spark, sf, docs, rows, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    P = quality_rules.P
    got = {r.doc_id: r for r in quality_rules.judged(docs.withColumnRenamed("source", "stratum"), labels).collect()}
    for d, t in rows:
        r = got[d]
        assert tuple(r[P + c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == quality(t)
        assert not (r[P + "base_failed"] and r[P + "kept"])
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    assert quality_rules.keep_good(empty, labels.limit(0)).count() == 0


def test_quality_rules_count_all_labels(spark):
    """A stratum with 1 % of 60,000 labels is certified: 600 good documents prove a cutoff, a third of them doesn't."""
    good, bad = " ".join(f"word{i}" for i in range(120)), " ".join(f"###{i}" for i in range(120))
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, good).when(F.col("id") < 700, bad).otherwise("").alias("text"), F.when(F.col("id").between(600, 699), 0).otherwise(1).alias("quality"))
    cutoffs = quality_rules.fit_cutoffs(rows.drop("quality"), rows.drop("text")).collect()
    assert [r.stratum for r in cutoffs] == [1] and cutoffs[0].cutoffs[0] is not None


def test_binomial_tail_is_exact(spark):
    from math import comb, log

    from pyspark.sql import functions as F

    for k, n in ((0, 5), (3, 40), (7, 500)):
        got = spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("t")).first().t
        assert got == pytest.approx(log(sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))))


def test_url_filter(spark):
    rows = [(1, "http://A.Example.org/es/x?q=1", None), (2, "https://x.com/fr/", ""), (3, None, None), (4, "nothing", None), (5, "http://x.net/a", "<link rel='canonical' href='http://b.example.org/en/1'>"), (6, "http://x.com/zz", None), (7, "http://org/x", '<link href="http://b.example.org/en/1" rel="canonical">'), (5, "http://x.net/a", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.RULES).collect()), key=repr)
    alias = (5, "x.net", "/a", None, "allow")  # its class holds an explicitly allowed URL, too
    want = [(1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "x.com", "/fr/", "com/fr/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), alias, alias, (6, "x.com", "/zz", None, "allow"), (7, "org", "/x", "org/", "allow")]
    assert got == sorted(want, key=repr)
    alone = url_filter.judge(pages.where("page_id != 7"), url_filter.RULES)
    assert {r.verdict for r in alone.where("page_id = 5").collect()} == {"block"}
    joined = url_filter.with_rule(pages, url_filter.RULES * 200).where("page_id = 1").first()
    assert joined.best.rule == "example.org/es/"
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_url_aliases_of_raw_pages(spark):
    u = "http://x.net/p/q/r.html?k=1#f"
    refs = {"/en/1": "http://x.net/en/1", "//h.org/x": "http://h.org/x", "a": "http://x.net/p/q/a", "../b?c=/../d": "http://x.net/p/b?c=/../d", "./": "http://x.net/p/q/", "..": "http://x.net/p/", "../../../z": "http://x.net/z", "?j=2": "http://x.net/p/q/r.html?j=2", "#g": "http://x.net/p/q/r.html?k=1#g", "HTTPS://Y.de/k": "HTTPS://Y.de/k"}
    got = spark.createDataFrame([(u, v) for v in refs], "u string, v string").select("v", url_filter.resolved(F.col("u"), F.col("v"))).collect()
    assert dict(map(tuple, got)) == refs
    assert spark.createDataFrame([("http://x.net", "a")], "u string, v string").select(url_filter.resolved(F.col("u"), F.col("v"))).first()[0] == "http://x.net/a"
    html = '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=/m"><LINK REL="CANONICAL" HREF="//example.org/es/1"><link rel=canonical href=n>'
    pages = spark.createDataFrame([(1, "http://x.net/a/b", html), (2, "http://x.net/m", None), (3, "http://x.net/a/n", None), (4, "http://x.net/n", None)], "page_id long, url string, html string")
    rules = [("block", "example.org", "/es/")]
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_decontamination(spark, sf, docs, rows, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    items = [tuple(r) for r in bench.collect()] + [(900, "The same the same"), (901, None), (902, "w3 x3 w4 x4 w5 x5 w6 x6 w7 x7 w8 x8")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontamination.brute_force(rows, items)
    for words in (decontamination.BLOCK_WORDS, 300):
        got = {r.doc_id: tuple(r)[1:] for r in decontamination.digest(decontamination.decontaminate(docs, bench, words)).collect()}
        assert got == want
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.digest(decontamination.decontaminate(docs, bench.limit(0))).where("contaminated").count() == 0


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, n, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, n, num).collect()}
    assert got == jaccard_join.brute_force(rows, n, num)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_near_copies_of_one_text_are_one_component(spark):
    rnd = np.random.default_rng(2)
    base = [f"t{i}" for i in range(300)]
    texts = []
    for i in range(150):
        w = list(base)
        for p in rnd.integers(0, 300, 5):
            w[p] = f"new{i}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85).collect()}
    assert got == jaccard_join.brute_force(texts, 4, 85)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (None, 3), (3, 7), (20, 7)], "u long, v long")
    assert sorted(tuple(r) for r in graph.components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 8), (9, 8), (20, 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.component for r in graph.components(chain).collect()} == {0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 12))
def test_compact_windows(x, least):
    got = set(zip(*[v.tolist() for v in substring_dedup.compact_windows(np.array(x, np.uint64), least)], strict=True))
    assert got == substring_dedup.brute_windows(x, least)


def test_substring_dedup(spark, docs, rows):
    found = substring_dedup.repeats(docs)
    got = {}
    for r in found.collect():
        assert r.of_doc_id < r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
    first, want = {}, {}
    for d, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                want.setdefault(d, set()).update(range(i, i + 50))
    assert set(want) <= set(got)
    assert sum(len(v - got[d]) for d, v in want.items()) <= 0.02 * sum(map(len, want.values()))
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs, found).collect()}
    texts = dict(rows)
    for d, t in rows:
        if d not in got:
            assert cut[d] == t
        elif d in cut:
            w = re.findall(r"[^\x20\x09-\x0D]+", texts[d])
            assert re.findall(r"[^\x20\x09-\x0D]+", cut[d]) == [x for i, x in enumerate(w) if i not in got[d]]
    assert 10_008 not in cut or len(cut[10_008]) < 100


def made_up(rng, n):
    return [f"u{x}" for x in rng.integers(0, 10**12, n)]


def test_substring_dedup_behind_another_head(spark):
    """Two texts share a passage each of whose shingles an earlier, otherwise different text holds, too."""
    rng = np.random.default_rng(3)
    passage = made_up(rng, 60)
    texts = [made_up(rng, 50) + passage[i : i + 5] + made_up(rng, 50) for i in range(56) for _ in range(8)]
    texts += [made_up(rng, 40) + passage + made_up(rng, 40) for _ in range(3)]
    found = substring_dedup.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.of_doc_id, r.first_word, r.last_word) for r in found) == [(449, 448, 40, 99), (450, 448, 40, 99)]


def test_substring_dedup_near_copies(spark):
    """Passages of 50 words with one word changed (similarity 0.8)."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(400):
        passage = made_up(rng, 50)
        texts += [made_up(rng, 40) + passage + made_up(rng, 40), made_up(rng, 40) + passage[:25] + made_up(rng, 1) + passage[26:] + made_up(rng, 40)]
    found = substring_dedup.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(r.doc_id == r.of_doc_id + 1 and r.of_doc_id % 2 == 0 for r in found)
    assert len({r.doc_id for r in found}) >= 0.99 * 400  # 399; under three functions 394


def test_license_scan(docs, rows, empty):
    word, phrases = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), [(p.split(), v) for p, v in license_scan.BASE.items()]
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for d, t in rows:
        w = word.findall(lower(t))
        hits = [(i, v) for i in range(len(w)) for p, v in phrases if w[i : i + len(p)] == p]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({v for _, v in hits})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[10_010].labels == "cc-by,gpl,mit"
    assert license_scan.scan(empty).count() == 0
    assert len(license_scan.signatures()) > 200


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 5), max_size=25))
def test_maximal_segments(x):
    """Against the recursive definition: the best segment, then the same to its left and right."""
    drift = 1.0
    x = [v + 0.001 * (i + 1) ** 1.5 if v > 0 else v for i, v in enumerate(x)]  # no ties
    at = [i for i, v in enumerate(x) if v > 0]
    y = [v if v > 0 else -drift for v in x]

    def best(a, b):
        found = None
        for i in range(a, b):
            for j in range(i, b):
                s = sum(y[i : j + 1])
                if s > 0 and (found is None or s > found[0]):
                    found = (s, i, j)
        return [] if found is None else [*best(a, found[1]), found, *best(found[2] + 1, b)]

    got = maximal_segments(at, at, [x[i] for i in at], drift)
    want = best(0, len(x))
    assert sum(s for *_, s in got) == pytest.approx(sum(s for s, *_ in want))
    assert max((s for *_, s in got), default=0) == pytest.approx(max((s for s, *_ in want), default=0))


def learnable(spark, n=400):
    bad, good = ["scum", "moron"], [f"word{i}" for i in range(60)]
    rnd = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        w = [good[j] for j in rnd.integers(0, 60, 80)]
        toxic, junk = int(i % 4 == 0), int(i % 5 == 0)
        if toxic:
            for p in rnd.integers(0, 80, 4):
                w[p] = bad[p % 2]
        if junk:
            w = [x + "###" for x in w]
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(w) if lang == "aa" else " ".join(x[::-1] for x in w) if not toxic else " ".join(w), lang, None, None))
        labels.append((i, 1 - junk, toxic))
    rows += [(n, None, None, None, None), (n + 1, "", "aa", None, None), (n + 2, "123 ...", "bb", None, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_learn(spark, empty):
    docs, labels = learnable(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 3 != 0"))
    held = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.score(docs, None, 0.25).first().score < 0.5
    assert toxicity.score(empty, model).count() == 0
    stats = quality_classifier.statistics(docs)
    rules, constant = quality_classifier.fit(stats, labels.where("doc_id % 3 != 0"))
    out = stats.withColumn("score", quality_classifier.compiled(rules, constant))
    held = out.join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in held) >= 0.95 * len(held)
    assert out.count() == docs.count()
    assert quality_classifier.fit(stats, labels.limit(0))[0] == []


def test_language_id(spark, empty):
    docs, _ = learnable(spark)
    model = language_id.fit(docs.where("doc_id % 3 != 0"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in docs.where("doc_id % 3 = 0 and doc_id < 400 and doc_id % 4 != 0").collect()]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert {got[i].lang_pred for i in (400, 401, 402)} == {"und"}
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"documents": docs.count()}
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs.count()
        assert 0 < kept[name] <= before.count()
        if name == "jaccard_join":
            left = [(r.doc_id, r.text) for r in before.collect()]
            want = {d for d, (_, c) in jaccard_join.brute_force(left, 5, 80).items() if d == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            found = decontamination.brute_force([(r.doc_id, r.text) for r in before.collect()], items)
            assert {r.doc_id for r in docs.collect()} == {d for d, x in found.items() if not x[-1]}
