"""Rows that share an id or have none, colliding hashes, edited passages, learned scores against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codonlake.llm import bpe, decontamination, graph, jaccard_join, kernels, language_id, license_scan, quality_rules, segments, session, substring_dedup, toxicity

TEXT = "doc_id long, text string"


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def made_up(rng, n):
    return [f"u{x}" for x in rng.integers(0, 10**12, n)]


def test_hashes_of_opposite_sequences_differ():
    """Polynomial hashes modulo a power of two are the same for these."""
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    for size in (200, 1024, 2048):
        buf = np.frombuffer((x[:size] + y[:size]).encode(), np.uint8)
        one, two = kernels.span_hashes(buf, np.array([0, size]), np.array([size, 2 * size])).tolist()
        assert one != two


def test_bpe_tells_pretokens_of_one_hash_apart(monkeypatch):
    coder = bpe.coder(bpe.vocabulary()).ready()
    raw = [t.encode() for t in (thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba")), "the cat sat on the mat", " the the")]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    want, _ = coder.encode(buf, offs)
    monkeypatch.setattr(bpe, "span_hashes", lambda b, lo, hi: np.zeros(len(lo), np.uint64))  # everything collides
    got, upto = coder.encode(buf, offs)
    assert got.tolist() == want.tolist()
    assert [coder.decode(got[a:b]).tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)] == raw


def test_bpe_workers_give_memory_back():
    coder = bpe.coder(bpe.vocabulary()).ready()
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["qzxjvk wqpzzt", "the cat"])], ["doc_id", "text"])
    for doc_ids, buf, offs in coder.texts(iter([batch, batch])):
        coder.encode(buf, offs)
        assert doc_ids.to_pylist() == [1, 2] and coder.memory
    assert not coder.memory and not coder.older


def test_decontamination_keeps_rows_of_one_id_apart(spark):
    rng = np.random.default_rng(1)
    passage = made_up(rng, 30)
    texts = [" ".join(made_up(rng, 20) + passage), "clean words only here", " ".join(passage[5:15]), None, " ".join(passage[5:14]), " ".join(passage[3:17] + passage[3:17])]
    ids = [1, 1, None, None, 2, 2]
    items = [(7, " ".join(passage)), (None, " ".join(passage[:12])), (8, "only"), (9, ""), (9, None)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), TEXT)
    bench = spark.createDataFrame(items, "item_id long, text string")
    keyed = decontamination.brute_force(list(enumerate(texts)), [("null" if i is None else i, t) for i, t in items])
    want = sorted(((d, *keyed[k]) for k, d in enumerate(ids)), key=repr)
    for words in (decontamination.BLOCK_WORDS, 0):
        got = decontamination.digest(decontamination.decontaminate(docs, bench, words))
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_decontamination_of_many_items_and_repeats(spark):
    """One passage in many items, many times in one document; documents end where others go on."""
    rng = np.random.default_rng(2)
    p = made_up(rng, 24)
    items = [(i, " ".join(p[i % 3 : 20 + i % 3])) for i in range(40)]
    rows = [(0, " ".join(p * 30)), (1, " ".join(p[:14])), (2, " ".join(p[14:])), (3, " ".join(made_up(rng, 50))), (4, " ".join(p[4:13])), (5, " ".join(p[13:]))]
    want = decontamination.brute_force(rows, items)
    got = decontamination.digest(decontamination.decontaminate(spark.createDataFrame(rows, TEXT).coalesce(1), spark.createDataFrame(items, "item_id long, text string")))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_substring_dedup_finds_passages_of_similarity_above_bound(spark):
    """Edits spread evenly: 100 words with 2 and 200 with 4 have a similarity of 0.81, 100 with 1 of 0.90."""
    rng = np.random.default_rng(4)
    texts, made = [], []
    for n, k in ((100, 2), (200, 4), (100, 1)):
        for _ in range(60):
            p = made_up(rng, n)
            q = list(p)
            for j in range(k):
                q[(j + 1) * n // (k + 1)] = made_up(rng, 1)[0]
            made.append((n, k))
            texts += [made_up(rng, 40) + p + made_up(rng, 40), made_up(rng, 30) + q + made_up(rng, 40)]
    found = substring_dedup.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], TEXT)).collect()
    covered = {}
    for r in found:
        assert (r.doc_id, r.of_doc_id % 2) == (r.of_doc_id + 1, 0) and r.similarity >= 0.8
        covered.setdefault(r.doc_id // 2, set()).update(range(r.first_word, r.last_word + 1))
    for kind in set(made):
        share = [len(covered.get(i, set()) & set(range(30, 30 + kind[0]))) / kind[0] for i, k in enumerate(made) if k == kind]
        assert np.mean([x > 0.9 for x in share]) >= 0.95, kind


def test_substring_dedup_around_a_common_phrase(spark):
    """Every text holds a phrase of 40 words; two of them share 60 words around it."""
    rng = np.random.default_rng(5)
    phrase, left, right = made_up(rng, 40), made_up(rng, 10), made_up(rng, 10)
    texts = [made_up(rng, 60) + phrase + made_up(rng, 60) for _ in range(50)] + [made_up(rng, 60) + left + phrase + right + made_up(rng, 60) for _ in range(2)]
    found = substring_dedup.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], TEXT)).collect()
    assert [(r.doc_id, r.of_doc_id) for r in found if r.doc_id >= 50] == [(51, 50)]
    assert [(r.first_word, r.last_word) for r in found if r.doc_id == 51] == [(60, 119)]


def test_substring_dedup_common_keys_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    passage = made_up(rng, 80)
    texts = [(i, " ".join(made_up(rng, 50) + (passage if i % 2 else []) + made_up(rng, 50))) for i in range(120)]
    docs = spark.createDataFrame(texts, TEXT)
    whole = sorted(map(tuple, substring_dedup.repeats(docs).collect()))
    for name, value in (("SAMPLED", 1), ("GROUP", 10)):
        monkeypatch.setattr(substring_dedup, name, value)
    assert len(substring_dedup.common_keys(docs)[0]) > 0
    assert sorted(map(tuple, substring_dedup.repeats(docs).collect())) == whole
    assert {d for d, *_ in whole} == set(range(3, 120, 2))


def test_substring_dedup_odd_rows(spark):
    rng = np.random.default_rng(7)
    text = " ".join(made_up(rng, 100))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "few words")]
    found = substring_dedup.repeats(spark.createDataFrame(rows, TEXT))
    assert sorted((r.doc_id, r.of_doc_id, r.first_word, r.last_word) for r in found.collect()) == [(2, 1, 0, 99)]
    wide = spark.createDataFrame([(*r, 1, 2) for r in rows], TEXT + ", spans int, frames int")
    left = substring_dedup.without_repeats(wide, found)
    assert left.columns == wide.columns and left.where("doc_id = 2").count() == 0 and left.count() == len(rows) - 1
    assert substring_dedup.repeats(spark.createDataFrame([], TEXT)).count() == 0


def test_jaccard_join_odd_rows(spark):
    rng = np.random.default_rng(8)
    a, b = made_up(rng, 60), made_up(rng, 80)
    rows = [(5, " ".join(a)), (5, " ".join(a)), (3, " ".join(a)), (9, " ".join(b)), (9, "x y z"), (7, " ".join(b)), (None, " ".join(a)), (8, "x y z"), (6, None), (4, " \n")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], TEXT + ", n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    # the larger text of id 9 links it
    assert got == [(3, 56, 3), (4, 0, 4), (5, 56, 3), (5, 56, 3), (6, 0, 6), (7, 76, 7), (8, 1, 8), (9, 1, 7), (9, 76, 7)]


def test_jaccard_join_with_dealt_lists(spark, monkeypatch):
    """Near copies of two texts, in lists that are dealt over many groups."""
    rng = np.random.default_rng(9)
    rows = []
    for base in (made_up(rng, 200), made_up(rng, 150)):
        for _ in range(40):
            w = list(base)
            for p in rng.integers(0, len(w), 3):
                w[p] = made_up(rng, 1)[0]
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + i, " ".join(made_up(rng, 30))) for i in range(20)]
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    monkeypatch.setattr(jaccard_join, "CROWDED", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == jaccard_join.brute_force(rows, 5, 80)


@pytest.mark.parametrize("num", (80, 85))
def test_linked_sets_meet_in_enough_short_lists(num):
    rng = np.random.default_rng(10)
    for _ in range(3000):
        n, m, both = rng.integers(1, 80, 3)
        both = min(both, n, m)
        x, y = set(range(both)) | set(range(1000, 1000 + n - both)), set(range(both)) | set(range(2000, 2000 + m - both))
        order = {v: k for k, v in enumerate(rng.permutation(sorted(x | y)))}

        def short(s, order=order):
            t = jaccard_join.least_overlap(len(s), num)
            return set(sorted(s, key=order.get)[: len(s) - t + min(jaccard_join.NEED, t)])

        if both * (100 + num) >= num * (n + m):
            need = min(jaccard_join.NEED, *(jaccard_join.least_overlap(k, num) for k in (int(n), int(m))))
            assert len(short(x) & short(y)) >= need


def test_classes_merge_in_batches(spark):
    classes = graph.Classes()
    for links in ([(1, 2), (3, 4)], [(10, 11)], [(2, 3), (11, 12)]):
        classes.merge(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, classes.rows.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (12, 10)]
    assert [tuple(r) for r in classes.of(spark.createDataFrame([(4,), (99,)], "x long"), "x", "c").orderBy("x").collect()] == [(4, 1), (99, 99)]


def test_sieve_lets_all_wanted_rows_through(spark):
    docs = spark.range(-500, 5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("k"))
    assert [r.doc_id for r in session.sieve(docs, ids, "k").orderBy("doc_id").collect()] == [d for d in range(-500, 5000) if d % 7 == 0]
    assert session.sieve(docs, ids, "k", bits=8).join(ids, F.col("doc_id") == F.col("k")).count() == ids.count()


def lexicon_score(model, text):
    """Best segment and n of a text by trying every segment."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    keys = {int(k): i for i, k in enumerate(model.keys)}
    score = []
    for x in w:
        buf = np.frombuffer(x.encode(), np.uint8)
        at = keys.get(int(kernels.span_hashes(buf, np.array([0]), np.array([len(buf)]))[0]))
        if at is None:
            score.append(-toxicity.DRIFT)
        else:
            t, o = float(model.toxic[at]), float(model.other[at])
            odds = math.log((t + toxicity.PRIOR * model.share) / (o + toxicity.PRIOR * (1 - model.share)))
            score.append(odds - math.log(model.share / (1 - model.share)) - toxicity.DRIFT)

    def best(a, b):
        top = max(((sum(score[i : j + 1]), i, j) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0))
        return [] if top[0] <= 1e-12 else [*best(a, top[1]), top, *best(top[2] + 1, b)]

    return [(i, j, s) for s, i, j in best(0, len(w))], len(w)


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(11)
    good, bad = [f"word{i}" for i in range(40)], ["scum", "moron", "clown"]
    rows, labels = [], []
    for i in range(200):
        w = [good[j] for j in rng.integers(0, 40, 14)]
        toxic = int(i % 5 == 0)
        for p in rng.integers(0, 14, 3 if toxic else 0):
            w[p] = bad[p % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    rows += [(None, "scum moron"), (300, ""), (301, None), (5, rows[0][1])]
    docs = spark.createDataFrame(rows, TEXT)
    model = toxicity.fit(docs.where("doc_id != 5"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by_text = {t or "": lexicon_score(model, t or "") for _, t in rows}
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.evidence)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        if d == 5:
            continue
        segs, n = by_text[t or ""]
        want = toxicity.evidence([s for *_, s in segs], n, model.rate, model.scale)
        assert r.n_words == n and r.evidence == pytest.approx(want, abs=1e-6)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * min(want, 50) + model.offset))))
        for p in r.passages:
            assert any((p.first, p.last) == (i, j) and p.score == pytest.approx(s) for i, j, s in segs)
    assert len({r.score for r in got if r.doc_id in (300, 301)}) == 1


def test_extreme_law_recovers_its_parameters():
    rng = np.random.default_rng(12)
    m = rng.integers(50, 2000, 20000)
    s = (np.log(0.2 * m) - np.log(-np.log(rng.random(20000)))) / 1.5
    rate, scale = toxicity.extreme_law(s[s > 0], m[s > 0])
    assert rate == pytest.approx(1.5, rel=0.03) and scale == pytest.approx(0.2, rel=0.15)


def test_maximal_segments_are_those_of_the_definition():
    rng = np.random.default_rng(13)
    for _ in range(300):
        x = rng.normal(-0.3, 1, rng.integers(1, 18))
        up = np.concatenate([[0.0], np.cumsum(x)])
        pos = np.flatnonzero(x > 0)
        got = segments.segments_between(pos.tolist(), pos.tolist(), up[pos].tolist(), up[pos + 1].tolist())

        def best(a, b, x=x):
            top = max(((x[i : j + 1].sum(), -(j - i), i, j) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0, 0))
            return [] if top[0] <= 1e-12 else [*best(a, top[2]), (top[2], top[3]), *best(top[3] + 1, b)]

        assert [(a, b) for a, b, _ in got] == best(0, len(x))


def every_signature(text):
    """Detections (first, end, label, sure) by trying each signature alone, then containment."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    hits = []
    for rank, (keyword, label, sure, pattern) in enumerate(license_scan.signatures()):
        if keyword in low:
            hits += [(m.start(), -m.end(), rank, label, sure) for m in re.finditer(pattern, low, re.ASCII)]
    out, end = [], 0
    for a, neg, _, label, sure in sorted(hits):
        if -neg > end:
            out.append((a, -neg, label, sure))
            end = -neg
    return out


LINES = """licensed under cc by-nc 4.0.
cc  by-nc 4.0 and cc-by-nc-sa 3 and cc by
cc1by, cc4by and accby
Licensed under the Apache License, Version 2.0 (the "License")
GNU General Public License v3 or later; gpl-2.0+; gnu gpl 2
available under the terms of the GNU Lesser General Public License version 2.1 or (at your option) any later version
SPDX-License-Identifier: GPL-2.0-or-later
spdx-license-identifier: mit spdx-license-identifier: made-up-1.0 spdx-license-identifier: apache-2.0-only
mit license mit/x11 license MIT (Expat) License commit license
the new bsd license, BSD 3-Clause License, bsd-style licence, freebsd license, 2-clause BSD license
creative commons attribution-noncommercial-sharealike 4.0 Creative Commons Attribution license
apache license 2.05 apache license 1.1 php license 3.01
mozilla public license 2.0, the unlicense, all rights reserved; released into the public domain
released under the gnu license; published under the terms of sil open font license, version 1.1"""


def test_license_signatures_one_by_one(spark):
    lines = [*LINES.split("\n"), LINES, LINES.upper(), "", "Kelvin \u212a \u0130 mit license"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), TEXT)).collect()}
    for i, text in enumerate(lines):
        want = every_signature(text)
        assert [(d.a, d.e, d.identifier, d.sure) for d in got[i].detections] == want, text
        assert set(filter(None, got[i].identifiers.split(","))) == {x[2] for x in want}
        assert set(filter(None, got[i].labels.split(","))) == {re.sub(r"-or-later$|-[0-9]+[.][0-9]+(-or-later)?$", "", x[2]) for x in want} | set(filter(None, got[i].base_labels.split(",")))
    assert got[0].labels == "cc-by,cc-by-nc" and "gpl-3.0-or-later" in got[4].identifiers and got[2].labels == ""
    assert len({x[1] for x in license_scan.signatures()}) > 200


def test_license_scan_of_many_hits(spark):
    text = "mit license, gnu gpl 3.0; " * 4000
    r = license_scan.scan(spark.createDataFrame([(1, text), (1, text), (None, None)], TEXT)).collect()
    assert sorted(len(x.detections) for x in r) == [0, 8000, 8000]
    assert [(x.labels, x.identifiers) for x in r if x.doc_id] == [("gpl,mit", "gpl-3.0,mit")] * 2


def test_quality_cutoffs_against_brute_force(spark):
    """Two strata with labels enough and one with too few; the union of the rules is what is certified."""
    rng = np.random.default_rng(14)
    rows, labels = [], []
    for n, good, bad in ((40, 600, 120), (200, 900, 90), (1200, 30, 10)):
        for i in range(good + bad):
            w = made_up(rng, n)
            ok = i < good
            symbols, shouts = rng.integers(0, 3) if ok else rng.integers(0, n), rng.integers(0, 2) if ok else rng.integers(0, n)
            for p in rng.integers(0, n, symbols):
                w[p] += "#" * 9
            for p in rng.integers(0, n, shouts):
                w[p] = w[p].upper() + "A" * 40
            rows.append((len(rows), " ".join(w)))
            labels.append((len(labels), int(ok)))
    docs, marks = spark.createDataFrame(rows, TEXT), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.stratum: r.cutoffs for r in quality_rules.fit_cutoffs(docs, marks).collect()}
    P = quality_rules.P
    seen = quality_rules.with_statistics(docs).where(~quality_rules.base_failed()).select("doc_id", quality_rules._rule_values().alias("v"), F.col(P + "n_words").alias("n")).collect()
    mark = dict(labels)
    want = {}
    for stratum in range(3):
        own = [(r.v, mark[r.doc_id]) for r in seen if (0 if r.n < 100 else 1 if r.n < 1000 else 2) == stratum]
        n, m = sum(y for _, y in own), sum(1 - y for _, y in own)
        best = None
        for s in range(quality_rules.STEPS):
            cut = [g[s] for g in quality_rules.GRIDS]
            hit = [y for v, y in own if any(x > c for x, c in zip(v, cut, strict=True))]
            k, caught = sum(hit), len(hit) - sum(hit)
            tail = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
            if k > 0.01 * n or tail > 0.05 / 3:
                break
            gain = caught / max(m, 1) - quality_rules.COST * k / n
            if gain > 0 and (best is None or gain > best[0] + 1e-12):
                best = gain, cut
        if best:
            want[stratum] = best[1]
    assert got == want and set(want) == {0, 1}
    kept = {r.doc_id for r in quality_rules.keep_good(docs, marks).collect()}
    for stratum, (a, b) in {0: (0, 600), 1: (720, 1620)}.items():
        assert len([d for d in range(a, b) if d not in kept]) <= 0.02 * (b - a), stratum
    assert len([d for d in range(600, 720) if d not in kept]) > 60


def test_quality_moves_no_texts(spark, monkeypatch):
    """Labels of any number meet ids and numbers: the texts are in no shuffle, and the query reads them once."""
    stash, plans = session.stash, []

    def below(node):
        yield node
        for i in range(node.children().size()):
            yield from below(node.children().apply(i))

    def seen(df, name, **how):
        plans.append(df._jdf.queryExecution().optimizedPlan())
        return stash(df, name, **how)

    monkeypatch.setattr(quality_rules, "stash", seen)
    docs = spark.createDataFrame([(i, f"{'word ' if i % 3 == 1 else ''}" + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)], TEXT)
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 3)], "doc_id long, quality int")
    want = {r.doc_id: r[quality_rules.P + "kept"] for r in quality_rules.judged(docs, marks).collect()}
    joins = [x for p in plans for x in below(p) if x.nodeName() == "Join"]
    assert joins and not any("text#" in x.children().apply(i).output().toString() for x in joins for i in (0, 1))
    plans.clear()
    assert {r.doc_id: r.kept for r in quality_rules.digest(docs, marks).collect()} == want and len(want) == 40
    assert sum("split(" in p.toString() for p in plans) == 1


def test_quality_windows_of_one_hash(spark, monkeypatch):
    """Windows that share a hash but no words don't repeat; also where places outgrow their bits."""
    rng = np.random.default_rng(21)
    base = made_up(rng, 40)
    texts = ["", "a b c", " ".join(base), " ".join(base + base[3:9] + made_up(rng, 9)), " ".join(base[:6] * 4), " ".join(["a"] * 30 + base), None, " ".join(base[:12] + ["x"] + base[:12] + ["y"] + base[2:12])]

    def covered(t):
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        return len({k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 5)})

    docs = spark.createDataFrame(list(enumerate(texts)), TEXT)
    want = {i: covered(t) for i, t in enumerate(texts)}
    assert sorted(x > 0 for x in want.values()) == [False] * 4 + [True] * 4
    run = lambda: {r.doc_id: r[quality_rules.P + "n_repeat_words"] for r in quality_rules.with_statistics(docs).collect()}
    assert run() == want
    monkeypatch.setattr(quality_rules, "SPOT_BITS", 3)
    assert run() == want
    monkeypatch.undo()
    for one in ("5L", "cast(i % 3 as bigint) << 40"):
        monkeypatch.setattr(quality_rules, "_window_hash", lambda w, one=one: one)
        assert run() == want


def test_presence_kernel_against_sets(spark):
    rng = np.random.default_rng(15)
    texts = ["", "a", "ab", "Été ñandú", *["".join(rng.choice(list("abcdeé "), rng.integers(1, 60))) for _ in range(40)]]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()) for t in texts]
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in low]
    marks = [g for g in grams[10:20] if g]
    every = sorted({x for g in marks for x in g}, key=lambda x: (len(x), x))
    base = {1: 0, 2: 256, 3: 256 + 65536}
    codes = np.array([base[len(x)] + int.from_bytes(x, "big") for x in every], np.int32)
    by = np.array([[float(x in g) for g in marks] for x in every], np.float32)
    model = language_id.Model(codes, by, by.sum(0))
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = language_id.kernel(np.frombuffer("".join(texts).encode(), np.uint8), offs, model, model.slots())
    known = set(every)
    want = [[len(g & m) / math.sqrt(max(1, len(g & known)) * len(m)) for m in marks] for g in grams]
    assert np.allclose(got, want, atol=1e-5)


def test_language_id_has_no_bound_on_languages(spark):
    """150 languages of an alphabet each, one row of which is known by few texts."""
    rows = []
    for k in range(150):
        word = "".join(chr(0x4E00 + 7 * k + j) for j in range(5))
        rows += [(len(rows) + i, " ".join([word] * (5 + i)), f"l{k:03}") for i in range(4)]
    docs = spark.createDataFrame(rows, TEXT + ", lang string")
    got = language_id.predict(docs, language_id.fit(docs)).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(rows)


def test_pipeline_stages_with_odd_rows(spark, sf):
    import corpus_pipeline as C

    rng = np.random.default_rng(16)
    words = [made_up(rng, 120) for _ in range(6)]
    bench = " ".join(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(1).collect())
    join = lambda *w: " ".join(x for part in w for x in part)
    rows = [
        (1, join(words[0])), (1, join(words[0])), (1, join(words[1])), (None, join(words[2])), (None, join(words[3])), (None, join(words[3])),
        (2, join(words[0])), (3, None), (3, ""), (4, join(words[4], words[5][:60])), (5, join(words[5][:60], made_up(rng, 60))), (None, bench), (6, bench + " x"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], TEXT + ", lang string, source string, n_chars long")
    stages = dict(C.STAGES)
    one = stages["jaccard_join"](spark, docs, sf).cache()
    got = sorted(((r.doc_id, r.text) for r in one.collect()), key=repr)
    texts = Counter(t for _, t in got)
    assert one.columns == docs.columns and all(n == 1 for n in texts.values()) and len([t for t in texts if not t]) == 2
    assert set(texts) == {t for _, t in rows if t not in (bench, bench + " x")} | ({bench, bench + " x"} & set(texts)) and len({bench, bench + " x"} & set(texts)) == 1
    two = stages["substring_dedup"](spark, docs, sf)
    assert two.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in two.collect() if r.text), key=repr)
    assert (1, join(words[1])) in left and (None, join(words[2])) in left and (4, join(words[4], words[5][:60])) in left
    assert [len(t.split()) for d, t in left if d == 5] == [60]
    assert sum(t == join(words[0]) for _, t in left) in (1, 2)  # equal rows have one key: both stay, or document 2 does
    three = sorted(((r.doc_id, r.text) for r in stages["decontamination"](spark, docs, sf).collect()), key=repr)
    assert three == sorted([r for r in rows if r[1] not in (bench, bench + " x")], key=repr)
    assert stages["byte_bpe"](spark, docs, sf).count() == len(rows)
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_windows_in_passages_that_overlap(spark):
    """Passages of a document are laid together before windows are held against them; each place is as if they weren't."""
    rng = np.random.default_rng(12)
    found = [(int(d), int(a), int(a + n + substring_dedup.SHINGLE - 1)) for d, a, n in zip(rng.integers(0, 4, 60), rng.integers(0, 400, 60), rng.integers(0, 30, 60), strict=True)]
    rows = [(d, at << 12, (at + 7) << 12) for d in range(5) for at in range(0, 440, 3)]
    spans = spark.createDataFrame(found, "doc_id long, first_word int, last_word int")
    left = substring_dedup._unsettled(spark.createDataFrame(rows, "doc long, at long, by long"), spans, "at", "by")
    inside = lambda d, at: any(x == d and p <= at >> 12 <= q - substring_dedup.SHINGLE + 1 for x, p, q in found)
    assert sorted(map(tuple, left.collect())) == sorted(r for r in rows if not inside(r[0], r[1]) and not inside(r[0], r[2]))


def test_stashing_collects_the_drivers_garbage(spark, monkeypatch):
    """Once the driver's heap has grown, every few stashed tables give it back; a small heap is left alone."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    some = spark.range(3).withColumnRenamed("id", "doc_id")
    counts = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(session, "FULL", share)
        before = full()
        for _ in range(2 * session.LOOK):
            assert session.stash(some, "some").count() == 3
        counts.append(full() - before)
    assert counts == [2, 0]


def test_substring_dedup_couples_only_what_documents_still_share(spark, monkeypatch):
    """The first text of a passage keeps its windows when all others are explained; alone they make no couples."""
    rng = np.random.default_rng(13)
    passage = made_up(rng, 400)
    texts = [made_up(rng, 60) + passage + made_up(rng, 60) for _ in range(3)]
    made = {}

    def counted(df, name, scan=False):
        out = session.stash(df, name, scan)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(substring_dedup, "stash", counted)
    found = substring_dedup.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], TEXT)).collect()
    assert sorted((r.doc_id, r.first_word, r.last_word, r.of_doc_id) for r in found) == [(1, 60, 459, 0), (2, 60, 459, 0)]
    assert made["rows"] > 100 and made["couples"] == 0


def test_substring_dedup_contexts_of_a_key(spark, monkeypatch):
    """What windows of a key share, told in one pass over sorted rows however these are cut, is what single looks tell."""
    rng = np.random.default_rng(14)
    monkeypatch.setattr(substring_dedup, "CHUNK", 7)
    dealt, least = substring_dedup.DEALT, substring_dedup.LEAST
    rows = []
    for _ in range(3000):
        key, before, after = int(rng.integers(-90, 90)), int(rng.choice([0, 22, 23, 45])), int(rng.choice([0, 21, 22, 45]))
        at = int(rng.integers(0, 50)) << 12 | before << 6 | after
        rows.append((key, int(rng.integers(-3, 4 if key % 2 else -2)), at | (dealt if key % 10 == 0 else 0), int(rng.integers(0, 2)) << 16 | int(rng.integers(0, 2))))
    want = []
    for key, doc, at, near in rows:
        mine = [(d, a) for k, d, a, _ in rows if k == key]
        if at < dealt and len({d for d, _ in mine}) == 1:
            continue
        place, shared, heads = at & (dealt - 1), 4 if at >= dealt else 0, []
        fits = lambda a, side: a & 63 >= 22 if side == 1 else a >> 6 & 63 >= 23
        bits = lambda n, side: n >> 16 if side == 1 else n & 0xFFFF
        for side in (1, 2):
            if not fits(place, side):
                continue
            met = sorted((d, a) for k, d, a, n in rows if k == key and fits(a, side) and bits(n, side) == bits(near, side))
            if at >= dealt or met[0][0] != met[-1][0]:
                shared |= side
            d, a = met[0]
            if at < dealt and d != doc and min(a >> 6 & 63, place >> 6 & 63) + min(a & 63, place & 63) + 1 >= least:
                heads.append((d, a))
        want.append((key, doc, place, near, shared, frozenset(heads)))
    table = spark.createDataFrame(rows, "key long, doc long, at long, near long")
    got = [(*r[:5], frozenset(h for h in (r[5:7], r[7:9]) if h[0] is not None)) for r in map(tuple, substring_dedup.grouped(table).collect())]
    assert Counter(got) == Counter(want) and sum(len(w[-1]) for w in want) > 50 and any(len(w[-1]) == 2 for w in want)


def test_stashing_gives_back_memory_beside_the_heap(spark, monkeypatch):
    """What the driver's JVM has freed outside its heap goes back to the system, though blocks in use lie between."""
    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"

    def resident():
        jvm.System.gc()
        with open(status) as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) >> 10

    made = [jvm.java.util.zip.Deflater() for _ in range(400)]  # a quarter of a MB each
    for x in made[::2] + made[1:-1:2]:
        x.end()
    some, before = spark.range(3).withColumnRenamed("id", "doc_id"), resident()
    monkeypatch.setattr(session, "FULL", 0.0)
    for _ in range(session.LOOK):
        session.stash(some, "some")
    after = resident()
    made[-1].end()
    assert before - after > 40
