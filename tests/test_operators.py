import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonlake.functions import dna
from codonlake.operators import ranges as R
from codonlake.operators.chains import Rule, best_chain


def test_reverse_complement_and_digits(spark):
    row = spark.createDataFrame([("ACGTNRa",)], "s string").select(dna.reverse_complement(F.upper("s")).alias("r"), dna.digit(F.lit("u")).alias("u"), dna.digit(F.lit("x")).alias("x")).first()
    assert (row.r, row.u, row.x) == ("TNNACGT", 3, 4)


def test_range_join_is_complete_and_has_no_duplicates(spark):
    rnd = random.Random(3)
    left = [(rnd.choice("ab"), i, lo := rnd.randint(-50, 300), lo + rnd.randint(-3, 90)) for i in range(60)]
    right = [(rnd.choice("ab"), rnd.randint(-60, 400)) for _ in range(120)]
    got = R.range_join(spark.createDataFrame(left, "k string, i long, lo long, hi long"), spark.createDataFrame(right, "k string, pos long"), ["k"], "lo", "hi", "pos", 16)
    want = sorted((k, i, p) for (k, i, lo, hi), (k2, p) in itertools.product(left, right) if k == k2 and lo <= p < hi)
    assert sorted((r.k, r.i, r.pos) for r in got.collect()) == want


def test_sweep_counts_depth(spark):
    rows = [("x", 0, 5), ("x", 3, 9), ("x", 5, 6), ("x", 20, 20)]
    got = [(r.start, r.end, r.depth) for r in R.sweep(spark.createDataFrame(rows, "k string, a long, b long"), ["k"], "a", "b").orderBy("start").collect()]
    assert got == [(0, 3, 1), (3, 5, 2), (5, 6, 2), (6, 9, 1)]


def test_without_near(spark):
    left = spark.createDataFrame([("x", 10), ("x", 30), ("y", 10)], "k string, pos long")
    right = spark.createDataFrame([("x", 7), ("x", 33)], "k string, pos long")
    assert sorted((r.k, r.pos) for r in R.without_near(left, right, ["k"], "pos", 3, 3).collect()) == [("x", 30), ("y", 10)]


def brute_chain(left, right, kind, score, group, rules):
    total, before = [float(s) for s in score], [-1] * len(left)
    for e in range(len(left)):
        for r in rules:
            if kind[e] not in r.down:
                continue
            ok = [p for p in range(e) if kind[p] in r.up and total[p] > 0 and r.least <= left[e] - right[p] and (r.most is None or left[e] - right[p] <= r.most)]
            if ok:
                p = max(ok, key=lambda p: total[p])
                if (not r.block or group[p] == group[e]) and total[p] + score[e] > total[e]:
                    total[e], before[e] = total[p] + score[e], p
    return total, before


def test_best_chain_matches_brute_force():
    rnd = random.Random(5)
    rules = [Rule(frozenset("ab"), frozenset("c"), 1, 40), Rule(frozenset("c"), frozenset("ab"), 0, None, True), Rule(frozenset("c"), frozenset("c"), 3, 15)]
    for _ in range(200):
        n = rnd.randint(0, 25)
        left = np.array(sorted(rnd.randint(0, 120) for _ in range(n)), np.int64)
        right = left + np.array([rnd.randint(0, 20) for _ in range(n)], np.int64)
        kind, group = [rnd.choice("abc") for _ in range(n)], [rnd.choice("gh") for _ in range(n)]
        score = np.array([rnd.random() * 10 - 3 for _ in range(n)])
        total, _ = best_chain(left, right, kind, score, group, rules)
        want, _ = brute_chain(left.tolist(), right.tolist(), kind, score.tolist(), group, rules)
        assert np.allclose(total, want)


def test_best_predecessor_that_fails_has_no_second_choice():
    rules = [Rule(frozenset("a"), frozenset("b"), 0, None, True)]
    total, before = best_chain(np.array([0, 1, 10]), np.array([2, 3, 12]), ["a", "a", "b"], np.array([5.0, 3.0, 1.0]), ["g", "h", "h"], rules)
    assert total.tolist() == [5.0, 3.0, 1.0] and before.tolist() == [-1, -1, -1]


def test_sweep_in_bins_is_the_same(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("xyz"), a := rnd.randint(-50, 400), a + rnd.randint(0, 120)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "k string, a long, b long")
    want = sorted(map(tuple, R.sweep(frame, ["k"], "a", "b").collect()))
    for size in (1, 7, 100, 10_000):
        assert sorted(map(tuple, R.sweep(frame, ["k"], "a", "b", size).collect())) == want


def test_options_that_do_not_go_together():
    from codonlake.operators.options import Options

    assert Options(format="gff3", proteins=True, utr=True, homology="h.gff").check().format == "gff3"
    for bad in ({"assemble": "x", "predict_only": True}, {"assemble": "x", "evidence": "e"}, {"predict_only": True, "proteins": True}, {"format": "xml", "sites": frozenset({"Donor"})}, {"format": "gff2", "coding": True}, {"utr": True}, {"homology": "h", "reads_per_million": 1.0}, {"strands": "*"}, {"format": "html"}, {"first_base": 5, "last_base": 4}):
        with pytest.raises(ValueError):
            Options(**bad).check()


def test_one_gene_rules_keep_one_whole_gene():
    from codonlake.operators.exons import best_genes
    from codonlake.operators.options import one_gene_rules

    gene = [("+", "First", 10, 40, 0, 0, 5.0, 0, 0), ("+", "Terminal", 100, 150, 0, 0, 6.0, 0, 0)]
    other = [("+", "Single", 300, 400, 0, 0, 9.0, 0, 0)]
    assert best_genes(gene + other, 500, one_gene_rules()) == [0, 1]
    assert best_genes(other, 500, one_gene_rules()) == [0]
