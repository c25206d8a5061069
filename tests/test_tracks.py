"""Tracks, point lookups and background against positions one by one; evidence and similarity in predictions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codonlake.operators import tracks as T
from codonlake.operators.exons import candidates, from_evidence, predict
from codonlake.sources import params
from tests.test_signals import dna, small_parameters

SEG = "locus string, frame6 int, lo long, hi long, score double"


def projected(segs, mode, unset, logs=False):
    out = {}
    for locus, frame6, lo, hi, score in sorted(segs):
        for p in range(max(lo, 1), hi + 1):
            v = out.get((locus, frame6, p), unset)
            one = score / (hi - lo + 1) if mode == "best" else score / 15.0
            out[locus, frame6, p] = one if v == unset else max(v, one) if mode == "best" else min(v + one, 15.0)
    return {k: math.log(v + 1) if logs else v for k, v in out.items()}


@pytest.mark.parametrize(("mode", "unset", "logs"), [("best", -0.25, False), ("best", 0.0, False), ("cover", 0.0, False), ("cover", 0.0, True), ("cover", 1.0, False)])
def test_sums_of_ranges(spark, mode, unset, logs):
    rng = random.Random(4)
    segs = [(rng.choice("ab"), rng.randrange(2), lo := rng.randrange(-3, 1500), lo + rng.choice([-1, 0, 3, 40, 700]), float(rng.randrange(0 if logs else -40, 300))) for _ in range(150)]
    bins = T.tracks(spark.createDataFrame(segs, SEG), mode, unset, logs).cache()
    ranges = [(i, rng.choice("abc"), rng.randrange(3), a := rng.randrange(-2, 2500), a + rng.randrange(0, 900)) for i in range(80)]
    got = T.with_sums(spark.createDataFrame(ranges, "id long, locus string, frame6 int, a long, z long"), bins, {"total": (F.col("a"), F.col("z"))}, unset)
    known, base = projected(segs, mode, unset, logs), math.log(unset + 1) if logs else unset
    want = {i: sum(known.get((locus, f, p), base) for p in range(max(a, 0) + 1, max(z, 0) + 1)) for i, locus, f, a, z in ranges}
    # a locus and frame without any segment has no bins at all
    for r in got.collect():
        assert r.total == pytest.approx(want[r.id], abs=1e-6)


def test_reads_are_raw(spark):
    segs = [("a", 0, 10, 20, 300.0), ("a", 0, 15, 15, 30.0)]
    row = T.tracks(spark.createDataFrame(segs, SEG), "cover").first()
    assert row.reads[-1] == 3330.0 and row.cum[9] == 20.0 and row.cum[14] - row.cum[13] == 15.0
    assert T.tracks(spark.createDataFrame([], SEG)).collect() == []


def test_background(spark):
    """A plain background goes to nothing; ends of transcription have none on their side."""
    bins = T.tracks(spark.createDataFrame([("a", f, 1, 1000, 2000.0) for f in range(6)] + [("a", f, 401, 410, 50.0) for f in range(6)], SEG), "best").cache()
    rows = [(i, "a", s, t, 400, 409, 0, 1000) for i, (s, t) in enumerate((s, t) for s in "+-" for t in ("First", "Internal", "Terminal", "Single"))]
    e = spark.createDataFrame(rows, "id long, locus string, strand string, type string, left_pos long, right_pos long, frame int, length long")
    plain = {r.id: r.homology for r in T.homology(e, bins).collect()}
    got = {r.id: r.homology for r in T.homology(e, bins, flank=100).collect()}
    assert set(plain.values()) == {45.0}
    for i, (_, _, _, kind, *_) in enumerate(rows):
        left = (5.0 + 99 * 2.0, 100) if kind not in ("First", "Single") else (0, 0)
        right = (200.0, 100) if kind not in ("Terminal", "Single") else (0, 0)
        n = left[1] + right[1]
        assert got[i] == pytest.approx(45.0 - ((left[0] + right[0]) / n * 10 if n else 0.0))


def free_parameters():
    p = params.parse(small_parameters())
    p.isochores[0].values = {k: [1.0 if k.endswith("factor") else -1000.0 if "cutoff" in k else 0.0] * 4 for k in p.isochores[0].values}
    p.rules = params.rules_of(["First+:Internal+ Internal+:Terminal+ 20:400", "Begin+ First+:Single+ 0:Infinity", "Terminal+:Single+ First+:Single+ 50:Infinity", "Terminal+:Single+ End+ 0:Infinity"])
    return p


def test_similarity_raises_the_scores_of_its_exons(spark):
    p, seq = free_parameters(), dna(1200, 11)
    seqs = spark.createDataFrame([("s", len(seq), seq)], "locus string, length long, seq string")
    rows = [("s", 301, 360, 600.0, "+", 1), ("s", 301, 360, 300.0, "-", 4)]
    segs = spark.createDataFrame(rows, "locus string, start long, end long, score float, strand string, frame6 int")
    key = lambda r: (r.strand, r.type, r.lo, r.hi, r.frame)
    plain = {key(r): r for r in candidates(seqs, p).collect()}
    with_ = {key(r): r for r in candidates(seqs, p, segments=segs).collect()}
    assert set(plain) == set(with_)
    changed = 0
    for k, r in with_.items():
        a, b = (r.lo, r.hi) if r.strand == "+" else (1199 - r.hi, 1199 - r.lo)
        f6 = (a + 1 + r.frame) % 3 + (3 if r.strand == "-" else 0)
        lo, hi, per, frame = (301, 360, 10.0, 1) if r.strand == "+" else (841, 900, 5.0, 4)
        want = per * max(0, min(hi, b) - max(lo, a + 1) + 1) if f6 == frame else 0.0
        assert r.homology == pytest.approx(want) and r.score == pytest.approx(plain[k].score + want, abs=1e-3)
        changed += want > 0
    assert changed > 20


def test_forced_evidence_is_in_the_chain(spark):
    p, seq = free_parameters(), dna(1200, 12)
    seqs = spark.createDataFrame([("s", len(seq), seq)], "locus string, length long, seq string")
    schema = "locus string, feature string, start long, end long, score float, strand string, frame int, group string, donor string, acceptor string"
    ev = spark.createDataFrame([("s", "Single", 500, 619, 10000.0, "+", 0, "NON_GROUPED", "U2", "U2"), ("s", "Unknown", 5, 9, 10000.0, "+", 0, "NON_GROUPED", "U2", "U2"), ("t", "Single", 5, 64, 10000.0, "+", 0, "NON_GROUPED", "U2", "U2")], schema)
    assert from_evidence(ev, p.rules).count() == 2
    rows = predict(seqs, p, strands="+", evidence=ev).collect()
    given = [(r.start, r.end_) for r in rows if r.evidence]
    assert given == [(500, 619)]
    assert all(r.end_ < 450 or r.start > 669 or r.evidence for r in rows)
