"""Transcript ends from coverage, edge scores and the seven joins, against positions and pairs one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codonlake.operators import tracks as T
from codonlake.operators import utr as U

SEG = "locus string, frame6 int, lo long, hi long, score double"


def covered(spark, rng, length, n=14):
    segs = []
    for frame6 in (0, 3):
        for _ in range(n):
            lo = rng.randrange(1, length - 40)
            segs.append(("a", frame6, lo, min(length, lo + rng.choice([5, 40, 200, 506])), float(rng.choice([3, 15, 60, 200]))))
    return segs, T.tracks(spark.createDataFrame(segs, SEG), "cover", logs=True)


def values(segs, frame6, length):
    v = [0.0] * (length + 20)
    seen = set()
    for _, f, lo, hi, score in sorted(segs):
        if f == frame6:
            for p in range(lo, hi + 1):
                v[p] = min(v[p] + score / 15, 15.0) if p in seen else score / 15
                seen.add(p)
    return [math.log(x + 1) for x in v]


def slope(v, pos, length):
    q = pos + 1
    return 10 * (sum(v[q + 1 : q + 7]) / 6 - sum(v[q - 5 : q + 1]) / 6) if q - 6 >= 0 and pos + 6 < length - 1 else 0.0


def searched(segs, frame6, length):
    v, out = values(segs, frame6, length), set()
    for kind, sign, least in (("tss", 1, 1.2), ("tes", -1, 8.0)):
        before2 = before = 0.0
        for pos in range(length):
            q, now, edge = pos + 1, sign * slope(v, pos, length), 0
            if q - 2 >= 0 and pos + 1 < length - 1:
                edge = 1 if v[q - 1] == 0 and v[q] > 0 else 0
                edge = -1 if v[q] > 0 and v[q + 1] == 0 else edge
            peak = before > least and before > before2 + 1e-9 and before > now + 1e-9
            if edge == sign or peak:
                out.add((kind, pos - 1, round(before, 6)))
            before2, before = before, now
    return out


@pytest.mark.parametrize("seed", range(4))
def test_edges(spark, seed):
    length = 7000
    segs, bins = covered(spark, random.Random(seed), length)
    lengths = spark.createDataFrame([("a", length)], "locus string, length long")
    got = {s: {(r.kind, r.pos, round(r.score, 6)) for r in U.edges(bins, lengths).collect() if r.strand == s} for s in "+-"}
    for strand, frame6 in (("+", 0), ("-", 3)):
        want = {x for x in searched(segs, frame6, length) if x[1] >= 0}
        assert {x[:2] for x in got[strand]} == {x[:2] for x in want}
        assert all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(sorted(got[strand]), sorted(want), strict=True))
        assert len(want) > 4


def test_strong_sites_hide_ends(spark):
    bins = T.tracks(spark.createDataFrame([("a", 0, 301, 900, 150.0)], SEG), "cover", logs=True).cache()
    lengths = spark.createDataFrame([("a", 2000)], "locus string, length long")
    at = {r.kind: r.pos for r in U.edges(bins, lengths).collect()}
    assert set(at) == {"tss", "tes"}
    site = "locus string, strand string, kind string, pos long, score double"
    for kind, pos, score, left in (("acceptor", at["tss"] - 3, 6.0, {"tes"}), ("acceptor", at["tss"] + 3, 6.0, {"tss", "tes"}), ("acceptor", at["tss"], 5.0, {"tss", "tes"}), ("donor", at["tes"] + 2, 9.0, {"tss"}), ("donor", at["tss"], 9.0, {"tss", "tes"})):
        sites = spark.createDataFrame([("a", "+", kind, pos, score)], site)
        names = [r.kind for r in U.termini(bins, lengths, sites).where(f"pos in ({at['tss']}, {at['tes']})").collect()]
        assert set(names) == left


def test_edge_scores(spark):
    length, rng = 1500, random.Random(8)
    segs, bins = covered(spark, rng, length)
    rows = [("a", s, k, p, 2.0) for s in "+-" for k in ("acceptor", "donor", "start") for p in rng.sample(range(length), 25)]
    sites = spark.createDataFrame(rows, "locus string, strand string, kind string, pos long, score float")
    got = {(r.strand, r.kind, r.pos): r.score for r in U.with_edges(sites, bins, spark.createDataFrame([("a", length)], "locus string, length long")).collect()}
    for _, s, k, p, score in rows:
        e = slope(values(segs, 3 if s == "-" else 0, length), p, length)
        assert got[s, k, p] == pytest.approx(score + {"acceptor": e, "donor": -e, "start": 0}[k], abs=1e-4)


def test_seven_joins(spark):
    rng = random.Random(2)
    rows = [(f, rng.choice("+-"), k, p, float(rng.randrange(10))) for f in (0, 1) for k in ("tss", "tes", "acceptor", "donor", "start", "stop") for p in rng.sample(range(9000), 120)]
    got = {}
    for r in U.build(spark.createDataFrame(rows, "frag int, strand string, kind string, pos long, score double"), ["frag", "strand"]).collect():
        got.setdefault((r.frag, r.strand, r.type, r.left_pos), []).append(r.right_pos)
    want = {}
    for kind, a, b, most in U.KINDS:
        for f, s, k, p, _ in rows:
            if k == a:
                fits = sorted((-(y[4] - 0.002 * (y[3] - p + 1)), y[3]) for y in rows if y[:3] == (f, s, b) and p < y[3] < p + most)
                if fits:
                    want[f, s, kind, p] = [x[1] for x in fits[:8]]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {k[2] for k in got} == {k[0] for k in U.KINDS}


def test_prediction_with_coverage(spark):
    """Two coding exons with untranslated ends that coverage shows, on either strand, become one gene with its halves."""
    from codonlake.functions.dna import reverse_complement
    from codonlake.operators.exons import candidates, predict
    from codonlake.sources import params
    from tests.test_signals import dna
    from tests.test_tracks import free_parameters

    p = free_parameters()
    p.rules = params.rules_of(["UTR_First_Half+ Single+ 1:1", "Single+ UTR_Terminal_Half+ 1:1", "UTR_Terminal_Half- Single- 1:1", "Single- UTR_First_Half- 1:1", "Begin+ UTR_First_Half+:UTR_Terminal_Half-:Single+:Single- 0:Infinity", "UTR_Terminal_Half+:UTR_First_Half-:Single+:Single- End+ 0:Infinity"])
    p.isochores[0].values["HSP_factor"] = [5.0] * 4
    seq = dna(1500, 44)
    seq = seq[:190] + "A" * 20 + seq[210:1190] + "A" * 20 + seq[1210:]  # no splice site hides the edges
    seqs = spark.createDataFrame([("f", len(seq), seq)], "locus string, length long, seq string")
    seqs = seqs.unionByName(seqs.select(F.lit("r").alias("locus"), "length", reverse_complement(F.col("seq")).alias("seq")))
    rows = [("f", 201, 1200, 150.0, "+", f) for f in range(3)] + [("r", 301, 1300, 150.0, "-", f + 3) for f in range(3)]
    segs = spark.createDataFrame(rows, "locus string, start long, end long, score float, strand string, frame6 int")
    e = candidates(seqs, p, segments=segs, utr=True)
    kinds = {(r.locus, r.strand, r.type): r.n for r in e.groupBy("locus", "strand", "type").agg(F.count("*").alias("n")).collect()}
    assert {("f", "+", "UTR_First_Half"), ("f", "+", "UTR_Terminal_Half"), ("r", "-", "UTR_First_Half")} <= set(kinds)
    assert all(kinds["f", "+", t] == kinds["r", "-", t] for t in ("UTR_First_Half", "UTR_Terminal_Half", "First", "Internal"))
    got = sorted((r.locus, r.start, r.end_, r.strand, r.type) for r in predict(seqs, p, segments=segs, utr=True).collect())
    f, r = ([x[1:] for x in got if x[0] == locus] for locus in "fr")
    assert [(1501 - b, 1501 - a, "-", t) for a, b, _, t in reversed(f)] == r
    assert [x[3] for x in f] == ["UTR_First_Half", "Single", "UTR_Terminal_Half"]
    assert f[0][1] + 1 == f[1][0] and f[1][1] + 1 == f[2][0]
    assert abs(f[0][0] - 200) < 4 and abs(f[2][1] - 1200) < 4


def test_pieces_of_a_sequence_are_joined_once(spark):
    """Sites of a long sequence are dealt to pieces; pairs over a border come up, and each once, as in one piece."""
    rng = random.Random(7)
    rows = [("a", k, p, float(rng.randrange(10)), rng.randrange(2)) for k in ("tss", "tes", "acceptor", "donor", "start", "stop") for p in rng.sample(range(40000), 400)]
    sites = spark.createDataFrame(rows, "locus string, kind string, pos long, score double, cls int")
    cols = ["type", "left_pos", "left_cls", "right_pos", "right_cls", "left_score", "right_score"]
    whole, cut = (sorted(map(tuple, U.build(sites, ["locus"], piece).select(*cols).collect())) for piece in (1 << 17, U.REACH))
    assert whole == cut and len(whole) > 2000 and len(set(cut)) == len(cut)
    assert U.build(sites.where("kind = 'tss'"), ["locus"]).count() == 0


def test_untranslated_exons_of_texts_are_never_dealt(spark, tmp_path):
    """Odd texts (null, empty, short, of motifs only) in one task, against SQL; the plan has no exchange."""
    import duckdb

    from codonlake.functions.dna import AS_BASES, LETTERS
    from codonlake.plans import coverage

    letter = {b: LETTERS[AS_BASES.index(b)] for b in "ACGTN"}
    rng = random.Random(3)
    texts = ["".join(rng.choice([*U_MOTIFS, "ACGTN"[rng.randrange(5)]]) for _ in range(rng.choice([0, 1, 3, 200, 900]))) for _ in range(40)] + ["TAATAA" * 900, "", "TA"]
    rows = [(i * 5, "".join(letter[b] for b in t)) for i, t in enumerate(texts)] + [(-3, None), (-8, "".join(letter[b] for b in texts[0] + "TATAAGTAAGTAATAA"))]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(at)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/*.parquet'")
    found = coverage.utr_exons(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    cols = ["doc_id", "type", "left_pos", "right_pos", "left_score", "right_score"]
    want = con.execute(f"select {', '.join(cols)} from ({coverage.ORACLES['utr_exons']})").fetchall()
    assert sorted(map(tuple, found.select(*cols).collect())) == sorted(want) and len(want) > 5000


U_MOTIFS = ("TATAA", "AATAA", "CAGG", "TAGG", "GTAAG", "GTGAG", "ATGG", "TAA")


def test_pairs_come_out_in_pieces(monkeypatch):
    """However few pairs are looked at at once (a left site with all of its own at least), they are the same."""
    import numpy as np

    from codonlake.operators.lists import Sites

    rng = np.random.default_rng(1)
    sites = {k: Sites(np.sort(rng.choice(20000, 900, False)), rng.integers(0, 5, 900).astype(float), np.zeros(900, np.int32)) for k in ("tss", "tes", "acceptor", "donor", "start", "stop")}
    whole, parts = [], []
    for size, out in ((1 << 40, whole), (64, parts)):
        monkeypatch.setattr(U, "PAIRS", size)
        n = 0
        for name, x, y in U.paired(sites, sites):
            n += 1
            out += zip([name] * len(x.at), x.at.tolist(), y.at.tolist(), strict=True)
    assert sorted(whole) == sorted(parts) and n > 1000
