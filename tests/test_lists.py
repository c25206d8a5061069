"""Exons of sorted lists of sites, against SQL, pairs one by one, and plans."""

import random
from collections import Counter

import duckdb
import numpy as np

from codonlake.functions.dna import AS_BASES, LETTERS, STOPS
from codonlake.operators import exons as X
from codonlake.operators import lists as L
from codonlake.operators.signals import motif_sites
from codonlake.plans import files
from codonlake.plans.signals import sequences
from pyspark.sql import functions as F

LETTER = {b: LETTERS[AS_BASES.index(b)] for b in "ACGTN"}
COLUMNS = ["doc_id", "kind", "left_pos", "right_pos", "frame", "rest", "left_score", "right_score"]


def texts(spark, path, rows):
    found = [(i, t if t is None else "".join(LETTER[b] for b in t)) for i, t in rows]
    spark.createDataFrame(found, "doc_id long, text string").coalesce(1).write.parquet(path)


def odd_rows():
    rng = random.Random(4)
    words = ["ATG", "AG", "GTA", "GTAC", "A", "C", "G", "T", "N", "TAAC", "TAG", "TGA"]
    some = ["".join(rng.choice(words[: rng.choice([9, 12])]) for _ in range(rng.choice([0, 1, 2, 60, 400]))) for _ in range(60)]
    whole = ["TAA", "ATGGTA", "ATGGTAC", "", "AGC" * 9 + "GTAC", "TAATAA", "CTAA", "ATG" + "C" * 54 + "TAG", "ATG" + "C" * 51 + "TAG"]
    return [(7 * i, t) for i, t in enumerate(some + whole)] + [(-3, None), (-11, some[-1] + whole[-1] * 3)]


def test_exons_of_texts_are_never_dealt(spark, tmp_path):
    """Odd texts (null, empty, short, without stops) in one task, against SQL; the plan has no exchange."""
    texts(spark, at := str(tmp_path / "documents.parquet"), odd_rows())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/*.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({files.ORACLES['exons_built']})").fetchall()
    found = files.exons_built(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select(*COLUMNS).collect())) == sorted(want) and set(Counter(r[1] for r in want)) == set(X.TYPES)

    sites = motif_sites(sequences(spark, str(tmp_path)), {"start": ("ATG",), "stop": STOPS, "acceptor": tuple("AG" + b for b in "ACGTN"), "donor": tuple("GTA" + b for b in "ACGTN")})
    score = F.expr("cast((pos * 7919 + doc_id * 31) % 1000 as float)")
    sites = sites.where("kind != 'stop' or pos > 0").select(F.col("doc_id").cast("string").alias("locus"), F.lit(0).alias("frag"), F.lit("+").alias("strand"), "kind", F.expr("pos - if(kind = 'stop', 1, 0)").alias("pos"), score.alias("score"))
    built = X.build(sites, files.MOST_DONORS)
    assert built._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = [(int(r.locus), r.type, r.left_pos, r.right_pos, r.frame, r.rest, int(r.left_score), int(r.right_score)) for r in built.collect()]
    assert sorted(got) == sorted(want)


def test_a_long_text_without_stops_is_not_quadratic(spark, tmp_path):
    """Each of 150,000 starts has all donors behind it (11 thousand million pairs): the best ones are found without meeting them."""
    n = 150_000
    texts(spark, str(tmp_path / "documents.parquet"), [(2, "ATGGTACC" * n)])
    got = files.exons_built(spark, str(tmp_path)).collect()
    want, best = [], []
    for i in range(n - 1, -1, -1):
        d = 8 * i + 3
        best = sorted([(-((d * 7919 + 62) % 1000), d), *best])[: files.MOST_DONORS]
        want += [(8 * i, at, -score) for score, at in best]
    assert {r.kind for r in got} == {"First"} and sorted((r.left_pos, r.right_pos, r.right_score) for r in got) == sorted(want)


def test_first_members_of_runs():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 64, 300):
        order = rng.permutation(n)
        rank = np.argsort(order)
        lo, hi = np.sort(rng.integers(0, n + 1, (2, 200)), 0)
        for k in (1, 3, 8):
            run, one = L.Best(order).first(lo, hi, k)
            got = {}
            for r, m in zip(run.tolist(), one.tolist(), strict=True):
                got.setdefault(r, []).append(m)
            for r in range(200):
                assert sorted(got.get(r, [])) == sorted(sorted(range(lo[r], hi[r]), key=rank.__getitem__)[:k])


def brute(group, sites, most, least):
    """Exons of one fragment and strand from pairs one by one."""
    of = {k: sorted(s for s in sites if s[0] == k) for k in ("start", "acceptor", "donor", "stop")}
    far, out, none = max(s[1] for s in sites) + 1, [], 1 << 40
    rest = lambda a, b, f: (3 - (b - (a + f) + 1) % 3) % 3
    stop = lambda p, f: min(((s[1], s[2]) for s in of["stop"] if s[1] + 1 >= p and (s[1] + 1 - p - f) % 3 == 0), default=None)
    for _, p, score, _ in of["start"]:
        end = stop(p, 0)
        fits = sorted((-d[2], d[1], d[3]) for d in of["donor"] if p + 2 <= d[1] < (end[0] + 3 if end else far))[:most]
        out += [(*group, "First", p, at, 0, rest(p, at, 0), score, -s, 0, c) for s, at, c in fits]
        if end and end[0] + 4 - p >= 60:
            out.append((*group, "Single", p, end[0], 0, 0, score, end[1], 0, 0))
    for _, p, score, cls in of["acceptor"]:
        ends = [stop(p, f) for f in range(3)]
        out += [(*group, "Terminal", p, e[0], f, 0, score, e[1], cls, 0) for f, e in enumerate(ends) if e and e[0] >= p]
        ends = [e[0] + 3 if e else none for e in ends]
        fits = sorted((-d[2], -d[1], d[3]) for d in of["donor"] if p + 18 <= d[1] < min(max(ends), far))[:most]
        out += [(*group, "Internal", p, -at, f, rest(p, -at, f), score, -s, cls, c) for s, at, c in fits for f in range(3) if -at < ends[f]]
        out += [(*group, "RSS", p, d[1], f, f, score, d[2], cls, d[3]) for d in of["donor"] for f in range(3) if d[1] == p - 1 and d[2] > least[0] and score > least[1]]
    for phase in range(3):
        own = [s for s in of["stop"] if s[1] % 3 == phase]
        out += [(*group, "ORF", a[1], b[1], 0, 0, a[2], b[2], 0, 0) for a, b in zip(own, own[1:], strict=False) if b[1] + 4 - a[1] >= 60]
    return out


def test_exons_with_classes_of_fragments_and_strands(spark):
    rng, want, rows = random.Random(9), [], []
    for group in (("a", 0, "+"), ("a", 0, "-"), ("a", 1, "+"), ("b", 0, "+"), ("c", 0, "+")):
        length, sites = rng.choice([150, 700]), []
        for kind, n, classes in (("start", 20, 1), ("acceptor", 30, 3), ("donor", 30, 3), ("stop", 12, 1)):
            if kind != "stop" or group[0] != "b":
                sites += [(kind, p, float(rng.randrange(6)), c) for c in range(classes) for p in rng.sample(range(length), n)]
        rows += [(*group, *s) for s in sites]
        want += brute(group, sites, 3, (1.0, 2.0))
    sites = spark.createDataFrame(rows, "locus string, frag long, strand string, kind string, pos long, score float, cls int")
    got = sorted(map(tuple, X.build(sites, 3, (1.0, 2.0), True).collect()))
    assert got == sorted(want) and {r[3] for r in got} == {*X.TYPES, *X.LIKE}
    assert X.build(sites.where("kind = 'stop' and pos = 1"), 3).count() == 0
