"""Branch points, tracts and minor classes against windows looked at one by one; predictions with minor introns."""

import numpy as np
import pytest

from codonlake.operators import splice as S
from codonlake.operators.exons import candidates, predict, thresholds
from codonlake.operators.signals import digits, fragments
from codonlake.sources import params
from tests.test_signals import dna, small_parameters

F4 = np.float32


def profile(seed, dimension, offset, cutoff, order=0, a=0.0, b=1.0, extra=()):
    rng = np.random.default_rng(seed)
    table = np.round(rng.normal(0, 2, (dimension, 4 ** (order + 1))) * 4) / 4
    return params.Profile(dimension, offset, cutoff, order, a, b, extra, params.with_unknown(table.astype(np.float32), order + 1))


def window(d, p, i):
    """The raw score of the window that begins at i."""
    s = F4(0)
    for j in range(p.dimension):
        w = 0
        for t in range(i + j - p.order, i + j + 1):
            w = 5 * w + int(d[t])
        s += p.weights[j][w]
    return s


def searched(d, p, acc, minor):
    context, least, usual, penalty = S.place_of(p)
    best, at = F4(-np.inf), 0
    end = min(acc - least + p.dimension - p.offset, len(d) - 1, *(() if minor else (acc,)))
    for i in range(max(p.order, acc - context), end - p.dimension + 1):
        x = F4(abs(i + p.offset - max(0, acc - usual))) / F4(context - p.offset - usual)
        s = window(d, p, i) - F4(penalty) * (x * x)
        if not minor:
            s = F4(p.a) + F4(p.b) * s
        if s >= best and (minor or s > F4(p.cutoff)):
            best, at = s, i + p.offset - acc
    return best, at


@pytest.mark.parametrize("minor", [False, True])
@pytest.mark.parametrize("p", [profile(1, 5, 2, 1.5), profile(2, 7, 4, 0.0, 1, 0.5, 2.0, (40.0, 9.0, 14.0, 5.0)), profile(3, 4, 1, 3.0, 2)])
def test_branch_points(p, minor):
    d = digits(dna(400, 9, "ACGTN").encode())
    acc = np.array([0, 3, 6, 11, 20, 49, 50, 51, 200, 333, 390, 399])
    score, at = S.branch_points(d, p, acc, minor)
    for a, s, x in zip(acc.tolist(), score, at.tolist(), strict=True):
        want = searched(d, p, a, minor)
        assert (s, x) == want
    assert np.isfinite(score).sum() >= 4


def test_tracts():
    d, p = digits(dna(300, 10).encode()), profile(5, 6, 1, 2.0)
    acc, branch = np.array([5, 60, 150, 299]), np.array([-3, -20, -12, -30])
    for behind in (None, branch):
        score, at = S.tracts(d, p, acc, behind)
        for k, a in enumerate(acc.tolist()):
            low = max(p.order, a - 7 - p.dimension, *(() if behind is None else (a + int(behind[k]) + 1,)))
            fits = [(window(d, p, i), i) for i in range(low, min(a, len(d) - 1) - p.dimension + 1)]
            fits = [x for x in fits if behind is not None or x[0] > F4(p.cutoff)]
            want = max(fits) if fits else (F4(-np.inf), a - p.offset)
            assert (score[k], at[k]) == (want[0], want[1] + p.offset - a)


@pytest.mark.parametrize("order", [0, 1, 2])
def test_left_edge(order):
    d, p = digits(dna(30, 3).encode()), profile(7, 6, 4, 0.0, order)
    pos, raw = S.left_edge(d, p)
    assert pos.tolist() == [k + order for k in range(4)]
    for k in range(4):
        want = F4(0)
        for i in range(4 - k, 6):
            w = 0
            for t in range(i - 4 + k, i - 4 + k + order + 1):
                w = 5 * w + int(d[t])
            want += p.weights[i][w]
        assert raw[k] == want


def minor_parameters():
    """The small file with all splice profiles; branch points of both classes and a tract."""
    p = params.parse(small_parameters())
    iso = p.isochores[0]
    iso.values = {k: [1.0 if k.endswith("factor") else -1000.0 if "cutoff" in k else 0.0] * 4 for k in iso.values}
    iso.values |= {"U12_Splice_Score_Threshold": [5.0], "U12_Exon_Score_Threshold": [-50.0], "U12_Exon_weight": [2.5]}
    iso.profiles |= {
        "Acceptor_profile": profile(11, 4, 2, 2.0), "U12gtag_Acceptor_profile": profile(12, 4, 2, 6.0, 0, 0.0, 0.5), "U12atac_Acceptor_profile": profile(13, 4, 2, 7.0), "Donor_profile": profile(14, 4, 1, 4.0),
        "U12gtag_Donor_profile": profile(15, 4, 1, 5.0), "U12atac_Donor_profile": profile(16, 4, 1, 6.0), "U2gcag_Donor_profile": profile(17, 4, 1, 7.0),
        S.BRANCH: profile(18, 5, 2, 0.5), S.MINOR_BRANCH: profile(19, 5, 2, 1.0), S.TRACT: profile(20, 6, 1, 2.0),
    }
    p.rules = params.rules_of(["First+:Internal+ Internal+:Terminal+ 20:400", "Begin+ First+:Single+ 0:Infinity", "Terminal+:Single+ First+:Single+ 50:Infinity", "Terminal+:Single+ End+ 0:Infinity"])
    return p


def test_two_stages(spark):
    p = minor_parameters()
    seq = dna(700, 21)
    d, prof = digits(seq.encode()), p.isochores[0].profiles
    frags = fragments(spark.createDataFrame([("s", len(seq), seq)], "locus string, length long, seq string"), strands="+")
    got = {(r.subtype, r.pos): (F4(r.score), F4(r.bp), r.bp_at) for r in S.scan_sites(frags, p.isochores).where("kind = 'acceptor'").collect()}
    want = {}
    for head, bp in (("Acceptor_profile", S.BRANCH), ("U12gtag_Acceptor_profile", S.MINOR_BRANCH), ("U12atac_Acceptor_profile", S.MINOR_BRANCH)):
        a, _, sub = prof[head], *S.FAMILIES[head][:1], S.FAMILIES[head][2]
        minor = sub != "U2"
        edge = dict(zip(*[x.tolist() for x in S.left_edge(d, a)], strict=True))
        for pos in range(len(d)):
            i = pos - a.offset
            raw = F4(edge[pos]) if i < 0 else window(d, a, i) if i + a.dimension <= len(d) else None
            if raw is None or raw < F4(a.cutoff) + (F4(-7) * F4(a.b) if minor else F4(0)):
                continue
            b, at = searched(d, prof[bp], pos, minor)
            if not np.isfinite(b) or (minor and b < F4(prof[bp].cutoff)):
                continue
            s = F4(a.a) + F4(a.b) * (raw + b)
            if s >= F4(a.cutoff):
                want[sub, pos] = (s, b, at)
    assert got == want
    assert {k[0] for k in got} == {"U2", "U12gtag", "U12atac"}
    assert S.scan_sites(frags, p.isochores, minor=False).where("cls > 0").isEmpty()


def test_minor_introns_join_equal_classes(spark):
    p = minor_parameters()
    assert thresholds(p) == (5.0, -50.0)
    seqs = spark.createDataFrame([("s", 2500, dna(2500, 33))], "locus string, length long, seq string")
    e = candidates(seqs, p, strands="+").cache()
    both = e.where("left_cls > 0 and right_cls > 0")
    assert both.count() > 0
    # the weight of exons between two minor introns is in their scores
    r = both.first()
    assert r.score == pytest.approx(r.left_score + r.right_score + r.potential + 2.5, abs=1e-3)
    rows = sorted(predict(seqs, p, strands="+").collect(), key=lambda r: r.start)
    assert rows
    for x, y in zip(rows, rows[1:]):
        if x.gene == y.gene:
            assert x.rclass == y.lclass
            if x.rclass:
                assert x.rscore + y.lscore > 5.0


def test_introns_are_classified(spark):
    """Ends on both strands, by the scores of the sites that lie there."""
    p = minor_parameters()
    seqs = spark.createDataFrame([("s", 1200, dna(1200, 77))], "locus string, length long, seq string")
    sites = S.scan_sites(fragments(seqs), p.isochores).cache()
    known: dict = {}
    for r in sites.where("kind in ('donor', 'acceptor')").collect():
        key = (r.strand, r.kind, r.pos, r.cls > 0)
        known[key] = max(known.get(key, (-100.0, "")), (r.score, r.subtype))
    rng = np.random.default_rng(6)
    pick = lambda strand, kind: [k[2] for k in known if k[:2] == (strand, kind)]
    rows = []
    for strand in "+-":
        for _ in range(60):
            d, a = int(rng.choice(pick(strand, "donor"))), int(rng.choice(pick(strand, "acceptor")))
            d, a = (d + int(rng.integers(0, 2)) * 3, a) if rng.random() < 0.3 else (d, a)
            if d + 2 < a:
                rows.append(("s", strand, d + 2, a) if strand == "+" else ("s", strand, 1200 + 1 - a, 1200 - 1 - d))
    got = S.classify(spark.createDataFrame(sorted(set(rows)), "locus string, strand string, start long, end_ long"), sites, seqs).collect()
    kinds = set()
    for r in got:
        d, a = (r.start - 2, r.end_) if r.strand == "+" else (1199 - r.end_, 1201 - r.start)
        at = lambda kind, pos, minor: known.get((r.strand, kind, pos, minor), (-100.0, ""))[0]
        u2, u12 = [at("donor", d, False), at("acceptor", a, False)], [at("donor", d, True), at("acceptor", a, True)]
        types = ["U12" if y > 0 and y > x else "U2" if x > -100 else "unknown" for x, y in zip(u2, u12, strict=True)]
        want = "U2" if sum(u2) > sum(u12) else "U12" if sum(u12) >= 2 and min(u12) > -1 else "U2" if "unknown" not in types else "non-canonical"
        assert (r.donor_type, r.acceptor_type, r.intron_type) == (*types, want)
        kinds.add(want)
    assert {"U2", "U12"} <= kinds
