"""Parameter files, site and coding scores and genes; against a known prediction if its files are named."""

import itertools
import os

import numpy as np
import pytest

from codonlake.operators import signals
from codonlake.sources import formats, params

#: A parameter file, a sequence and the prediction (GFF3, then FASTA) that is known for them.
PARAM, FASTA, GOLD = (os.environ.get(f"KNOWN_{k}", "") for k in ("PARAMETERS", "SEQUENCE", "PREDICTION"))
there = pytest.mark.skipif(not all(map(os.path.isfile, (PARAM, FASTA, GOLD))), reason="set KNOWN_PARAMETERS, KNOWN_SEQUENCE and KNOWN_PREDICTION")


def small_parameters() -> str:
    """A file with words of one base and profiles of two positions."""
    rows = lambda k, f: "\n".join(f"{w} 0 {i} {f(w, i)}" for w in ("".join(x) for x in itertools.product("ACGT", repeat=k)) for i in range(3))
    profile = "\n".join(f"{i} {b} {v}" for i in (1, 2) for b, v in zip("ACGT", (1, 2, 3, 4), strict=True))
    heads = ["Absolute_cutoff_exons", "Coding_cutoff_oligos", "Site_factor", "Exon_factor", "HSP_factor", "Exon_weigths"]
    parts = ["# a comment", "NO_SCORE", "0", "number_of_isochores", "1", "boundaries_of_isochore", "0 100"]
    parts += [x for h in heads for x in (h, "-10 -10 -10 -10")]
    parts += [x for kind in ("Start", "Acceptor", "Donor", "Stop") for x in (f"{kind}_profile", "2 1 5 0", profile)]
    parts += ["Markov_order", "1", "Initial", rows(1, lambda w, i: i), "Transition", rows(2, lambda w, i: -i), "donors", "4", "General_Gene_Model", "First+ Terminal+ 40:100 block", "Begin+ First+ 0:Infinity"]
    return "\n".join(parts)


def test_parameters():
    p = params.parse(small_parameters())
    iso = p.isochores[0]
    assert (iso.low, iso.high, iso.word, iso.donors, len(p.rules)) == (0, 100, 1, 4, 2)
    assert iso.values["Exon_weights"] == [-10.0] * 4 and set(iso.profiles) == {"Start_profile", "Acceptor_profile", "Donor_profile", "Stop_profile"}
    assert iso.initial.tolist() == [[0.0] * 4, [1.0] * 4, [2.0] * 4] and iso.transition.shape == (3, 16)
    assert p.rules[0].block and p.rules[1].most is None


def test_profile_scan(spark):
    iso = params.parse(small_parameters()).isochores[0]
    seq = "ACGTNTTAAGTGA"
    frags = signals.fragments(spark.createDataFrame([("s", len(seq), seq)], "locus string, length long, seq string"), strands="+")
    got = {(r.kind, r.pos): r.score for r in signals.scan(frags, {k: iso.profiles[k] for k in ("Donor_profile", "Stop_profile")}).collect()}
    value = dict(zip("ACGTN", (1, 2, 3, 4, 2.5), strict=True))
    sums = {i + 1: value[seq[i]] + value[seq[i + 1]] for i in range(len(seq) - 1)}
    assert {p: s for (k, p), s in got.items() if k == "Donor_profile"} == {p: s for p, s in sums.items() if s >= 5}
    assert {p for k, p in got if k == "Stop_profile"} == {p for p, s in sums.items() if s >= 5 and seq[p + 1 : p + 4] in ("TAA", "TAG", "TGA")}


def test_unknown_bases_are_means():
    t = params.with_unknown(np.arange(16, dtype=np.float32)[None, :], 2)
    assert t.shape == (1, 25) and t[0, 4] == 1.5 and t[0, 24] == 7.5 and t[0, 5] == 4.0


def test_rules():
    a, b = params.rules_of(["First+:Internal+ Terminal+ 40:23712.339", "Terminal+ Begin+ 0:Infinity block"])
    assert (a.least, a.most, a.block, b.most, b.block) == (40, 23712, False, None, True)
    assert params.rules_of(["A B 0:1  "])[0].block and not params.rules_of(["A B 0:1  "], blanks_block=False)[0].block


def test_fragments_cover_and_overlap(spark):
    seqs = spark.createDataFrame([("s", 25, "ACGTACGTACGTACGTACGTACGTA")], "locus string, length long, seq string")
    f = {(r.frag, r.strand): r for r in signals.fragments(seqs, 10, 4).collect()}
    assert [(f[i, "+"].l1, f[i, "+"].l2) for i in range(4)] == [(0, 9), (6, 15), (12, 21), (18, 24)]
    for (_, strand), r in f.items():
        whole = "ACGTACGTACGTACGTACGTACGTA" if strand == "+" else "TACGTACGTACGTACGTACGTACGT"
        assert r.seq == whole[r.l1 : r.l2 + 1]


def dna(n, seed, letters="ACGT"):
    return "".join(np.random.default_rng(seed).choice(list(letters), n))


def two_isochores():
    """The small file twice, for G+C up to 50 and from 50; the second one asks for more and weighs double."""
    p = params.parse(small_parameters())
    low = p.isochores[0]
    low.values = {k: [0.5 if k.endswith("factor") else -1000.0 if "cutoff" in k else 1.0] * 4 for k in low.values}
    high = params.parse(small_parameters()).isochores[0]
    high.values = {k: [2 * x if k.endswith("factor") or k == "Exon_weights" else x for x in v] for k, v in low.values.items()}
    high.profiles = {k: params.Profile(v.dimension, v.offset, v.cutoff + 1, v.order, v.a, v.b, v.extra, v.weights) for k, v in high.profiles.items()}
    low.high, high.low = 50, 50
    return params.Parameters(p.no_score, [low, high], p.rules)


def test_fragments_give_the_exons_of_the_whole(spark):
    """A locus cut every 800 bases, against one uncut fragment: no exon is lost, doubled or made from half a list of donors,
    as long as every frame is closed within the overlap."""
    from codonlake.operators.exons import candidates

    p = params.parse(small_parameters())
    p.isochores[0].values = {k: [1.0 if k.endswith("factor") else -1000.0] * 4 for k in p.isochores[0].values}
    seqs = spark.createDataFrame([("s", 4000, dna(4000, 5)), ("t", 90, dna(90, 6)), ("u", 0, "")], "locus string, length long, seq string")
    keys = ("locus", "strand", "type", "lo", "hi", "frame", "rest", "left_score", "right_score")
    whole, cut = ([tuple(r[k] for k in keys) for r in candidates(seqs, p, fragment=f, overlap=o).collect()] for f, o in ((5000, 500), (2000, 1200)))
    assert sorted(cut) == sorted(whole) and len(set(cut)) == len(cut) > 1000


def test_isochores_by_fragment_and_exon(spark):
    from codonlake.operators.exons import candidates

    p = two_isochores()
    seqs = spark.createDataFrame([("at", 400, dna(400, 7, "AATTTACG")), ("gc", 400, dna(400, 8, "GGCCACGT"))], "locus string, length long, seq string")
    low, high = (params.Parameters(p.no_score, [iso], p.rules) for iso in p.isochores)
    rows = lambda x: sorted((r.locus, r.strand, r.type, r.lo, r.hi, r.frame, round(r.score, 3)) for r in x.collect())
    got = rows(candidates(seqs, p))
    want = rows(candidates(seqs.where("locus = 'at'"), low)) + rows(candidates(seqs.where("locus = 'gc'"), high))
    assert got == sorted(want) and {x[0] for x in got} == {"at", "gc"}
    assert signals.isochore_of(50.0, [(0, 50), (50, 100)]) == 0 and signals.isochore_of(-1, [(0, 50), (50, 100)]) == 1


@there
def test_printed_scores(spark):
    p = params.read(PARAM).isochores[0]
    frags = signals.fragments(formats.read_fasta(spark, FASTA)).cache()
    length = frags.first().length
    sites = {(r.strand, r.kind.split("_")[0], r.pos): r.score for r in signals.scan(frags, p.profiles).collect()}
    exons, want, n = [], [], 0
    for line in open(GOLD):
        c = line.rstrip("\n").split("\t")
        if len(c) == 9 and c[2] == "CDS":
            start, end, strand, phase = int(c[3]) - 1, int(c[4]) - 1, c[6], int(c[7])
            a, b = (start, end) if strand == "+" else (length - 1 - end, length - 1 - start)
            attrs = dict(x.split("=", 1) for x in c[8].split(";"))
            for kind, pos in (("start", a), ("acceptor", a), ("donor", b)):
                if f"{kind}_score" in attrs:
                    assert sites[strand, kind.capitalize(), pos] == pytest.approx(float(attrs[f"{kind}_score"]), abs=0.0051)
                    n += 1
            last = b - 3 if attrs["exon_type"] in ("Terminal", "Single") else b
            exons.append((len(exons), c[0], 0, strand, a, last, phase))
            want.append(float(attrs["coding_potential"]))
    assert n > 300
    frame = spark.createDataFrame(exons, "exon_id long, locus string, frag long, strand string, left_pos long, right_pos long, frame int")
    got = {r.exon_id: r.potential for r in signals.coding_potentials(frame, frags, p).collect()}
    bad = [(i, got[i], w) for i, w in enumerate(want) if abs(got[i] - w) > 0.0051]
    assert not bad, (len(bad), len(want), bad[:5])


def test_genes_of_small_exons(spark):
    from codonlake.operators.genes import features, genes, introns, with_bases

    seqs = spark.createDataFrame([("s", "CCATGAAAGTCCAGGGTAACC")], "locus string, seq string")
    rows = [("s", 1, "+", "First", 3, 8, 0, 2.0, 1.5, 0.5, 0.1), ("s", 1, "+", "Terminal", 13, 19, 0, 3.0, 0.5, 0.25, 0.75)]
    exons = spark.createDataFrame(rows, "locus string, gene long, strand string, type string, start long, end_ long, frame int, score double, potential double, left_score double, right_score double")
    found = genes(with_bases(exons, seqs))
    g = found.first()
    assert (g.cds, g.protein, g.score, g.n_exons) == ("ATGAAAAGGGTAA", "MKRV", 5.0, 2)
    gap = introns(exons).first()
    assert (gap.start, gap.end_, round(gap.score, 3)) == (9, 12, 0.175)
    assert features(exons, found).count() == 6


@pytest.mark.skipif(not os.environ.get("CODONLAKE_SLOW"), reason="takes minutes; set CODONLAKE_SLOW=1")
@there
def test_known_genes(spark):
    from codonlake.operators.exons import predict
    from codonlake.operators.genes import features, genes, introns, with_bases

    seqs = formats.read_fasta(spark, FASTA).cache()
    exons = predict(seqs, params.read(PARAM, blanks_block=False)).cache()
    got = sorted((r.start, r.end_, r.strand, r.type, round(r.score, 2)) for r in exons.collect())
    want = []
    for line in open(GOLD):
        c = line.rstrip("\n").split("\t")
        if len(c) == 9 and c[2] == "CDS":
            want.append((int(c[3]), int(c[4]), c[6], dict(x.split("=", 1) for x in c[8].split(";"))["exon_type"], float(c[5])))
    assert [x[:4] for x in got] == [x[:4] for x in sorted(want)]
    assert all(abs(a[4] - b[4]) < 0.011 for a, b in zip(got, sorted(want), strict=True))
    found = genes(with_bases(exons, seqs)).cache()
    rows = {r.gene: r for r in found.collect()}
    assert [round(rows[i].score, 2) for i in (1, 2, 3)] == pytest.approx([19.09, 12.51, 1208.40], abs=0.02)
    text, kind, gene = {}, None, 0
    for line in open(GOLD):
        if line.startswith(">"):
            kind, gene = line.split("predicted_")[1].split("_")[0], int(line.rsplit("_", 1)[1])
            text[kind, gene] = ""
        elif kind:
            text[kind, gene] += line.strip()
    for i in (1, 2, 3):
        assert rows[i].cds == text["CDS", i]
        assert rows[i].protein == text["protein", i]
    lines = [r.value for r in formats.gff3_lines(features(exons, found)).collect()]
    assert len(lines) == 3 + 3 + 2 * len(got) and all(x.count("\t") == 8 for x in lines)
    gaps = introns(exons).collect()
    assert len(gaps) == len(got) - 3 and all(r.start <= r.end_ for r in gaps)


def test_running_digests_in_pieces(spark):
    """A sequence of many pieces, an empty one and sums of several widths, as text."""
    from hashlib import md5
    from itertools import accumulate

    from codonlake.operators.signals import PIECE, listed, running_digests

    assert listed(np.array([0, 7, 10, 99, 100, 12345678901])) == b"0,7,10,99,100,12345678901,"
    seqs = [(1, "ACGTN" * 41), (2, ""), (3, dna(PIECE + 7, 5)), (4, "G" * PIECE), (5, "N")]
    got = {r.doc_id: (r.n, r.total, r.digest) for r in running_digests(spark.createDataFrame(seqs, "doc_id long, seq string"), [0, 1, 1, 0, 0]).collect()}
    for i, seq in seqs:
        sums = list(accumulate(int(c in "CG") for c in seq))
        assert got[i] == (len(seq), sums[-1] if sums else 0, md5(",".join(map(str, sums)).encode()).hexdigest())


def test_track_of_a_long_text_is_no_row(spark, tmp_path):
    """Running sums of 40 million bases never are a row: as an array of texts they took more than the heap."""
    from hashlib import md5

    from codonlake.plans.signals import gc_prefix

    n, track = 40_000_000, md5()
    spark.range(1).selectExpr("id as doc_id", f"repeat('Abc', {n // 3} + 1) as text").write.parquet(str(tmp_path / "documents.parquet"))
    for at in range(0, n // 3 + 1, 100_000):
        track.update("".join(f"{',' if i else ''}{2 * i},{2 * i + 1},{2 * i + 2}" for i in range(at, min(at + 100_000, n // 3 + 1))).encode())
    row = gc_prefix(spark, str(tmp_path)).first()
    assert (row.n, row.total, row.digest) == (3 * (n // 3 + 1), 2 * (n // 3 + 1), track.hexdigest())


def test_texts_without_letters_have_an_empty_track(spark, tmp_path):
    """Asking an empty array for its last element is an error."""
    import duckdb

    from codonlake.plans.signals import ORACLES, gc_prefix

    rows = [(1, "abc"), (2, ""), (3, None), (4, "123 ... 456"), (5, "\u0434 \u4e2d")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(at := str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/*.parquet'")
    want = con.execute(ORACLES["gc_prefix"]).fetchall()
    assert sorted(map(tuple, gc_prefix(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 5
