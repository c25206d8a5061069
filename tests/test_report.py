"""The ordered report: lines, ranges of amino acids over junctions, introns, sections; line by line against a known one if it is named."""

import os

import pytest

from codonlake.functions.dna import CODONS
from codonlake.operators import report as P
from tests.test_signals import FASTA, GOLD, PARAM, dna, there

EXONS = "locus string, gene long, strand string, type string, start long, end_ long, frame int, rest int, score float, potential double, left_score float, right_score float, left_cls int, right_cls int"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def small(spark):
    seq = dna(600, 3)
    rows = [
        ("a", 1, "+", "Internal", 11, 27, 1, 1, 1.5, 2.25, 1.0, 2.0, 0, 1),  # 17 bases: 1, then 5 codons, then 1
        ("a", 1, "+", "Internal", 41, 48, 2, 0, 2.5, 3.0, 3.0, 4.0, 2, 0),  # 2 of a codon, then 2 codons
        ("a", 1, "+", "Internal", 61, 64, 0, 2, 1.0, 0.5, 0.25, 0.75, 0, 0),  # a codon, then 1 base left over
        ("a", 2, "-", "Terminal", 101, 130, 0, 0, 0.5, 0.5, 1.25, 0.0, 0, 0),
        ("a", 2, "-", "First", 141, 149, 0, 0, 0.5, 0.5, 5.0, 6.0, 0, 0),
        ("a", 2, "-", "UTR_First_Half", 150, 169, 0, 0, 0.25, 0.0, 5.0, 6.0, 0, 0),
    ]
    seqs = spark.createDataFrame([("a", len(seq), seq), ("none", 7, "ACGTACG")], "locus string, length long, seq string")
    return seq, spark.createDataFrame(rows, EXONS), seqs


def test_sequences_and_ranges(small):
    seq, exons, seqs = small
    cut = lambda a, b: seq[a - 1 : b]
    aa = lambda s: "".join(CODONS[s[i : i + 3]] for i in range(0, len(s) - 2, 3))
    got = {r.gene: r for r in P.sequences_of(exons, seqs).collect()}
    one = cut(11, 27) + cut(41, 48) + cut(61, 64)
    assert got[1].cds == got[1].transcript == one
    assert got[1].protein == one[0].lower() + aa(one[1:]) + one[-1:].lower() and got[1].n_aa == 9
    two = rc(cut(141, 149)) + rc(cut(101, 130))
    assert (got[2].cds, got[2].protein, got[2].transcript) == (two, aa(two), rc(cut(150, 169)) + two)
    placed = {(r.gene, r.start): (r.number, r.aa1, r.aa2, r.first_part, r.last_part) for r in P.placed_in_genes(exons).collect()}
    assert [placed[1, s] for s in (11, 41, 61)] == [(1, 1, 6, True, False), (2, 6, 8, False, False), (3, 9, 9, False, True)]
    assert [placed[2, s] for s in (141, 101)] == [(1, 1, 3, False, False), (2, 4, 13, False, False)]


def test_introns(small):
    seq, exons, seqs = small
    got = {(r.gene, r.start): r for r in P.introns(exons, seqs).collect()}
    a, b = got[1, 28], got[2, 131]
    assert (a.end_, a.number, a.phase, a["class"], a.donor, a.acceptor) == (40, 1, 1, "U12", 2.0, 3.0)
    assert a.subtype == f"{seq[27:29]}-{seq[38:40]}"
    assert (b.end_, b.number, b["class"], b.donor, b.acceptor) == (140, 1, "U2", 6.0, 1.25)
    assert b.subtype == f"{rc(seq[138:140])}-{rc(seq[130:132])}"
    assert got[1, 49].number == 2 and len(got) == 3


def test_lines_in_order(small, tmp_path):
    seq, exons, seqs = small
    rows = P.lines(exons, seqs, "made", "pre", with_introns=True)
    P.write(rows, f"file://{tmp_path}/out")
    text = []
    for name in sorted(os.listdir(f"{tmp_path}/out")):
        if name.startswith("part"):
            text += open(f"{tmp_path}/out/{name}").read().split("\n")[:-1]
    kinds = [x.split("\t")[2] if x.count("\t") == 8 else x.split(" ")[0][:9] for x in text]
    assert kinds[:14] == ["##sequenc", "#", "#", "gene", "mRNA", "CDS", "exon", "intron", "CDS", "exon", "intron", "CDS", "exon", "###"]
    assert kinds[14:23] == ["#", "gene", "mRNA", "CDS", "exon", "intron", "CDS", "exon", "UTR"]
    assert [x.split("_")[2] for x in text if x.startswith(">")] == ["protein"] * 2 + ["CDS"] * 2 + ["transcript"] * 2
    assert text[-2:] == ["##sequence-region none 1 7", "# Optimal Gene Structure. 0 genes. Score = 0.00 "]
    assert "a\tmade\tCDS\t11\t27\t1.50\t+\t1\tID=cds_pre-a_1;Parent=mRNA_pre-a_1;Target=made_predicted_protein_pre-a_1 1 6;5_prime_partial=true;exon_type=Internal;acceptor_score=1.00;donor_score=2.00;coding_potential=2.25" in text
    assert "# Gene 2 (Reverse). 2 exons. 13 aa. Score = 1.25 " in text
    assert all(len(x) <= 60 for x in text if x and set(x) <= set("ACGTacgt"))


@pytest.mark.skipif(not os.environ.get("CODONLAKE_SLOW"), reason="takes a minute; set CODONLAKE_SLOW=1")
@there
def test_known_report(spark):
    """Every line of a known report but its dates and blank lines."""
    from codonlake.operators.exons import predict
    from codonlake.sources import formats, params
    from codonlake.sources.scratch import kept

    seqs = formats.read_fasta(spark, FASTA).cache()
    exons = kept(predict(seqs, params.read(PARAM, blanks_block=False)), "genes")
    want = [x.rstrip("\n") for x in open(GOLD)]
    source = next(x.split("\t")[1] for x in want if x.count("\t") == 8)
    got = [x for r in P.lines(exons, seqs, source).orderBy(*P.PLACE).collect() for x in r.value.split("\n")]
    assert [x for x in got if x] == [x for x in want if x and not x.startswith(("##gff", "# source", "# date"))]


def test_plain_and_gff2(small):
    _, exons, seqs = small
    text = [r.value for r in P.plain_lines(exons, seqs, "made").orderBy(*P.PLACE).collect()]
    assert text[0] == "# Sequence a - Length = 600 bps" and text[2].startswith("# Gene 1 (Forward). 3 exons. 9 aa.")
    assert text[3] == "Internal       11       27\t 1.50\t+ 1 2\t 1.00\t 2.00\t 2.25\t 0.00\tAA   1:  6 a_1"
    assert text[7] == "Terminal      101      130\t 0.50\t- 0 0\t 0.00\t 1.25\t 0.50\t 0.00\tAA   4: 13 a_2"
    gff = [r.value for r in P.plain_lines(exons, seqs, "made", "p", gff2=True).orderBy(*P.PLACE).collect()]
    assert gff[3] == "a\tmade-p\tInternal\t11\t27\t1.50\t+\t1\tp-a_1"


def test_xml(small):
    import xml.etree.ElementTree as X

    _, exons, seqs = small
    rows = P.xml_lines(exons, seqs, "made").orderBy(*P.PLACE).collect()
    tree = X.fromstring("<all>" + "\n".join(r.value for r in rows) + "</all>")
    a, none = tree.findall("prediction")
    assert a.attrib == {"locus": "a", "length": "600", "source": "made", "genes": "2", "score": "6.00"} and none.attrib["genes"] == "0"
    one, two = a.findall("gene")
    assert [x.attrib["type"] for x in one.findall("exon/site")] == ["Acceptor", "Donor"] * 3
    assert [(x.attrib["type"], x.attrib["position"], x.attrib["score"]) for x in two.findall("exon/site")] == [("Stop", "101", "0.00"), ("Acceptor", "130", "1.25"), ("Donor", "141", "6.00"), ("Start", "149", "5.00")]
    texts = {r.gene: r for r in P.sequences_of(exons, seqs).collect()}
    assert "".join(two.find("cDNA").text.strip().split("\n")[1:]) == texts[2].cds and two.find("protein").attrib["length"] == "13"
