"""Runs of the engine from files: regions, dumps, assembly alone, options that are refused, recursive sites and open frames."""

import pytest
from pyspark.sql import functions as F

from codonlake.operators.engine import Run
from codonlake.operators.exons import build
from codonlake.operators.options import Options
from tests.test_signals import dna, small_parameters

RULES = "First+:Internal+ Internal+:Terminal+ 20:400\nBegin+ First+:Single+ 0:Infinity\nTerminal+:Single+ First+:Single+ 50:Infinity\nTerminal+:Single+ End+ 0:Infinity"


@pytest.fixture
def files(tmp_path):
    text = small_parameters().replace("-10 -10 -10 -10", "-1000 -1000 -1000 -1000", 2)
    text = text[: text.index("First+ Terminal+")] + RULES
    for head in ("Site_factor", "Exon_factor", "HSP_factor"):
        text = text.replace(f"{head}\n-10 -10 -10 -10", f"{head}\n1 1 1 1")
    (tmp_path / "p").write_text(text)
    (tmp_path / "s.fa").write_text(f">s\n{dna(900, 31)}\n")
    rows = [("s", "x", "First", 101, 160, 50, "+", 0, "g1"), ("s", "x", "Internal", 201, 260, 40, "+", 0, "g1"), ("s", "x", "Terminal", 301, 360, 30, "+", 0, "g1"), ("s", "x", "Single", 330, 389, 20, "+", 0, ".")]
    (tmp_path / "e.gff").write_text("# given\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return tmp_path


def run(spark, files, **kw):
    return Run(spark, str(files / "p"), f"file://{files}/s.fa", Options(**kw))


def test_region_and_kinds(spark, files):
    sites = run(spark, files, sites=frozenset({"start", "stop"}), first_base=100, last_base=500).sites().collect()
    assert {r.kind for r in sites} == {"start", "stop"} and all(100 <= r.start <= 500 for r in sites) and {r.strand for r in sites} == {"+", "-"}
    whole = run(spark, files, strands="+").exons()
    part = run(spark, files, strands="+", exons=frozenset({"Single"}), first_base=100, last_base=500).exons()
    want = sorted((r.lo, r.hi) for r in whole.collect() if r.type == "Single" and r.lo >= 99 and r.hi < 500)
    assert sorted((r.lo, r.hi) for r in part.collect()) == want and want


def test_assembly_of_given_exons(spark, files):
    r = run(spark, files, assemble=f"file://{files}/e.gff")
    got = sorted((x.start, x.end_, x.type, x.gene) for x in r.genes().collect())
    assert got == [(101, 160, "First", 1), (201, 260, "Internal", 1), (301, 360, "Terminal", 1)]


def test_report_of_a_run(spark, files):
    r = run(spark, files, strands="+", evidence=f"file://{files}/e.gff", prefix="n", introns=True, format="gff3")
    lines = [x.value for x in r.report().orderBy("locus", "section", "gene", "at", "sub").collect()]
    assert lines[0] == "##sequence-region s 1 900" and any("ID=n-s_1;" in x for x in lines)


def test_evidence_out_of_order(spark, files):
    text = (files / "e.gff").read_text().split("\n")
    (files / "e.gff").write_text("\n".join([text[2], text[1], *text[3:]]))
    with pytest.raises(ValueError, match="order of their starts"):
        run(spark, files, evidence=f"file://{files}/e.gff").genes()


def test_refusals(spark, files):
    (files / "s.fa").write_text("")
    for kw, why in (({}, "empty"), ({"assemble": "x", "predict_only": True}, "assembly"), ({"utr": True}, "coverage"), ({"first_base": 9, "last_base": 2}, "region")):
        with pytest.raises(ValueError, match=why):
            run(spark, files, **kw)


def test_recursive_sites_and_open_frames(spark):
    rows = [("acceptor", 50, 5.0), ("donor", 49, 4.5), ("acceptor", 80, 5.0), ("donor", 79, 4.0), ("stop", 11, 1.0), ("stop", 20, 2.0), ("stop", 77, 3.0), ("stop", 300, 4.0)]
    sites = spark.createDataFrame([("s", 0, "+", *r) for r in rows], "locus string, frag long, strand string, kind string, pos long, score float")
    got = build(sites, 5, (4.0, 4.0), True).where("type in ('RSS', 'ORF')")
    assert sorted((r.type, r.left_pos, r.right_pos, r.frame, r.rest) for r in got.collect()) == [("ORF", 20, 77, 0, 0), *[("RSS", 50, 49, f, f) for f in range(3)]]
    assert not got.where(F.col("type") == "RSS").isEmpty()
