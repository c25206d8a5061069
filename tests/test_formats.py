import pytest
from pyspark.sql import functions as F

from codonlake.sources import formats


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">one first record\nacgt\nAC gt\n>two\n\n>three\nNNN\n")
    got = {r.locus: (r.length, r.seq) for r in formats.read_fasta(spark, str(p)).collect()}
    assert got == {"one": (8, "ACGTACGT"), "two": (0, ""), "three": (3, "NNN")}
    formats.write_fasta(spark.createDataFrame([("s", "A" * 130)], "locus string, seq string"), str(tmp_path / "out"))
    assert [len(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [2, 60, 60, 10]


def test_evidence(spark, tmp_path):
    p = tmp_path / "x.gff"
    lines = ["# c", "", "s\tknown\tInternal\t5\t9\t.\t+\t1\tg1", "s\tknown\tIntron\t10\t20\t2.5\t-\t0\tParent=t1;donor=U12gtag;", "s\tknown\tFirst\t30\t40\t1\t+\t.\t", "s\tknown\tOther\t30\t40\t1\t+\t0"]
    p.write_text("\n".join(lines))
    e = formats.read_evidence(spark, str(p), ["Internal", "Intron", "First"], factor=2.0, weight=1.0).cache()
    assert e.groupBy("feature").count().orderBy("feature").collect() == [("First", 3), ("Internal", 1), ("Intron", 1), ("UTR_3prime_Intron", 1), ("UTR_5prime_Intron", 1)]
    one = e.where("feature = 'Internal'").first()
    assert (one.score, one.group, one.frame) == (10000.0, "g1", 1)
    intron = e.where("feature = 'Intron'").first()
    assert (intron.score, intron.group, intron.donor, intron.acceptor) == (6.0, "t1", "U12gtag", "U2")
    assert e.where("feature = 'First'").first().group == "NON_GROUPED"
    assert formats.read_evidence(spark, str(p), strands="-").where("feature = 'Intron'").count() == 1
    bad = formats.out_of_order(spark.createDataFrame([("s", 1, 5), ("s", 2, 4), ("t", 3, 1)], "locus string, ord long, start long"))
    assert [r.ord for r in bad.collect()] == [2]


def test_homology(spark, tmp_path):
    p = tmp_path / "x.gff"
    p.write_text("s\tx\tsr\t1\t9\t3\t-\t3\ns\tx\tsr\t1\t9\t3\t+\t.\n")
    assert sorted(r.frame6 for r in formats.read_homology(spark, str(p)).collect()) == [0, 1, 2, 3]


def test_bed12(spark, tmp_path):
    p = tmp_path / "x.bed"
    p.write_text("c\t100\t200\tt\t0\t-\t120\t170\t0\t2\t30,40,\t0,60,\n")
    got = sorted((r.feature, r.start, r.end) for r in formats.read_bed12(spark, str(p)).collect())
    assert got == [("3utr", 100, 120), ("5utr", 170, 200), ("cds", 120, 130), ("cds", 160, 170), ("intron", 130, 160)]


def test_gff3_lines(spark):
    f = spark.createDataFrame([("s", "p", "CDS", 1, 9, 1.234, "+", 0, {"ID": "a", "Parent": "b"}), ("s", None, "gene", 1, 9, None, "+", None, None)], "seqid string, source string, type string, start long, end long, score double, strand string, phase int, attributes map<string,string>")
    got = sorted(r.value for r in formats.gff3_lines(f).collect())
    assert got == ["s\t.\tgene\t1\t9\t.\t+\t.\t.", "s\tp\tCDS\t1\t9\t1.23\t+\t0\tID=a;Parent=b"]
    assert formats.gff3_lines(f.select("*").where(F.lit(False))).count() == 0


def test_empty_input_and_short_lines_are_errors(spark, tmp_path):
    p = tmp_path / "x.gff"
    p.write_text("")
    with pytest.raises(ValueError):
        formats.input_size(spark, str(p))
    p.write_text("s\tx\tsr\t1\t9\n")
    assert formats.input_size(spark, str(p)) == 11
    with pytest.raises(Exception, match="fewer than eight columns"):
        formats.read_homology(spark, str(p)).collect()
