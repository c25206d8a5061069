"""Fragments read from files that Spark splits anywhere, against those of whole sequences."""

import pytest
from pyspark.sql import functions as F

from codonlake.operators.exons import candidates
from codonlake.operators.signals import fragments
from codonlake.sources import formats
from codonlake.sources.chromosomes import pieces, read_fragments
from tests.test_signals import dna
from tests.test_tracks import free_parameters


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(path, records, width):
    with open(path, "w") as f:
        for name, seq in records:
            f.write(f">{name} what it is\n" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width)))


@pytest.mark.parametrize("width", [7, 60, 1000])
def test_same_fragments(spark, tmp_path, tiny_splits, width):
    records = [("a", dna(4000, 1).lower()), ("empty", ""), ("b", dna(333, 2)), ("c", dna(1, 3)), ("d", dna(2501, 4, "ACGTN"))]
    written(f"{tmp_path}/one.fa", records, width)
    written(f"{tmp_path}/two.fa", [("e", dna(900, 5))], width)
    path = [f"file://{tmp_path}/one.fa", f"file://{tmp_path}/two.fa"]
    for fragment, overlap in ((1000, 100), (450, 200), (5000, 10)):
        want = fragments(formats.read_fasta(spark, f"file://{tmp_path}/*.fa"), fragment, overlap)
        got = read_fragments(spark, path, fragment, overlap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert pieces(spark, path).select(F.spark_partition_id()).distinct().count() > 3


def test_text_before_a_record(spark, tmp_path):
    open(f"{tmp_path}/x.fa", "w").write("ACGT\n>a\nACGT\n")
    with pytest.raises(Exception, match="starts with >"):
        pieces(spark, f"file://{tmp_path}/x.fa").collect()


def test_exons_of_a_file(spark, tmp_path):
    p = free_parameters()
    written(f"{tmp_path}/x.fa", [("s", dna(2600, 9))], 60)
    seqs = formats.read_fasta(spark, f"file://{tmp_path}/x.fa")
    frags = read_fragments(spark, f"file://{tmp_path}/x.fa", 1500, 900)
    lengths = frags.where("strand = '+'").select("locus", "length").distinct()
    key = lambda df: sorted((r.strand, r.type, r.lo, r.hi, r.frame, round(r.score, 3)) for r in df.collect())
    assert key(candidates(lengths, p, overlap=900, frags=frags)) == key(candidates(seqs, p, fragment=1500, overlap=900))
