"""Genes from chained exons: coding sequences, proteins, feature rows and introns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.functions.dna import amino_acids, reverse_complement, words_of_bases


def with_bases(exons: DataFrame, sequences: DataFrame) -> DataFrame:
    """``exons`` (locus, start, end_ from 1) with their bases on the strand; a locus' sequence is read once."""
    names = exons.columns
    kinds = ", ".join(f"{c} {k}" for c, k in exons.dtypes)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        seq = right.column("seq")[0].as_py() if right.num_rows else ""
        cut = [seq[a - 1 : b] for a, b in zip(left.column("start").to_pylist(), left.column("end_").to_pylist(), strict=True)]
        return left.select(names).append_column("bases", pa.array(cut, pa.string()))

    out = exons.groupBy("locus").cogroup(sequences.select("locus", "seq").groupBy("locus")).applyInArrow(run, f"{kinds}, bases string")
    return out.withColumn("bases", F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")))


def genes(exons: DataFrame) -> DataFrame:
    """Rows (locus, gene, strand, start, end_, n_exons, score, cds, protein) of exons with bases.

    Exons are joined along the strand; bases before the first whole codon are left out of the protein, as is what follows the last.
    """
    along = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    parts = F.sort_array(F.collect_list(F.struct(along.alias("at"), "bases", "frame")))
    g = exons.groupBy("locus", "gene", "strand").agg(F.min("start").alias("start"), F.max("end_").alias("end_"), F.count("*").alias("n_exons"), F.sum(F.col("score").cast("double")).alias("score"), parts.alias("parts"))
    g = g.withColumns({"cds": F.array_join("parts.bases", ""), "skip": F.get(F.col("parts.frame"), F.lit(0))})
    g = g.withColumn("words", words_of_bases("cds", 3)).withColumn("codons", F.expr("filter(words, (w, i) -> i % 3 = skip)"))
    return g.select("locus", "gene", "strand", "start", "end_", "n_exons", "score", "cds", amino_acids("cds", F.col("codons")).alias("protein"))


def introns(exons: DataFrame) -> DataFrame:
    """Rows (locus, gene, strand, start, end_, score) between neighbouring exons of a gene; the score is the mean of the two sites'."""
    w = W.partitionBy("locus", "gene").orderBy("start")
    back = F.col("strand") == "-"
    near = F.when(back, F.col("right_score")).otherwise(F.col("left_score"))
    far = F.when(back, F.col("left_score")).otherwise(F.col("right_score"))
    e = exons.withColumns({"before": F.lag("end_").over(w), "other": F.lag(far).over(w)}).where("before is not null")
    return e.select("locus", "gene", "strand", (F.col("before") + 1).alias("start"), (F.col("start") - 1).alias("end_"), ((F.col("other") + near) / 2).alias("score"))


def features(exons: DataFrame, found: DataFrame, source: str = "codonlake") -> DataFrame:
    """Feature rows for gff3_lines(): gene, mRNA, and CDS and exon of each exon, in no order."""
    name = F.concat_ws("_", "locus", F.col("gene").cast("string"))
    attrs = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv]), F.array(*[v if not isinstance(v, str) else F.lit(v) for v in kv.values()]))
    none = F.lit(None).cast("int")
    row = lambda kind, score, phase, a: [F.col("locus").alias("seqid"), F.lit(source).alias("source"), F.lit(kind).alias("type"), "start", F.col("end_").alias("end"), score.alias("score"), "strand", phase.alias("phase"), a.alias("attributes")]
    score = F.col("score").cast("double")
    gene = found.select(*row("gene", score, none, attrs(ID=name, Name=name)))
    mrna = found.select(*row("mRNA", score, none, attrs(ID=F.concat(F.lit("mRNA_"), name), Parent=name)))
    order = F.row_number().over(W.partitionBy("locus", "gene").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))))
    e = exons.withColumn("number", order)
    parent = F.concat(F.lit("mRNA_"), name)
    cds = e.select(*row("CDS", score, F.col("frame").cast("int"), attrs(ID=F.concat(F.lit("cds_"), name), Parent=parent, exon_type=F.col("type"), coding_potential=F.format_string("%.2f", F.col("potential")))))
    exon = e.select(*row("exon", score, none, attrs(ID=F.concat(F.lit("exon_"), name, F.lit("."), F.col("number").cast("string")), Parent=parent)))
    return gene.unionByName(mrna).unionByName(cds).unionByName(exon)
