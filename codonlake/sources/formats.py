"""Readers and writers of sequence and annotation files as DataFrames.

Readers are lazy scans of text; nothing is parsed on the driver, and files of any number of records
are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Score that stands for forced evidence, and group of rows without one: fixed values.
FORCED, NO_GROUP = 10000.0, "NON_GROUPED"


def input_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``; nothing to read is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if not size:
        raise ValueError(f"{path} is empty")
    return size


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows (locus, length, seq): one for each record, upper case, white space left out.

    A record begins with ">" at the start of a line; the first word after it names the locus. Text
    before the first record raises an error when it is read.
    """
    raw = spark.read.text(path, lineSep="\n>").select(F.col("value"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    body = F.regexp_replace("value", "^>", "")
    first = F.when(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).eqNullSafe(0) & (F.col("at") == 0), ~F.col("value").startswith(">")).otherwise(False)
    checked = F.when(first, F.raise_error(F.lit("a FASTA file starts with >"))).otherwise(body)
    head = F.regexp_extract(checked, r"^[^\n]*", 0)
    name = F.regexp_extract(head, r"^\s*(\S*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(checked, r"^[^\n]*\n?", ""), r"\s+", ""))
    return raw.where(F.trim("value") != "").select(name.alias("locus"), F.length(seq).cast("long").alias("length"), seq.alias("seq"))


def write_fasta(rows: DataFrame, path: str, name: str = "locus", seq: str = "seq", width: int = 60) -> None:
    """One record for each row, lines of ``width``."""
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?!$)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value")).write.text(path)


def _gff(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Lines of a tab-separated annotation file but comments and blank ones; one of less than eight columns is an error."""
    line = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parts = F.split("value", "\t")
    c = F.when(F.size(parts) >= 8, parts).otherwise(F.raise_error(F.concat(F.lit("fewer than eight columns: "), F.col("value"))).cast("array<string>"))
    names = ("locus", "source", "feature", "start", "end", "score", "strand", "frame")
    cols = [c[i].alias(n) for i, n in enumerate(names)]
    # splits of a file are numbered in their order, lines within each
    order = [F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord")] if numbered else []
    return line.select(*order, *cols, F.trim(F.coalesce(F.get(c, F.lit(8)), F.lit(""))).alias("attributes"))


def _frames(frame: Column) -> Column:
    """A frame of "." stands for all three."""
    return F.when(frame == ".", F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(frame.try_cast("int")))


def read_evidence(spark: SparkSession, path: str, kinds: list[str] | None = None, factor: float = 1.0, weight: float = 0.0, lo: int | None = None, hi: int | None = None, strands: str = "+-", numbered: bool = False) -> DataFrame:
    """Rows (locus, feature, start, end, score, strand, frame, group, donor, acceptor) of annotations that serve as evidence; ``numbered``: also ord, the order of lines.

    A score of "." is FORCED, another one is ``factor * score + weight``; a frame of "." gives three
    rows; introns also give rows of their two UTR kinds, with frame and remainder swapped. Region,
    strands and kinds cut rows before they multiply.
    """
    g = _gff(spark, path, numbered).where(F.col("strand").isin(*strands))
    extra = ["ord"] if numbered else []
    g = g.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    if lo is not None:
        g = g.where(F.col("start") >= lo)
    if hi is not None:
        g = g.where(F.col("end") <= hi)
    if kinds is not None:
        g = g.where(F.col("feature").isin(*kinds))
    attrs = F.when(F.contains("attributes", F.lit("=")), F.str_to_map(F.regexp_replace("attributes", r"\s*;\s*$", ""), F.lit(r"\s*;\s*"), F.lit("=")))
    pick = lambda k: F.try_element_at("attrs", F.lit(k))
    score = F.when(F.col("score") == ".", F.lit(FORCED)).otherwise(F.col("score").cast("double") * factor + weight)
    group = F.when(F.col("attributes").isin("", "."), F.lit(NO_GROUP)).otherwise(F.coalesce(pick("Parent"), F.when(F.col("attrs").isNull(), F.col("attributes")), F.lit(NO_GROUP)))
    own = F.when(F.col("feature") == "Intron", F.array(F.lit("Intron"), F.lit("UTR_5prime_Intron"), F.lit("UTR_3prime_Intron"))).otherwise(F.array("feature"))
    out = g.withColumn("attrs", attrs).select(*extra, "locus", F.explode(own).alias("feature"), "start", "end", score.cast("float").alias("score"), "strand", _frames(F.col("frame")).alias("frames"), group.alias("group"), F.coalesce(pick("donor"), F.lit("U2")).alias("donor"), F.coalesce(pick("acceptor"), F.lit("U2")).alias("acceptor"))
    out = out.select(*extra, "locus", "feature", "start", "end", "score", "strand", F.explode("frames").alias("frame"), "group", "donor", "acceptor")
    utr = F.col("feature").startswith("UTR_") & F.col("feature").endswith("_Intron")
    return out.withColumns({"remainder": F.when(utr, F.col("frame")), "frame": F.when(utr, F.pmod(3 - F.col("frame"), F.lit(3))).otherwise(F.col("frame"))})


def out_of_order(evidence: DataFrame) -> DataFrame:
    """Rows whose start is before that of the row above them in the file's order (column ``ord``) of one locus."""
    w = W.partitionBy("locus").orderBy("ord")
    return evidence.withColumn("__before", F.lag("start").over(w)).where("start < __before").drop("__before")


def read_homology(spark: SparkSession, path: str) -> DataFrame:
    """Rows (locus, start, end, score, strand, frame6): similarity or coverage segments, in any order.

    Frames 1 to 3 count as 1, 2, 0; "." stands for all; the reverse strand has 3 to 5.
    """
    g = _gff(spark, path)
    rows = g.select("locus", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("score").cast("float").alias("score"), "strand", F.explode(_frames(F.col("frame"))).alias("frame"))
    return rows.select("locus", "start", "end", "score", "strand", (F.col("frame") % 3 + F.when(F.col("strand") == "-", 3).otherwise(0)).alias("frame6"))


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Rows (chrom, name, strand, feature, start, end) of transcripts with blocks: cds, 5utr, 3utr and intron, from 0, half-open."""
    c = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|track|browser|$)")).select(
        c[0].alias("chrom"), c[1].cast("long").alias("at"), c[3].alias("name"), c[5].alias("strand"), c[6].cast("long").alias("thick_lo"), c[7].cast("long").alias("thick_hi"),
        F.transform(F.filter(F.split(c[10], ","), lambda x: x != ""), lambda x: x.cast("long")).alias("sizes"),
        F.transform(F.filter(F.split(c[11], ","), lambda x: x != ""), lambda x: x.cast("long")).alias("starts"),
    )
    t = t.withColumn("blocks", F.expr("sort_array(transform(starts, (s, i) -> named_struct('lo', at + s, 'hi', at + s + sizes[i])))"))
    part = lambda lo, hi, kind: F.struct(kind.alias("feature"), lo.alias("start"), hi.alias("end"))
    left, right = F.when(F.col("strand") == "-", "3utr").otherwise("5utr"), F.when(F.col("strand") == "-", "5utr").otherwise("3utr")
    pieces = lambda b: F.array(part(b["lo"], F.least(b["hi"], F.col("thick_lo")), left), part(F.greatest(b["lo"], F.col("thick_lo")), F.least(b["hi"], F.col("thick_hi")), F.lit("cds")), part(F.greatest(b["lo"], F.col("thick_hi")), b["hi"], right))
    exons = t.select("chrom", "name", "strand", F.explode(F.flatten(F.transform("blocks", pieces))).alias("x")).select("chrom", "name", "strand", "x.*").where("start < end")
    introns = t.where("size(blocks) > 1").select("chrom", "name", "strand", F.explode(F.expr("transform(sequence(0, size(blocks) - 2), i -> named_struct('feature', 'intron', 'start', blocks[i].hi, 'end', blocks[i + 1].lo))")).alias("x")).select("chrom", "name", "strand", "x.*")
    return exons.union(introns)


def gff3_lines(features: DataFrame) -> DataFrame:
    """Rows (value) of features (seqid, source, type, start, end, score, strand, phase, attributes map, written in order of keys): nulls become "."."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    score = F.coalesce(F.format_string("%.2f", F.col("score").cast("double")), F.lit("."))
    score = F.when(F.col("score").isNull(), F.lit(".")).otherwise(score)
    return features.select(F.concat_ws("\t", "seqid", dot("source"), "type", F.col("start").cast("string"), F.col("end").cast("string"), score, dot("strand"), dot("phase"), F.coalesce(attrs, F.lit("."))).alias("value"))
