"""Predictions as an ordered report: header, genes with their features, then proteins, coding sequences and transcripts.

Every line is a row with its place (locus, section, gene, position, order within); one range shuffle by place orders the
whole report, so its files follow each other as its parts do and no task or driver holds a locus' text. What a line needs of its
gene comes from windows over the gene's exons: numbers along the strand, and ranges of amino acids as running sums of coding bases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.functions.dna import amino_acids, words_of_bases
from codonlake.operators.exons import TYPES
from codonlake.operators.genes import with_bases

PLACE = ["locus", "section", "gene", "at", "sub"]
WIDTH = 60


def _along() -> Column:
    return F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))


def placed_in_genes(exons: DataFrame) -> DataFrame:
    """Coding exons with number (along the strand), n (of the gene), aa1 and aa2: the amino acids they have a part in, counted from the gene's
    first whole codon, and whether the gene begins (first_part) or ends (last_part) without its proper exon there."""
    coding = exons.where(F.col("type").isin(*TYPES))
    w = W.partitionBy("locus", "gene").orderBy(_along())
    gene = W.partitionBy("locus", "gene")
    upto = F.sum(F.col("end_") - F.col("start") + 1).over(w)
    skip = F.first("frame").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    e = coding.withColumns({"number": F.row_number().over(w), "n": F.count("*").over(gene), "__upto": upto, "__skip": skip})
    before = F.col("__upto") - (F.col("end_") - F.col("start") + 1)
    most = F.floor((F.max("__upto").over(gene) - F.col("__skip")) / 3)
    one = F.greatest(F.floor((before - F.col("__skip")) / 3) + 1, F.lit(1))
    two = F.least(F.ceil((F.col("__upto") - F.col("__skip")) / 3), most)
    first, last = F.col("number") == 1, F.col("number") == F.col("n")
    flags = {"first_part": first & ~F.col("type").isin("First", "Single"), "last_part": last & ~F.col("type").isin("Terminal", "Single")}
    return e.withColumns({"aa1": one.cast("long"), "aa2": two.cast("long"), **flags}).drop("__upto", "__skip")


def sequences_of(exons: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows (locus, gene, protein, cds, transcript) of genes. Bases of codons that aren't whole at either end of a protein are written
    in lower case; a transcript has the untranslated exons, too, an exon of several parts once."""
    with_ = with_bases(exons, sequences).withColumn("coding", F.col("type").isin(*TYPES))
    parts = F.sort_array(F.collect_list(F.struct(_along().alias("at"), "bases", "frame", "coding")))
    g = with_.where(~F.col("type").endswith("Intron") & (F.col("type") != "Promoter")).groupBy("locus", "gene").agg(parts.alias("parts"))
    coding = F.filter("parts", lambda p: p["coding"])
    g = g.withColumns({"transcript": F.array_join("parts.bases", ""), "__c": coding}).withColumns({"cds": F.array_join("__c.bases", ""), "skip": F.coalesce(F.get(F.col("__c.frame"), F.lit(0)), F.lit(0))})
    g = g.withColumn("words", words_of_bases("cds", 3)).withColumn("codons", F.expr("filter(words, (w, i) -> i % 3 = skip)"))
    rest = F.expr("(length(cds) - skip) % 3")
    protein = F.concat(F.lower(F.expr("substring(cds, 1, skip)")), amino_acids("cds", F.col("codons")), F.lower(F.when(rest > 0, F.expr("right(cds, (length(cds) - skip) % 3)")).otherwise("")))
    return g.select("locus", "gene", protein.alias("protein"), F.size("codons").cast("long").alias("n_aa"), "cds", "transcript")


def introns(exons: DataFrame, sequences: DataFrame) -> DataFrame:
    """Introns between neighbouring exons of a gene: ends, number along the strand, phase, splice class (U2 or U12), subtype by
    the bases at both ends, scores of both sites and their mean."""
    w = W.partitionBy("locus", "gene").orderBy("start")
    back = F.col("strand") == "-"
    near, far = F.when(back, F.col("right_score")).otherwise(F.col("left_score")), F.when(back, F.col("left_score")).otherwise(F.col("right_score"))
    near_cls = F.when(back, F.col("right_cls")).otherwise(F.col("left_cls"))
    e = exons.where(F.col("type").isin(*TYPES)).withColumns({"__end": F.lag("end_").over(w), "__far": F.lag(far).over(w), "__rest": F.lag("rest").over(w), "n": F.count("*").over(W.partitionBy("locus", "gene")), "k": F.row_number().over(w)}).where("__end is not null")
    rows = e.select("locus", "gene", "strand", (F.col("__end") + 1).alias("start"), (F.col("start") - 1).alias("end_"), F.when(back, F.col("n") - F.col("k") + 1).otherwise(F.col("k") - 1).alias("number"), F.when(back, F.col("rest")).otherwise(F.col("__rest")).alias("phase"), F.when(near_cls > 0, "U12").otherwise("U2").alias("class"), F.when(back, near).otherwise(F.col("__far")).alias("donor"), F.when(back, F.col("__far")).otherwise(near).alias("acceptor"))
    ends = rows.select("*", F.explode(F.array(F.struct(F.col("start").alias("a"), (F.col("start") + 1).alias("b"), F.lit(0).alias("right")), F.struct((F.col("end_") - 1).alias("a"), F.col("end_").alias("b"), F.lit(1).alias("right")))).alias("x"))
    two = with_bases(ends.select("locus", "gene", "strand", "number", F.col("x.right").alias("right"), F.col("x.a").alias("start"), F.col("x.b").alias("end_")), sequences)
    two = two.withColumn("first", (F.col("right") == 0) == (F.col("strand") == "+")).groupBy("locus", "gene", "number").agg(F.concat(F.max(F.when(F.col("first"), F.col("bases"))), F.lit("-"), F.max(F.when(~F.col("first"), F.col("bases")))).alias("subtype"))
    return rows.join(two, ["locus", "gene", "number"])


def _two(c: Column | str) -> Column:
    return F.format_string("%.2f", (F.col(c) if isinstance(c, str) else c).cast("double"))


def lines(exons: DataFrame, sequences: DataFrame, source: str = "codonlake", prefix: str = "", with_introns: bool = False, proteins: bool = True, cds: bool = True, transcripts: bool = True) -> DataFrame:
    """Rows (PLACE, value) of a GFF3 report of ``predict``'s result. Loci without genes have a header only."""
    gene_id = F.concat(F.lit(f"{prefix}-" if prefix else ""), F.col("locus"), F.lit("_"), F.col("gene").cast("string"))
    tab = lambda *cols: F.concat_ws("\t", *[F.lit(c) if isinstance(c, str) else c for c in cols])
    row = lambda df, section, at, sub, value, gene=None: df.select("locus", F.lit(section).alias("section"), (gene if gene is not None else F.col("gene")).cast("long").alias("gene"), at.cast("long").alias("at"), F.lit(sub).alias("sub"), value.alias("value"))
    zero = F.lit(0)
    where = lambda kind, score, phase: (F.col("locus"), source, kind, F.col("start").cast("string"), F.col("end_").cast("string"), score, F.col("strand"), phase)

    e = placed_in_genes(exons)
    texts = sequences_of(exons, sequences)
    g = exons.where(~F.col("type").endswith("Intron")).groupBy("locus", "gene", "strand").agg(F.min("start").alias("start"), F.max("end_").alias("end_"), F.count_if(F.col("type").isin(*TYPES)).alias("k"), F.sum(F.col("score").cast("double")).alias("score")).join(texts.select("locus", "gene", "n_aa"), ["locus", "gene"])
    total = g.groupBy("locus").agg(F.count("*").alias("genes"), F.sum("score").alias("score"))
    head = sequences.select("locus", "length").join(total, "locus", "left")
    out = [
        row(head, 0, zero, 0, F.concat(F.lit("##sequence-region "), "locus", F.lit(" 1 "), F.col("length").cast("string")), zero),
        row(head, 0, zero, 1, F.concat(F.lit("# Optimal Gene Structure. "), F.coalesce("genes", zero).cast("string"), F.lit(" genes. Score = "), _two(F.coalesce("score", F.lit(0.0))), F.lit(" ")), zero),
        row(g, 1, zero, 0, F.concat(F.lit("# Gene "), F.col("gene").cast("string"), F.when(F.col("strand") == "-", " (Reverse). ").otherwise(" (Forward). "), F.col("k").cast("string"), F.lit(" exons. "), F.col("n_aa").cast("string"), F.lit(" aa. Score = "), _two("score"), F.lit(" "))),
        row(g, 1, zero, 1, tab(*where("gene", _two("score"), "."), F.concat(F.lit("ID="), gene_id, F.lit(";Name="), gene_id))),
        row(g, 1, zero, 2, tab(*where("mRNA", _two("score"), "."), F.concat(F.lit("ID=mRNA_"), gene_id, F.lit(";Parent="), gene_id))),
        row(g, 1, F.lit(1 << 60), 0, F.lit("###")),
    ]
    begins, ends = F.col("type").isin("First", "Single"), F.col("type").isin("Terminal", "Single")
    flags = F.concat(F.when(F.col("first_part"), ";5_prime_partial=true").otherwise(""), F.when(F.col("last_part"), ";3_prime_partial=true").otherwise(""))
    score_of = lambda name, c, no: F.when(no, "").otherwise(F.concat(F.lit(f";{name}_score="), _two(c)))
    left, right = score_of("acceptor", "left_score", begins), score_of("donor", "right_score", ends)
    start = F.when(begins, F.concat(F.lit(";start_score="), _two("left_score"))).otherwise("")
    homology = F.concat(F.lit(";homology_score="), _two("homology")) if "homology" in exons.columns else F.lit("")
    target = F.concat(F.lit(f";Target={source}_predicted_protein_"), gene_id, F.lit(" "), F.col("aa1").cast("string"), F.lit(" "), F.col("aa2").cast("string"))
    out.append(row(e, 1, F.col("start"), 0, tab(*where("CDS", _two("score"), F.col("frame").cast("string")), F.concat(F.lit("ID=cds_"), gene_id, F.lit(";Parent=mRNA_"), gene_id, target, flags, F.lit(";exon_type="), "type", start, left, right, F.lit(";coding_potential="), _two("potential"), homology))))
    out.append(row(e, 1, F.col("start"), 1, tab(*where("exon", _two("score"), "."), F.concat(F.lit("ID=exon_"), gene_id, F.lit("."), F.col("number").cast("string"), F.lit(";Parent=mRNA_"), gene_id, flags, left, right))))
    u = exons.where(F.col("type").startswith("UTR") & ~F.col("type").endswith("Intron")).withColumn("number", F.row_number().over(W.partitionBy("locus", "gene").orderBy(_along())))
    out.append(row(u, 1, F.col("start"), 0, tab(*where("UTR", _two("score"), F.col("frame").cast("string")), F.concat(F.lit("ID=utr_"), gene_id, F.lit("."), F.col("number").cast("string"), F.lit(";Parent=mRNA_"), gene_id, F.lit(";exon_type="), "type", homology))))
    if with_introns:
        i = introns(exons, sequences)
        out.append(row(i, 1, F.col("start"), 2, tab(*where("intron", _two((F.col("donor") + F.col("acceptor")) / 2), F.col("phase").cast("string")), F.concat(F.lit("ID=intron_"), gene_id, F.lit("."), F.col("number").cast("string"), F.lit(";Parent="), gene_id, F.lit(";type="), "class", F.lit(";subtype="), "subtype", F.lit(";donor_score="), _two("donor"), F.lit(";acceptor_score="), _two("acceptor")))))
    wanted = [("protein", proteins, "protein"), ("CDS", cds, "cds"), ("transcript", transcripts, "transcript")]
    if any(w for _, w, _ in wanted):
        out.append(row(total, 2, zero, 0, F.lit("##FASTA"), zero))
    wrapped = lambda c: F.regexp_replace(F.col(c), f"(.{{{WIDTH}}})(?!$)", "$1\n")
    for k, (name, want, c) in enumerate(wanted):
        if want:
            out.append(row(texts.where(F.length(c) > 0), 3 + k, zero, 0, F.concat(F.lit(f">{source}_predicted_{name}_"), gene_id, F.lit("\n"), wrapped(c))))
    return reduce(DataFrame.unionByName, out)


def _ends(strand: Column) -> tuple[Column, Column]:
    """Names of the left and right sites of an exon on the sequence, by its type: fixed names."""
    first = F.when(F.col("type").isin("First", "Single"), "Start").otherwise("Acceptor")
    last = F.when(F.col("type").isin("Terminal", "Single"), "Stop").otherwise("Donor")
    back = strand == "-"
    return F.when(back, last).otherwise(first), F.when(back, first).otherwise(last)


def plain_lines(exons: DataFrame, sequences: DataFrame, source: str = "codonlake", prefix: str = "", gff2: bool = False) -> DataFrame:
    """Rows (PLACE, value): a line for each exon, in the default text (type, ends, score, strand, frame, remainder, both sites, coding
    potential, similarity, amino acids) or as GFF of the second version; genes have a line of comment."""
    gene_id = F.concat(F.lit(f"{prefix}-" if prefix else ""), F.col("locus"), F.lit("_"), F.col("gene").cast("string"))
    e = placed_in_genes(exons)
    back = F.col("strand") == "-"
    homology = F.coalesce(F.col("homology"), F.lit(0.0)) if "homology" in exons.columns else F.lit(0.0)
    lo, hi = F.when(back, F.col("right_score")).otherwise(F.col("left_score")), F.when(back, F.col("left_score")).otherwise(F.col("right_score"))
    score = lambda c: c.cast("double")
    if gff2:
        tag = F.lit(source + (f"-{prefix}" if prefix else ""))
        line = F.concat_ws("\t", "locus", tag, "type", F.col("start").cast("string"), F.col("end_").cast("string"), _two("score"), "strand", F.col("frame").cast("string"), gene_id)
    else:
        line = F.format_string("%8s %8d %8d\t%5.2f\t%s %d %d\t%5.2f\t%5.2f\t%5.2f\t%5.2f\tAA %3d:%3d %s", "type", "start", "end_", score(F.col("score")), "strand", F.col("frame"), (3 - F.col("rest")) % 3, score(lo), score(hi), score(F.col("potential")), score(homology), "aa1", "aa2", gene_id)
    lines_ = e.select("locus", F.lit(1).alias("section"), F.col("gene").cast("long").alias("gene"), F.col("start").cast("long").alias("at"), F.lit(1).alias("sub"), line.alias("value"))
    head = lines(exons, sequences, source, prefix, proteins=False, cds=False, transcripts=False).where("(section = 0 and sub = 1) or (section = 1 and at = 0 and sub = 0)")
    top = sequences.select("locus", F.lit(0).alias("section"), F.lit(0).cast("long").alias("gene"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("sub"), F.concat(F.lit("# Sequence "), "locus", F.lit(" - Length = "), F.col("length").cast("string"), F.lit(" bps")).alias("value"))
    return top.unionByName(head).unionByName(lines_)


def xml_lines(exons: DataFrame, sequences: DataFrame, source: str = "codonlake", prefix: str = "", proteins: bool = True, cds: bool = True, transcripts: bool = True) -> DataFrame:
    """Rows (PLACE, value) of predictions as XML: genes with exons, their two sites and the sequences that are asked for."""
    id_ = F.concat(F.lit(prefix), F.col("locus"), F.lit(".G"), F.col("gene").cast("string"))
    quoted = lambda name, c: F.concat(F.lit(f'{name}="'), c.cast("string"), F.lit('"'))
    e = placed_in_genes(exons)
    texts = sequences_of(exons, sequences)
    back = F.col("strand") == "-"
    g = e.groupBy("locus", "gene", "strand").agg(F.count("*").alias("k"), F.sum(F.col("score").cast("double")).alias("score"))
    total = g.groupBy("locus").agg(F.count("*").alias("genes"), F.sum("score").alias("score"))
    head = sequences.select("locus", "length").join(total, "locus", "left").withColumns({"gene": F.lit(0), "genes": F.coalesce("genes", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})
    row = lambda df, section, at, sub, value: df.select("locus", F.lit(section).alias("section"), F.col("gene").cast("long").alias("gene"), at.cast("long").alias("at"), F.lit(sub).alias("sub"), value.alias("value"))
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    zero, end = F.lit(0), F.lit(1 << 60)
    left, right = _ends(F.col("strand"))
    lo, hi = F.when(back, F.col("right_score")).otherwise(F.col("left_score")), F.when(back, F.col("left_score")).otherwise(F.col("right_score"))
    exon = F.concat(id_, F.lit("E"), F.col("number").cast("string"))
    site = lambda k, kind, at, score: join('         <site idSite="', exon, f'S{k}" type="', kind, '" position="', at.cast("string"), '" score="', _two(score), '" />')
    out = [
        row(head, 0, zero, 0, join("<prediction ", quoted("locus", F.col("locus")), " ", quoted("length", F.col("length")), f' source="{source}" ', quoted("genes", F.col("genes")), ' score ="', _two("score"), '">')),
        row(head, 2, zero, 0, F.lit("</prediction>")),
        row(g, 1, zero, 0, join('   <gene idGene="', id_, '" strand ="', F.when(back, "rvs").otherwise("fwd"), '" exons="', F.col("k").cast("string"), '" score="', _two("score"), '">')),
        row(e, 1, F.col("start"), 0, join('      <exon idExon="', exon, '" type="', F.col("type"), '" frame="', F.col("frame").cast("string"), '" score="', _two("score"), '">')),
        row(e, 1, F.col("start"), 1, site(1, left, F.col("start"), lo)),
        row(e, 1, F.col("start"), 2, site(2, right, F.col("end_"), hi)),
        row(e, 1, F.col("start"), 3, F.lit("      </exon>")),
        row(g, 1, end, 9, F.lit("   </gene>")),
    ]
    for k, (name, want, c, kind) in enumerate((("tDNA", transcripts, "transcript", "transcript"), ("cDNA", cds, "cds", "CDS"), ("protein", proteins, "protein", "protein"))):
        if want:
            body = F.regexp_replace(F.col(c), f"(.{{{WIDTH}}})(?!$)", "$1\n")
            out.append(row(texts.where(F.length(c) > 0), 1, end, k, join(f'      <{name} length="', F.length(c).cast("string"), f'">\n>{source}_predicted_{kind}_', F.col("locus"), "_", F.col("gene").cast("string"), "\n", body, f"\n      </{name}>")))
    return reduce(DataFrame.unionByName, out)


def write(rows: DataFrame, path: str) -> None:
    """The report as text files that follow each other in order."""
    rows.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).select("value").write.text(path)
