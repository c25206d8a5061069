"""One run of the engine: files and options in, sites, exons or genes out.

The three ways of the original: prediction with assembly, prediction alone (sites and exons are what is asked for), and assembly of
given exons. Options that don't go together are refused before anything is read.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators import report
from codonlake.operators.chains import linked, traced
from codonlake.operators.exons import assembled, candidates, from_evidence, numbered
from codonlake.operators.options import Options, one_gene_rules
from codonlake.operators.signals import fragments, owned
from codonlake.operators.splice import scan_sites
from codonlake.sources import formats, params
from codonlake.sources.scratch import kept


class Run:
    """What ``options`` ask for, of the FASTA file at ``sequences`` by the parameter file at ``parameters``."""

    def __init__(self, spark: SparkSession, parameters: str, sequences: str, options: Options):
        self.spark, self.options = spark, options.check()
        p = params.read(parameters)
        self.parameters = replace(p, rules=one_gene_rules()) if options.single_gene else p
        formats.input_size(spark, sequences)
        self.sequences = formats.read_fasta(spark, sequences)

    def _within(self, rows: DataFrame, lo: str, hi: str) -> DataFrame:
        """Rows whose ends (from 1) lie in the region."""
        o = self.options
        rows = rows if o.first_base is None else rows.where(F.col(lo) >= o.first_base)
        return rows if o.last_base is None else rows.where(F.col(hi) <= o.last_base)

    def sites(self) -> DataFrame:
        """Rows (locus, strand, kind, subtype, start, score, bp, bp_at): each site of the kinds asked for once, whatever fragments it is in, at its place on the sequence from 1."""
        frags = fragments(self.sequences, strands=self.options.strands)
        found = owned(scan_sites(frags, self.parameters.isochores, self.options.minor), frags)
        found = found.join(self.sequences.select("locus", "length"), "locus")
        at = F.when(F.col("strand") == "-", F.col("length") - F.col("pos")).otherwise(F.col("pos") + 1)
        rows = found.select("locus", "strand", "kind", "subtype", at.alias("start"), "score", "bp", "bp_at").dropDuplicates(["locus", "strand", "kind", "subtype", "start"])
        return self._within(rows.where(F.col("kind").isin(*self.options.sites)) if self.options.sites else rows, "start", "start")

    def exons(self) -> DataFrame:
        """The scored exons, of all types or those asked for."""
        o = self.options
        homology = formats.read_homology(self.spark, o.homology) if o.homology else None
        e = candidates(self.sequences, self.parameters, o.strands, segments=homology, minor=o.minor, utr=o.utr, flank=o.flank, recursive=o.recursive, orfs=o.orfs)
        e = self._within(e.withColumns({"__a": F.col("lo") + 1, "__b": F.col("hi") + 1}), "__a", "__b").drop("__a", "__b")
        return e.where(F.col("type").isin(*o.exons)) if o.exons else e

    def evidence(self, path: str) -> DataFrame:
        """Given exons within the region and strands; lines have to ascend by their starts."""
        o = self.options
        late = formats.out_of_order(formats.read_evidence(self.spark, path, numbered=True))
        if not late.isEmpty():
            raise ValueError(f"{path}: lines aren't in the order of their starts")
        values = self.parameters.isochores[0].values
        return formats.read_evidence(self.spark, path, factor=values.get("Evidence_Factor", [1.0])[0], weight=values.get("Evidence_Exon_Weight", [0.0])[0], lo=o.first_base, hi=o.last_base, strands=o.strands)

    def genes(self) -> DataFrame:
        """The exons of the best chains; with ``assemble`` those of the given exons alone."""
        o = self.options
        if o.assemble:
            rows = linked(from_evidence(self.evidence(o.assemble), self.parameters.rules), "locus", ["right", "need", "give"], self.parameters.rules)
            return numbered(traced(kept(rows, "chain"), "locus")).withColumns({"start": F.col("left"), "end_": F.col("right")})
        given = self.evidence(o.evidence) if o.evidence else None
        return assembled(replace_exons(self), self.sequences.select("locus", "length"), self.parameters, given)

    def report(self, source: str = "codonlake") -> DataFrame:
        """The ordered report in the format asked for: rows (report.PLACE, value)."""
        o = self.options
        if o.predict_only:
            raise ValueError("a prediction without assembly has no genes to write")
        genes = kept(self.genes(), "genes")
        if o.format == "xml":
            return report.xml_lines(genes, self.sequences, source, o.prefix, o.proteins, o.coding, o.transcripts)
        if o.format in ("text", "gff2"):
            return report.plain_lines(genes, self.sequences, source, o.prefix, o.format == "gff2")
        return report.lines(genes, self.sequences, source, o.prefix, o.introns, o.proteins, o.coding, o.transcripts)


def replace_exons(run: Run) -> DataFrame:
    """All exons for assembly, whatever types are to be written."""
    kept_types, run.options = run.options, replace(run.options, exons=frozenset())
    try:
        return run.exons()
    finally:
        run.options = kept_types
