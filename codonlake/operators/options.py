"""Options of a prediction and the combinations that are refused."""

from __future__ import annotations

from dataclasses import dataclass

from codonlake.operators.chains import Rule

FORMATS = ("text", "gff2", "gff3", "xml")


@dataclass(frozen=True)
class Options:
    """What to predict, from what, and what to write. ``check()`` raises ValueError where two options don't go together."""

    sites: frozenset[str] = frozenset()  # kinds of sites to write
    exons: frozenset[str] = frozenset()  # types of exons to write
    introns: bool = False
    proteins: bool = False
    transcripts: bool = False
    coding: bool = False
    format: str = "text"
    prefix: str = ""
    first_base: int | None = None
    last_base: int | None = None
    strands: str = "+-"
    evidence: str | None = None
    homology: str | None = None
    utr: bool = False
    reads_per_million: float | None = None
    single_gene: bool = False
    predict_only: bool = False  # no assembly
    assemble: str | None = None  # a file of exons instead of a prediction
    minor: bool = False  # scan for the minor splice classes
    recursive: bool = False  # exons of no bases at recursive splice sites
    orfs: bool = False  # what lies between two stops
    flank: int = 0  # bases on either side whose mean coverage is background

    def check(self) -> Options:
        writes = bool(self.sites or self.exons or self.introns)
        predicts = writes or bool(self.evidence or self.homology or self.utr or self.single_gene)
        sequences = self.proteins or self.coding or self.transcripts
        refused = [
            (self.format not in FORMATS, f"format is one of {', '.join(FORMATS)}"),
            (not self.strands or not set(self.strands) <= set("+-"), "strands are + and -"),
            (bool(self.assemble) and self.predict_only, "assembly alone and prediction alone"),
            (bool(self.assemble) and predicts, "assembly of given exons takes no options of a prediction"),
            (self.predict_only and (sequences or bool(self.evidence) or self.single_gene), "a prediction without assembly has no genes to write or to force"),
            (self.format == "xml" and writes, "sites and exons aren't written as XML"),
            (self.format == "gff2" and (self.proteins or self.coding), "sequences need GFF3"),
            (self.utr and not self.homology, "UTR exons need read coverage"),
            (self.reads_per_million is not None and not self.utr, "reads per million need UTR exons"),
            (None not in (self.first_base, self.last_base) and self.first_base > self.last_base, "the region ends before it begins"),
        ]
        for bad, why in refused:
            if bad:
                raise ValueError(why)
        return self


def one_gene_rules() -> list[Rule]:
    """Rules that allow one whole gene on either strand, and nothing else."""
    both = lambda *kinds: frozenset(k + s for k in kinds for s in "+-")
    return [
        Rule(frozenset({"First+", "Internal+"}), frozenset({"Internal+", "Terminal+"}), 20, 40_000, True),
        Rule(frozenset({"Terminal-", "Internal-"}), frozenset({"First-", "Internal-"}), 20, 40_000, True),
        Rule(both("Begin"), frozenset({"First+", "Terminal-", "Single+", "Single-"}), 0),
        Rule(frozenset({"Terminal+", "First-", "Single+", "Single-"}), both("End"), 0),
    ]
