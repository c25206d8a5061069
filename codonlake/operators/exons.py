"""Exons from sites by as-of, range and top-k searches in sorted lists, their scores, and the best chain of exons of a locus.

Sites are rows (locus, frag, strand, kind, pos, score) with kinds start, acceptor, donor and stop;
positions of "-" are those of the reverse complement until exons are put on the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.functions.dna import split_codon_left, split_codon_right
from codonlake.operators import lists as L
from codonlake.operators import utr as U
from codonlake.operators.chains import COLUMNS, INTRONS, MINOR, ChainState, Rule, linked, traced
from codonlake.operators.signals import FRAGMENT, OVERLAP, coding_potentials, fragments, owned
from codonlake.operators.splice import scan_sites
from codonlake.operators.tracks import homology, on_strand, tracks
from codonlake.sources.formats import NO_GROUP
from codonlake.sources.params import Isochore, Parameters
from codonlake.sources.scratch import kept

BY = ["locus", "frag", "strand"]
#: Least internal exon, least single gene with its stop, score of the ends of a region.
LEAST_INTERNAL, LEAST_SINGLE, END_SCORE = 18, 60, 10000.0
TYPES = ("First", "Internal", "Terminal", "Single")
#: Types that end before a start codon, and that begin behind a stop codon: of their two sites one counts.
BEFORE_START, BEHIND_STOP = ("UTR_First_Half", "UTR_5prime_Internal_Half"), ("UTR_Terminal_Half", "UTR_3prime_Internal_Half")
_FAR = 1 << 40


#: Types that are scored like another one, and the site scores that a recursive splice site needs unless given: fixed values.
LIKE, RECURSIVE = {"RSS": "Internal", "ORF": "Single"}, (4.0, 4.0)


#: What ``joined`` gives, and its types in rows of exons.
PARTS = {"type": "string", "left_pos": "long", "right_pos": "long", "frame": "int", "rest": "int", "left_score": None, "right_score": None, "left_cls": "int", "right_cls": "int"}


def joined(sites: dict[str, L.Sites], base: np.ndarray, most_donors: int, recursive: tuple[float, float] | None = None, orfs: bool = False) -> Iterator[tuple]:
    """(type, left and right places on the axis, frame, rest, scores and classes of both ends) of all exons of a few sequences, in pieces;
    ``recursive`` and ``orfs`` as for ``build``."""
    start, acceptor, donor, stop = (sites.get(k, L.NONE) for k in ("start", "acceptor", "donor", "stop"))
    last = np.full(len(base) - 1, -1, np.int64)
    for s in sites.values():
        before = np.searchsorted(s.at, base[1:]) - 1
        last = np.maximum(last, np.where(before >= 0, s.at[np.maximum(before, 0)] if len(s.at) else -1, -1))
    far = last + 1  # where no stop closes a frame, any donor may end an exon
    # a stop's codon starts behind its last coding base
    frames = [np.flatnonzero((stop.at + 1) % 3 == p) for p in range(3)]
    stop_at, stop_score = np.append(stop.at, _FAR), np.append(stop.score, 0)
    listed = [(stop.at[own], np.append(own, len(stop.at))) for own in frames]

    def closing(at: np.ndarray, frame: int, end: np.ndarray) -> np.ndarray:
        """The first stop at or after each place in its frame, of the same sequence; the number of stops where there is none."""
        out = np.full(len(at), len(stop.at), np.int64)
        for p, (own_at, own) in enumerate(listed):
            mine = np.flatnonzero((at + frame) % 3 == p)
            out[mine] = own[np.searchsorted(own_at, at[mine] - 1)]
        return np.where(stop_at[out] < end, out, len(stop.at))

    def rest(left: np.ndarray, right: np.ndarray, frame: int) -> np.ndarray:
        return (3 - (right - (left + frame) + 1) % 3) % 3

    def closed(kind: str, left: L.Sites, which: np.ndarray, frame: int) -> tuple:
        zero = np.zeros(len(which), np.int32)
        return kind, left.at, stop_at[which], zero + frame, zero, left.score, stop_score[which], left.cls, zero

    def until(left: L.Sites, lo: int, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(donor.at, left.at + lo), np.searchsorted(donor.at, hi)

    def ranked(nearest: bool) -> L.Best:
        return L.Best(np.lexsort((donor.cls, donor.at if nearest else -donor.at, -donor.score)))

    best = ranked(True) if len(start.at) else None
    for cut in L.pieces(len(start.at)):
        x = start.take(cut)
        x = x._replace(cls=np.zeros(len(x.at), np.int32))
        g = L.group_of(base, x.at)
        which = closing(x.at, 0, base[g + 1])
        some = which < len(stop.at)
        i, j = best.first(*until(x, 2, np.where(some, stop_at[which] + 3, far[g])), most_donors)
        left, right = x.take(i), donor.take(j)
        yield "First", left.at, right.at, np.zeros(len(i), np.int32), rest(left.at, right.at, 0), left.score, right.score, left.cls, right.cls
        long = np.flatnonzero(some & (stop_at[which] + 3 - x.at + 1 >= LEAST_SINGLE))
        yield closed("Single", x.take(long), which[long], 0)

    best = ranked(False) if len(acceptor.at) else None
    strong = donor.take(donor.score > recursive[0]) if recursive else L.NONE
    for cut in L.pieces(len(acceptor.at)):
        x = acceptor.take(cut)
        g = L.group_of(base, x.at)
        three = [closing(x.at, frame, base[g + 1]) for frame in range(3)]
        for frame, which in enumerate(three):
            ends = np.flatnonzero((which < len(stop.at)) & (stop_at[which] >= x.at))
            yield closed("Terminal", x.take(ends), which[ends], frame)
        ends = [np.where(which < len(stop.at), stop_at[which] + 3, _FAR) for which in three]
        i, j = best.first(*until(x, LEAST_INTERNAL, np.minimum(np.max(ends, 0), far[g])), most_donors)
        for frame, end in enumerate(ends):
            open_ = donor.at[j] < end[i]
            left, right = x.take(i[open_]), donor.take(j[open_])
            yield "Internal", left.at, right.at, np.full(len(left.at), frame, np.int32), rest(left.at, right.at, frame), left.score, right.score, left.cls, right.cls
        if recursive is not None:
            y = x.take(x.score > recursive[1])
            i, j = L.runs(np.searchsorted(strong.at, y.at - 1), np.searchsorted(strong.at, y.at))
            left, right = y.take(i), strong.take(j)
            for frame in range(3):
                both = np.full(len(i), frame, np.int32)
                yield "RSS", left.at, right.at, both, both, left.score, right.score, left.cls, right.cls
    if orfs:
        g = L.group_of(base, stop.at)
        for own in frames:
            x, y = own[:-1], own[1:]
            far_on = (g[x] == g[y]) & (stop.at[y] + 3 - stop.at[x] + 1 >= LEAST_SINGLE)
            left = stop.take(x[far_on])
            yield closed("ORF", left._replace(cls=np.zeros(len(left.at), np.int32)), y[far_on], 0)


def build(sites: DataFrame, most_donors: int, recursive: tuple[float, float] | None = None, orfs: bool = False) -> DataFrame:
    """First, Internal, Terminal and Single exons of all fragments and strands; ``cls``, where there is one, is the splice class of a site. Sites
    are dealt once, by fragment and strand, and their lists are joined there.

    ``recursive``: also exons of no bases (RSS), where a donor and an acceptor over these scores meet. ``orfs``: also what lies between two
    stops of a frame (ORF).
    """
    kinds = dict(sites.dtypes)
    known = sites.where(" and ".join(f"{c} is not null" for c in [*BY, "pos"])).select(*BY, "kind", F.col("pos").cast("long").alias("pos"), "score", *[F.col(c).cast("int").alias(c) for c in kinds if c == "cls"])
    ints = {"long": pa.int64(), "int": pa.int32()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found, score = L.table_lists(table), table.schema.field("score").type
        out = [pa.table([*[pa.repeat(k, len(at)) for k in key], pa.repeat(name, len(at)), *[pa.array(c, ints.get(t, score)) for c, t in zip((at, *more), list(PARTS.values())[1:], strict=True)]], [*BY, *PARTS]) for name, at, *more in joined(found, np.array([0, _FAR]), most_donors, recursive, orfs)]
        return pa.concat_tables(out) if out else pa.table([pa.array([], x) for x in (*[k.type for k in key], pa.string(), *[ints.get(t, score) for t in list(PARTS.values())[1:]])], [*BY, *PARTS])

    return known.groupBy(*BY).applyInArrow(run, ", ".join(f"{c} {PARTS.get(c) or kinds[c if c in BY else 'score']}" for c in [*BY, *PARTS]))


def scored(exons: DataFrame, frags: DataFrame, iso: Isochore | list[Isochore], bins: DataFrame | None = None, unset: float = 0.0, flank: int = 0) -> DataFrame:
    """Exons over their cutoffs, with score, coding potential and what their ends may add to a stop codon; each by the values of its isochore.
    With the ``bins`` of tracks the similarity or coverage of an exon counts by its factor; exons without enough coding potential aren't looked up."""
    isos = iso if isinstance(iso, list) else [iso]

    def by_type(name: str):
        out = F
        for k, one in enumerate(isos):
            for i, kind in enumerate(TYPES):
                out = out.when((F.col("isochore") == k) & F.col("type").isin(kind, *[x for x, y in LIKE.items() if y == kind]), one.values[name][i])
            out = out.when(F.col("isochore") == k, one.values[name][-1])  # untranslated exons: a fifth value, else that of single ones
        return out

    coding, back = F.col("type").isin(*TYPES, *LIKE), F.col("strand") == "-"
    empty = reduce(lambda c, k: c.when(F.col("isochore") == k, isos[k].values.get("RSS_Markov_Score", [0.0])[0]), range(len(isos)), F)
    out = coding_potentials(exons, frags, isos).withColumn("potential", F.when(F.col("type") == "RSS", empty).when(coding, F.col("potential")).otherwise(0.0)).where(~coding | (F.col("potential") >= by_type("Coding_cutoff_oligos")))
    left, right = F.col("left_score"), F.col("right_score")
    ends = F.when(F.col("type").isin(*BEFORE_START), F.when(back, right).otherwise(left)).when(F.col("type").isin(*BEHIND_STOP), F.when(back, left).otherwise(right)).otherwise(left + right)
    total = by_type("Site_factor") * ends + by_type("Exon_factor") * F.col("potential")
    if bins is not None:
        out = kept(out.join(frags.where("frag = 0").select("locus", "strand", "length"), ["locus", "strand"]), "coding")
        out = homology(out, bins, unset, flank).drop("length")
        total = total + by_type("HSP_factor") * F.col("homology")
    out = out.withColumn("score", total).where(F.col("score") >= by_type("Absolute_cutoff_exons"))
    minor = F.when((F.col("left_cls") > 0) & (F.col("right_cls") > 0), reduce(lambda c, k: c.when(F.col("isochore") == k, isos[k].values.get("U12_Exon_weight", [0.0])[0]), range(len(isos)), F)).otherwise(0.0)
    out = out.withColumn("score", (F.col("score") + by_type("Exon_weights") + minor).cast("float"))
    one = ~F.col("type").isin("First", "Internal", "Terminal")
    return out.withColumns({"lvalue": F.when(one, 0).otherwise(split_codon_left(F.col("frame"), F.col("head"))), "rvalue": F.when(one, 0).otherwise(split_codon_right(F.col("rest"), F.col("tail")))})


def placed(exons: DataFrame, lengths: DataFrame) -> DataFrame:
    """Exons on the sequence's own coordinates: ends of "-" swap, and so do frame and remainder for the chain."""
    back = F.col("strand") == "-"
    e = exons.join(lengths, "locus")
    return e.select("locus", "strand", "type", F.when(back, F.col("length") - 1 - F.col("right_pos")).otherwise(F.col("left_pos")).alias("lo"), F.when(back, F.col("length") - 1 - F.col("left_pos")).otherwise(F.col("right_pos")).alias("hi"), "frame", "rest", "score", "potential", "left_score", "right_score", "lvalue", "rvalue", "left_cls", "right_cls", *[c for c in ("homology",) if c in exons.columns]).dropDuplicates(["locus", "strand", "type", "lo", "hi", "frame", "left_cls", "right_cls"])


#: Order of elements that begin at one base: types forwards, then backwards, then what is given.
def _rank(type_, strand, given):
    kinds = F.array(*[F.lit(t) for t in (*TYPES, *LIKE, *[k for k, *_ in U.KINDS])])
    return F.when(given == 1, 100).otherwise(F.array_position(kinds, type_) + F.when(strand == "-", 50).otherwise(0))


def elements(exons: DataFrame, lengths: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Exons (as ``placed``) as elements of a chain: ends as they are printed, what is taken and left of codons in the order of
    the sequence, and the ends of each locus as elements of their own, so that whole genes are preferred.

    ``given`` has evidence as ``from_evidence`` makes it.
    """
    back = F.col("strand") == "-"
    # the stop codon belongs to the last exon; untranslated halves end before the start codon and begin behind the stop codon
    begin = F.when(F.col("type").isin(*BEHIND_STOP), 4).when(F.col("type") == "ORF", 1).otherwise(0)
    end = F.when(F.col("type").isin("Terminal", "Single", "ORF"), 3).when(F.col("type").isin(*BEFORE_START), -1).otherwise(0)
    swap = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    found = exons.withColumns({
        "left": F.col("lo") + 1 + F.when(back, -end).otherwise(begin), "right": F.col("hi") + 1 + F.when(back, -begin).otherwise(end), "kind": F.concat("type", "strand"), "need": swap("frame", "rest"), "give": swap("rest", "frame"),
        "evidence": F.lit(0), "grp": F.lit(None).cast("string"), "lscore": swap("left_score", "right_score"), "rscore": swap("right_score", "left_score"), "lclass": swap("left_cls", "right_cls"), "rclass": swap("right_cls", "left_cls"),
    })
    ends = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("strand")) for t in ("Begin", "End") for s in "+-"])
    ends = lengths.select("locus", "length", F.explode(ends).alias("e")).select("locus", "e.*", F.when(F.col("e.type") == "Begin", F.lit(0)).otherwise(F.col("length") + 1).cast("long").alias("left"))
    ends = ends.withColumns({"right": F.col("left"), "kind": F.concat("type", "strand"), "score": F.lit(END_SCORE).cast("float"), "evidence": F.lit(0)})
    out = found.unionByName(ends, allowMissingColumns=True)
    if given is not None:
        out = out.unionByName(given, allowMissingColumns=True)
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(dict(out.dtypes)[c])) for c in ("need", "give", "lclass", "rclass", "lscore", "rscore", "lvalue", "rvalue")}
    return out.withColumns(zero).withColumn("rank", F.coalesce(_rank(F.col("type"), F.col("strand"), F.col("evidence")), F.lit(0)))


def from_evidence(evidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of ``read_evidence`` as elements; a type that no rule names is left out."""
    known = sorted({k for r in rules for k in r.up | r.down})
    classes = F.create_map(*[x for i, c in enumerate(("U2", "U12gtag", "U12atac")) for x in (F.lit(c), F.lit(i))])
    cls = lambda c: F.coalesce(F.try_element_at(classes, F.col(c)), F.lit(0))
    back, joins = F.col("strand") == "-", F.col("feature").isin(*INTRONS)
    rest = F.when(joins, F.col("frame")).otherwise(F.pmod(3 - F.pmod(F.col("end") - F.col("start") + 1 - F.col("frame"), F.lit(3)), F.lit(3)))
    e = evidence.withColumns({"kind": F.concat("feature", "strand"), "rest": rest.cast("int"), "frame": F.col("frame").cast("int")}).where(F.col("kind").isin(*known))
    return e.select(
        "locus", "strand", F.col("feature").alias("type"), (F.col("start") - 1).alias("lo"), (F.col("end") - 1).alias("hi"), "frame", "rest", "score", "kind", F.col("start").alias("left"), F.col("end").alias("right"),
        F.when(back, F.col("rest")).otherwise(F.col("frame")).alias("need"), F.when(back, F.col("frame")).otherwise(F.col("rest")).alias("give"), F.when(F.col("group") != NO_GROUP, F.col("group")).alias("grp"), F.lit(1).alias("evidence"),
        F.when(back, cls("donor")).otherwise(cls("acceptor")).alias("lclass"), F.when(back, cls("acceptor")).otherwise(cls("donor")).alias("rclass"),
    )


def numbered(chain_rows: DataFrame) -> DataFrame:
    """The elements of chains with the number of their gene: one begins at a change of strand, at what begins a gene, and after what ends one."""
    w = W.partitionBy("locus").orderBy("nth")
    e = chain_rows.withColumns({"__s": F.lag("strand").over(w), "__t": F.lag("type").over(w)})
    kind, before = F.col("type"), F.col("__t")
    forward = F.col("strand") == "+"
    begins = F.when(forward, kind.isin("Promoter") | (kind.isin("First", "Single") & (before != "Promoter"))).otherwise(kind.isin("Terminal", "Single"))
    ends = F.when(forward, before.isin("Terminal", "Single")).otherwise((before == "Promoter") | (before.isin("First", "Single") & (kind != "Promoter")))
    new = F.col("__s").isNull() | (F.col("__s") != F.col("strand")) | begins | ends
    return e.withColumn("gene", F.sum(new.cast("long")).over(w)).drop("__s", "__t")


def best_genes(exons: list[tuple], length: int, rules: list[Rule]) -> list[int]:
    """Indexes of the best chain, from left to right, of a few exons (strand, type, lo, hi, frame, rest, score, lvalue, rvalue) of one locus, by the kernel of ``chain``."""
    rows = [(e[2] + 1, e[3] + 1, e[1] + e[0], e[6], *((e[5], e[4]) if e[0] == "-" else (e[4], e[5])), e[7], e[8], i) for i, e in enumerate(exons)]
    rows += [(at, at, t + s, END_SCORE, 0, 0, 0, 0, -1) for t, at in (("Begin", 0), ("End", length + 1)) for s in "+-"]
    rows.sort(key=lambda r: r[0])
    named = dict(zip(("left", "right", "kind", "score", "need", "give", "lvalue", "rvalue"), map(list, zip(*rows, strict=True)), strict=False))
    state = ChainState(rules)
    _, before = state.feed({c: named.get(c, [default] * len(rows)) for c, default in COLUMNS.items()})
    out, at = [], state.best[1] if state.best else None
    while at is not None:
        out.append(rows[at][-1])
        at = before[at]
    return [i for i in reversed(out) if i >= 0]


def chain(exons: DataFrame, lengths: DataFrame, rules: list[Rule], given: DataFrame | None = None, minor: tuple[float, float] = MINOR) -> DataFrame:
    """The exons (and evidence) of the best chain of each locus with their gene's number. Elements stream through the state of their
    locus' chain, then backwards along it."""
    rows = linked(elements(exons, lengths, given), "locus", ["rank", "right", "need", "give"], rules, minor)
    best = traced(kept(rows, "chain"), "locus").where(~F.col("type").isin("Begin", "End"))
    return numbered(best)


def candidates(sequences: DataFrame, p: Parameters, strands: str = "+-", fragment: int = FRAGMENT, overlap: int = OVERLAP, segments: DataFrame | None = None, mode: str = "best", minor: bool = True, utr: bool = False, flank: int = 0, frags: DataFrame | None = None, recursive: bool = False, orfs: bool = False) -> DataFrame:
    """The scored exons of (locus, length, seq) on the sequence's coordinates, from fragments that each own their starts and acceptors;
    with ``segments`` of similarity or coverage (as read_homology) in their scores. Tracks belong to loci, so fragments need no share of them.
    ``minor``: scan for splice sites of the minor classes, too, where there are profiles.
    ``utr``: the segments are read coverage; splice sites are scored by its edges as well (those that fall below their cutoff aren't looked for), and
    untranslated exons are built from its beginnings and ends. ``frags``: the fragments, where they come from a file
    (sources.chromosomes) and ``sequences`` has lengths only.
    """
    frags = fragments(sequences, fragment, overlap, strands) if frags is None else frags
    found = scan_sites(frags, p.isochores, minor)
    lengths = sequences.select("locus", "length")
    bins = None
    if segments is not None:
        bins = kept(tracks(on_strand(segments, lengths), "cover" if utr else mode, p.no_score, logs=utr), "tracks")
    sites = owned(found.dropDuplicates([*BY, "kind", "pos", "cls"]), frags, overlap)
    sites = kept(U.with_edges(sites, bins, lengths) if utr else sites, "sites")  # each kind is read several times
    values = p.isochores[0].values
    least = tuple(values.get(k, [x])[0] for k, x in zip(("RSS_Donor_Score_Cutoff", "RSS_Acceptor_Score_Cutoff"), RECURSIVE, strict=True))
    exons = build(sites, max(iso.donors for iso in p.isochores), least if recursive else None, orfs)
    if utr:
        spans = frags.select(*BY, "l1", "l2")
        ends = U.termini(bins, lengths, sites).join(spans, ["locus", "strand"]).where("pos between l1 and l2").select(*BY, "kind", "pos", F.col("score").cast("float").alias("score"), F.lit(0).alias("cls"))
        more = U.build(sites.select(*BY, "kind", "pos", "score", "cls").unionByName(ends), BY)
        exons = exons.unionByName(more.withColumns({"frame": F.lit(0), "rest": F.lit(0)}))
    return placed(scored(exons, frags, p.isochores, bins, p.no_score, flank), lengths)


def thresholds(p: Parameters) -> tuple[float, float]:
    """Least sums of splice and of exon scores over an intron of the minor kind."""
    values = p.isochores[0].values
    return tuple(values.get(k, [x])[0] for k, x in zip(("U12_Splice_Score_Threshold", "U12_Exon_Score_Threshold"), MINOR, strict=True))


def predict(sequences: DataFrame, p: Parameters, strands: str = "+-", fragment: int = FRAGMENT, overlap: int = OVERLAP, evidence: DataFrame | None = None, **options) -> DataFrame:
    """Exons of the predicted genes of (locus, length, seq): GFF coordinates in start and end_. ``evidence`` (as read_evidence) takes part
    in the chains of its loci; other options are those of ``candidates``."""
    return assembled(candidates(sequences, p, strands, fragment, overlap, **options), sequences.select("locus", "length"), p, evidence)


def assembled(exons: DataFrame, lengths: DataFrame, p: Parameters, evidence: DataFrame | None = None) -> DataFrame:
    """The best chains of scored exons (as ``candidates``) and evidence."""
    given = None if evidence is None else from_evidence(evidence, p.rules).join(lengths.select("locus"), "locus", "left_semi")
    out = chain(exons, lengths, p.rules, given, thresholds(p))
    # printed ends: the stop codon belongs to the last exon
    return out.withColumns({"start": F.col("left"), "end_": F.col("right")})
