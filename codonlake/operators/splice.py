"""Sites of all splice classes: branch points and pyrimidine tracts before acceptors, the minor classes, windows cut by the left end.

An acceptor passes twice: its own signal reaches the cutoff (a lower one for the minor classes, whose signal is weak), and so does the signal
with its branch point. The branch point of an acceptor is the best window of a profile before it, less a penalty that grows with the square
of its distance from the usual place; all acceptors of a fragment look at one distance at a time. Of equal windows the
one nearer to the acceptor is taken. An acceptor of the usual class without any branch point over the cutoff
isn't a site where the parameters have a profile of branch points; tracts are reported only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.operators.signals import digits, gc_percent, isochore_of, profile_scores, words
from codonlake.sources.params import Isochore, Profile

#: Profiles by their heads: kind of site, splice class (0: the usual one) and subtype: fixed names and numbers.
FAMILIES = {
    "Start_profile": ("start", 0, ""),
    "Acceptor_profile": ("acceptor", 0, "U2"),
    "U12gtag_Acceptor_profile": ("acceptor", 1, "U12gtag"),
    "U12atac_Acceptor_profile": ("acceptor", 2, "U12atac"),
    "Donor_profile": ("donor", 0, "U2"),
    "U12gtag_Donor_profile": ("donor", 1, "U12gtag"),
    "U12atac_Donor_profile": ("donor", 2, "U12atac"),
    "U2gcag_Donor_profile": ("donor", 0, "U2gcag"),
    "U2gta_Donor_profile": ("donor", 0, "U2gta"),
    "U2gtg_Donor_profile": ("donor", 0, "U2gtg"),
    "U2gty_Donor_profile": ("donor", 0, "U2gty"),
    "Stop_profile": ("stop", 0, ""),
}
BRANCH, MINOR_BRANCH, TRACT = "Branch_point_profile", "U12_Branch_point_profile", "Poly_Pyrimidine_Tract_profile"
#: Context of a branch point, its least and its usual distance, the penalty's factor; how far the minor classes' first cutoff is
#: lowered (times the profile's factor): fixed values, the first four where a profile gives none.
PLACE, RELAXED = (50.0, 7.0, 12.0, 6.0), -7.0


def place_of(p: Profile) -> tuple[int, int, int, float]:
    context, least, usual, penalty = (*p.extra, *PLACE[len(p.extra) :])[:4]
    return int(context), int(least), int(usual), float(penalty)


def left_edge(d: np.ndarray, p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """(position, raw score) of windows that begin before the sequence: only the columns within it count."""
    w = words(d, p.order + 1, 5)
    at, score = [], []
    for k in range(p.offset):
        first = p.offset - k
        n = p.dimension - first
        if n > len(w):
            continue
        s = np.float32(0)
        for i in range(n):
            s += p.weights[first + i][w[i]]
        at.append(k + p.order)
        score.append(s)
    return np.array(at, np.int64), np.array(score, np.float32)


def _windows(d: np.ndarray, p: Profile) -> np.ndarray:
    """Raw scores of the windows that begin at ``order`` and after it."""
    return profile_scores(d, p, False)[1]


def _best(raw: np.ndarray, p: Profile, low: np.ndarray, end: np.ndarray, score, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """For each site the best window that begins at ``low`` or after it and ends before ``end``, and where it begins (-1: none)."""
    best, at = np.full(len(low), -np.inf, np.float32), np.full(len(low), -1, np.int64)
    width = int((end - p.dimension - low).max()) + 1 if len(low) else 0
    for k in range(max(0, width)):
        i = low + k
        ok = (i + p.dimension <= end) & (i - p.order < len(raw)) & (i >= p.order)
        s = score(i, raw[np.clip(i - p.order, 0, max(0, len(raw) - 1))]) if len(raw) else best
        ok &= s >= best
        if least is not None:
            ok &= s > np.float32(least)
        best[ok], at[ok] = s[ok], i[ok]
    return best, at


def branch_points(d: np.ndarray, p: Profile, acceptors: np.ndarray, minor: bool) -> tuple[np.ndarray, np.ndarray]:
    """(score, place from the acceptor; 0 without any) of each acceptor's branch point. Those of the usual class are rescaled and have to pass the profile's cutoff."""
    context, least, usual, penalty = place_of(p)
    low = np.maximum(p.order, acceptors - context)
    end = np.minimum(acceptors - least + p.dimension - p.offset, len(d) - 1)
    if not minor:
        end = np.minimum(end, acceptors)
    span, here = np.float32(context - p.offset - usual), np.maximum(0, acceptors - usual)

    def score(i: np.ndarray, raw: np.ndarray) -> np.ndarray:
        x = np.abs(i + p.offset - here).astype(np.float32) / span
        s = raw - np.float32(penalty) * (x * x)
        return s if minor else np.float32(p.a) + np.float32(p.b) * s

    best, at = _best(_windows(d, p), p, low, end, score, None if minor else p.cutoff)
    return best, np.where(at < 0, 0, at + p.offset - acceptors)


def tracts(d: np.ndarray, p: Profile, acceptors: np.ndarray, branch: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, place) of each acceptor's pyrimidine tract; of the minor classes it lies behind the branch point and needs no cutoff."""
    _, least, _, _ = place_of(p)
    low = np.maximum(p.order, acceptors - least - p.dimension)
    if branch is not None:
        low = np.maximum(low, acceptors + branch + 1)
    end = np.minimum(acceptors, len(d) - 1)
    best, at = _best(_windows(d, p), p, low, end, lambda i, raw: raw, p.cutoff if branch is None else None)
    return best, np.where(at < 0, 0, at + p.offset - acceptors)


def sites_of(d: np.ndarray, profiles: dict[str, Profile], first: bool, minor: bool = True, edge: bool = True) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """(head of the profile, columns pos, score, bp, bp_at, ppt, ppt_at) of the sites of one fragment; ``first``: nothing lies before it."""
    codon = words(d, 3, 5)
    for head, (kind, cls, _) in FAMILIES.items():
        p = profiles.get(head)
        if p is None or (cls and not minor):
            continue
        pos, raw = profile_scores(d, p, False)
        if first and edge and kind != "stop":
            a, b = left_edge(d, p)
            pos, raw = np.concatenate([a, pos]), np.concatenate([b, raw])
        scaled = raw if kind == "stop" else np.float32(p.a) + np.float32(p.b) * raw
        none, nowhere = np.zeros(len(pos), np.float32), np.zeros(len(pos), np.int64)
        cols = {"pos": pos, "score": scaled, "bp": none, "bp_at": nowhere, "ppt": none, "ppt_at": nowhere}
        ok = scaled >= np.float32(p.cutoff)
        if kind == "stop":
            near = np.minimum(pos + 1, max(0, len(codon) - 1))
            ok &= (pos + 1 < len(codon)) & np.isin(codon[near], [75, 77, 85]) if len(codon) else False  # TAA, TAG and TGA in base 5
        elif kind == "acceptor":
            ok = raw >= np.float32(p.cutoff) + (np.float32(RELAXED) * np.float32(p.b) if cls else np.float32(0))
            cols = {c: v[ok] for c, v in cols.items()}
            raw = raw[ok]
            bp, ppt = profiles.get(MINOR_BRANCH if cls else BRANCH), profiles.get(TRACT)
            if cls and bp is None:
                continue
            found = np.ones(len(raw), bool)
            if bp is not None:
                cols["bp"], cols["bp_at"] = branch_points(d, bp, cols["pos"], bool(cls))
                found = np.isfinite(cols["bp"]) & (cols["bp"] >= np.float32(bp.cutoff) if cls else True)
            if ppt is not None:
                cols["ppt"], cols["ppt_at"] = tracts(d, ppt, cols["pos"], cols["bp_at"] if cls else None)
            with np.errstate(invalid="ignore"):
                cols["score"] = np.float32(p.a) + np.float32(p.b) * (raw + cols["bp"])
                ok = found & (cols["score"] >= np.float32(p.cutoff))
        yield head, {c: v[ok] for c, v in cols.items()}


SCHEMA = "locus string, frag long, strand string, kind string, cls int, subtype string, pos long, score float, bp float, bp_at int, ppt float, ppt_at int"


def scan_sites(frags: DataFrame, isochores: list[Isochore], minor: bool = True, edge: bool = True) -> DataFrame:
    """Sites (SCHEMA) of fragments, by the profiles of the isochore that holds a fragment's G+C."""
    shared = frags.sparkSession.sparkContext.broadcast([(i.low, i.high, i.profiles) for i in isochores])
    heads = list(FAMILIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        for batch in batches:
            rows, which, found = [], [], []
            for i in range(batch.num_rows):
                l1, seq = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                d = digits(seq.encode())
                k = isochore_of(gc_percent(d), [(low, high) for low, high, _ in sets]) if len(sets) > 1 else 0
                for head, cols in sites_of(d, sets[k][2], l1 == 0, minor, edge):
                    cols["pos"] = cols["pos"] + l1
                    rows.append(np.full(len(cols["pos"]), i))
                    which.append(np.full(len(cols["pos"]), heads.index(head)))
                    found.append(cols)
            if not found:
                continue
            row, fam = pa.array(np.concatenate(rows)), pa.array(np.concatenate(which))
            column = lambda c, kind: pa.array(np.concatenate([f[c] for f in found]).astype(kind))
            by_family = [pa.array([FAMILIES[h][j] for h in heads], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            ppt = column("ppt", np.float32)
            yield pa.record_batch([*[batch.column(j).take(row) for j in range(3)], *[x.take(fam) for x in by_family], column("pos", np.int64), column("score", np.float32), column("bp", np.float32), column("bp_at", np.int32), ppt, column("ppt_at", np.int32)], [c.split()[0] for c in SCHEMA.split(", ")])

    return frags.select("locus", "frag", "strand", "l1", "seq").mapInArrow(run, SCHEMA)


#: A site that isn't found, and what sums and scores of a minor intron have to reach: fixed values.
ABSENT, MINOR_SUM, MINOR_END = -100.0, 2.0, -1.0


def classify(introns: DataFrame, sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """``introns`` (locus, strand, start, end_ from 1, on the sequence) with the best scores and subtypes of their ends among ``sites`` (scan_sites,
    both strands, minor classes included), donor_type and acceptor_type (U2, U12 or unknown), and intron_type.

    An intron whose usual scores sum up to more is U2; else it is U12 where the sum and both scores of the minor classes are high
    enough, U2 where both ends are known, and non-canonical otherwise.
    """
    back = F.col("strand") == "-"
    rows = introns.join(lengths.select("locus", "length"), "locus").withColumns({"__donor": F.when(back, F.col("length") - 1 - F.col("end_")).otherwise(F.col("start") - 2), "__acceptor": F.when(back, F.col("length") + 1 - F.col("start")).otherwise(F.col("end_"))})
    for kind in ("donor", "acceptor"):
        own = sites.where(F.col("kind") == kind).groupBy("locus", "strand", F.col("pos").alias(f"__{kind}"))
        found = own.agg(*[best_of.alias(f"__{c}") for c, best_of in (("u2", F.max(F.when(F.col("cls") == 0, F.struct("score", "subtype")))), ("u12", F.max(F.when(F.col("cls") > 0, F.struct("score", "subtype")))))])
        rows = rows.join(found, ["locus", "strand", f"__{kind}"], "left")
        u2, u12 = (F.coalesce(F.col(f"__{c}.score").cast("double"), F.lit(ABSENT)) for c in ("u2", "u12"))
        minor = (u12 > 0) & (u12 > u2)
        rows = rows.withColumns({
            f"u2_{kind}": u2, f"u12_{kind}": u12, f"{kind}_type": F.when(minor, "U12").when(u2 > ABSENT, "U2").otherwise("unknown"),
            f"{kind}_subtype": F.when(minor, F.col("__u12.subtype")).when(u2 > ABSENT, F.col("__u2.subtype")).otherwise("unknown"),
        }).drop("__u2", "__u12")
    usual, minor = F.col("u2_donor") + F.col("u2_acceptor"), F.col("u12_donor") + F.col("u12_acceptor")
    kind = F.when(usual > minor, "U2").when((minor >= MINOR_SUM) & (F.col("u12_donor") > MINOR_END) & (F.col("u12_acceptor") > MINOR_END), "U12").when((F.col("donor_type") != "unknown") & (F.col("acceptor_type") != "unknown"), "U2").otherwise("non-canonical")
    return rows.withColumn("intron_type", kind).drop("__donor", "__acceptor", "length")
