"""Untranslated exons: ends of transcripts from the edges of read coverage, edge scores of sites, and seven joins of left and right sites.

Coverage comes as tracks of log(reads + 1). A transcript may begin where coverage rises from nothing or where the change of its slope has a
peak, and end where it falls to nothing or the change has a peak downwards; not where a strong splice site lies
near, since coverage rises and falls there, too. Only bins with coverage and their neighbours are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.operators import lists as L
from codonlake.operators import ranges as R
from codonlake.operators.tracks import BIN, with_sums

#: Left and right site of each type of exon, and the length that it stays below: fixed values.
KINDS = [
    ("UTR_First", "tss", "donor", 1000),
    ("UTR_First_Half", "tss", "start", 1000),
    ("UTR_Internal", "acceptor", "donor", 1000),
    ("UTR_5prime_Internal_Half", "acceptor", "start", 1000),
    ("UTR_3prime_Internal_Half", "stop", "donor", 1000),
    ("UTR_Terminal_Half", "stop", "tes", 5000),
    ("UTR_Terminal", "acceptor", "tes", 5000),
]
#: Right sites that a left one keeps, and what each base takes off their score; positions on either side of an edge, what scores
#: are multiplied with; least peaks of beginnings and ends; a splice site over this score within so many positions hides them: fixed values.
MOST, PER_BASE, SIDE, FACTOR, RISE, FALL, STRONG, NEAR = 8, 0.002, 6, 10.0, 1.2, 8.0, 5.0, 3
HALO = 8


def edges(bins: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows (locus, strand, kind, pos, score) of places where transcripts may begin (tss) and end (tes), from tracks of logarithms; positions from 0 on the strand."""
    own = bins.where("frame6 in (0, 3)")
    values = F.expr("transform(cum, (x, i) -> if(i = 0, x, x - cum[i - 1]))")
    rows = own.select("locus", "frame6", "bin", values.alias("v"))
    around = rows.select("locus", "frame6", F.explode(F.array(F.col("bin") - 1, F.col("bin") + 1)).alias("bin")).where("bin >= 0").distinct()
    full = rows.join(around, ["locus", "frame6", "bin"], "full")
    w = W.partitionBy("locus", "frame6").orderBy("bin")
    beside = lambda f, d, part: F.when(f("bin").over(w) == F.col("bin") + d, part(f("v").over(w)))
    full = full.select("locus", "frame6", "bin", "v", beside(F.lag, -1, lambda v: F.slice(v, BIN - HALO + 1, HALO)).alias("left"), beside(F.lead, 1, lambda v: F.slice(v, 1, HALO)).alias("right"))
    full = full.join(lengths.select("locus", "length"), "locus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for locus, frame6, b, v, left, right, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.concatenate([np.array(part if part is not None else [0.0] * n) for part, n in ((left, HALO), (v, BIN), (right, HALO))])
                # place k of x is position b * BIN + k - HALO + 1, counted from 1; an edge at q is asked one place later
                q = b * BIN + 1 + np.arange(-2, BIN + 1)
                k = np.arange(-2, BIN + 1) + HALO
                s = np.concatenate([[0.0], np.cumsum(x)])
                upto = lambda i: s[np.clip(i + 1, 0, len(s) - 1)]
                pes = FACTOR * ((upto(k + SIDE) - upto(k)) / SIDE - (upto(k) - upto(k - SIDE)) / SIDE)
                pes = np.where((q - SIDE >= 0) & (q - 1 + SIDE < length - 1), pes, 0.0)
                ok = (q - 2 >= 0) & (q < length - 1)
                # sums of logarithms differ in their last digits
                zero, some = np.abs(x) < 1e-9, x > 1e-9
                rises = ok & zero[k - 1] & some[k]
                falls = ok & some[k] & zero[np.minimum(k + 1, len(x) - 1)]
                for kind, sign, edge, least in (("tss", 1.0, rises & ~falls, RISE), ("tes", -1.0, falls, FALL)):
                    e = sign * pes
                    at = np.flatnonzero(edge[2:] | ((e[1:-1] > least) & (e[1:-1] > e[:-2] + 1e-9) & (e[1:-1] > e[2:] + 1e-9)))
                    # q[j + 2] is the place that asks; the site is one before it, from 0
                    pos = q[at + 2] - 2
                    good = (q[at + 2] - 1 >= 0) & (q[at + 2] <= length) & (pos >= 0)
                    # each place belongs to the bin that asks for it
                    good &= (q[at + 2] > b * BIN) & (q[at + 2] <= (b + 1) * BIN)
                    at, pos = at[good], pos[good]
                    out[0] += [locus] * len(at)
                    out[1] += ["-" if frame6 else "+"] * len(at)
                    out[2] += [kind] * len(at)
                    out[3] += pos.tolist()
                    out[4] += e[at + 1].tolist()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["locus", "strand", "kind", "pos", "score"])

    return full.select("locus", "frame6", "bin", "v", "left", "right", "length").mapInArrow(run, "locus string, strand string, kind string, pos long, score double")


def termini(bins: DataFrame, lengths: DataFrame, sites: DataFrame) -> DataFrame:
    """``edges`` without those that have a strong acceptor (beginnings) or donor (ends) of ``sites`` near."""
    found, by = edges(bins, lengths), ["locus", "strand"]
    strong = sites.where(F.col("score") > STRONG)
    rest = [R.without_near(found.where(F.col("kind") == kind), strong.where(F.col("kind") == other), by, "pos", NEAR, NEAR) for kind, other in (("tss", "acceptor"), ("tes", "donor"))]
    return rest[0].unionByName(rest[1])


def with_edges(sites: DataFrame, bins: DataFrame, lengths: DataFrame) -> DataFrame:
    """``sites`` (locus, strand, kind, pos, score...) with the change of coverage at acceptors added to their score, and taken off at donors."""
    q = F.col("pos") + 1
    s = sites.join(lengths.select("locus", "length"), "locus").withColumn("frame6", F.when(F.col("strand") == "-", 3).otherwise(0))
    s = with_sums(s, bins, {"__after": (q, q + SIDE), "__before": (q - SIDE, q)})
    edge = F.when((q - SIDE >= 0) & (F.col("pos") + SIDE < F.col("length") - 1), FACTOR * (F.col("__after") / SIDE - F.col("__before") / SIDE)).otherwise(0.0)
    sign = F.when(F.col("kind") == "acceptor", 1).when(F.col("kind") == "donor", -1).otherwise(0)
    return s.withColumn("score", (F.col("score") + sign * edge).cast("float")).select(*sites.columns)


def paired(left: dict[str, L.Sites], right: dict[str, L.Sites]) -> Iterator[tuple[str, L.Sites, L.Sites]]:
    """(type, left sites, right sites) of all seven types, pair by pair and in pieces: for each left site the MOST right sites that score best
    after what their distance takes off; of equal ones the nearer."""
    for name, a, b, most in KINDS:
        x, y = left.get(a, L.NONE), right.get(b, L.NONE)
        lo, hi = np.searchsorted(y.at, x.at, "right"), np.searchsorted(y.at, x.at + most, "left")
        upto = np.concatenate([[0], np.cumsum(hi - lo)])
        i = 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
            run, member = L.runs(lo[i:j], hi[i:j])
            many = (hi - lo)[i:j][run] > MOST
            k, m = run[many], member[many]
            # in a run, members lie in order of place and class, which a stable sort keeps
            order = np.lexsort((-(y.score[m].astype(np.float64) - PER_BASE * (y.at[m] - x.at[i + k] + 1)), k))
            nth = np.arange(len(k)) - np.searchsorted(k, k, "left")
            best = order[nth < MOST]
            run, member = np.concatenate([run[~many], k[best]]), np.concatenate([member[~many], m[best]])
            if len(run):
                yield name, x.take(i + run), y.take(member)
            i = j


#: The longest of all types, and pairs of sites that are looked at at once.
REACH, PAIRS = max(n for *_, n in KINDS), 1 << 18


def build(sites: DataFrame, by: list[str], piece: int = 1 << 17) -> DataFrame:
    """Rows (by, type, left_pos, right_pos, left_score, right_score) of all seven types, as ``paired``. Sites are dealt once, to pieces of a
    sequence that have the right sites of the next one within reach, too; pairs meet in the task of their piece and are never dealt."""
    if piece < REACH:
        raise ValueError("a piece is as long as the longest type at least")
    cls, kinds = ["cls"] if "cls" in sites.columns else [], dict(sites.dtypes)
    cut = lambda c: f"greatest({c}, 0) div {piece}"
    known = sites.where(" and ".join(f"{c} is not null" for c in [*by, "pos"])).select(*by, "kind", F.col("pos").cast("long").alias("pos"), "score", *cls)
    dealt = known.withColumn("__piece", F.explode(F.array_distinct(F.array(F.expr(cut("pos")), F.expr(cut(f"pos - {REACH}"))))))
    columns = [*by, "type", "left_pos", "left_score", *["left_cls" for _ in cls], "right_pos", "right_score", *["right_cls" for _ in cls]]
    types = {"type": "string", "left_pos": "long", "right_pos": "long", "left_score": kinds["score"], "right_score": kinds["score"]} | {f"{side}_{c}": kinds[c] for side in ("left", "right") for c in cls}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        every, at = L.table_lists(table), key[-1].as_py()
        own = {kind: s.take(np.maximum(s.at, 0) // piece == at) for kind, s in every.items()}
        found = list(paired(own, every)) or [("", *[next(iter(every.values())).take(slice(0, 0))] * 2)]
        width = 2 + len(cls)
        return pa.concat_tables(pa.table([*[pa.repeat(k, len(x.at)) for k in key[:-1]], pa.repeat(name, len(x.at)), *[pa.array(c) for s in (x, y) for c in s[:width]]], columns) for name, x, y in found)

    return dealt.groupBy(*by, "__piece").applyInArrow(run, ", ".join(f"{c} {types.get(c, kinds.get(c))}" for c in columns))
