"""Similarity and read coverage as tracks of positions, and the scores of ranges from two lookups each.

Segments (locus, frame6, lo, hi, score; from 1, ends included, on the strand's own coordinates) are projected onto positions bin by
bin: a segment goes to the bins that it touches, a task keeps one bin, and a bin's row holds its running
sums. Sums of the bins before it come from one window over bin totals. The sum of any range is then the
difference of two points, whatever its length and however many segments lie on it: exons and segments never meet.

A position that no segment covers has the value ``unset``, also between bins that have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BY = ["locus", "frame6"]
#: Positions of a bin.
BIN = 512
#: Reads that count as one, and the most that coverage adds up to: fixed values.
PER_READ, CAP = 15.0, 15.0


def on_strand(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Segments of ``read_homology`` on their strand's own coordinates; those of loci without a length are left out."""
    back = F.col("strand") == "-"
    s = segments.join(lengths.select("locus", "length"), "locus")
    return s.select(*BY, F.when(back, F.col("length") - F.col("end") + 1).otherwise(F.col("start")).alias("lo"), F.when(back, F.col("length") - F.col("start") + 1).otherwise(F.col("end")).alias("hi"), "score")


def tracks(segments: DataFrame, mode: str = "best", unset: float = 0.0, logs: bool = False, per_read: float = PER_READ, cap: float = CAP) -> DataFrame:
    """Rows (locus, frame6, bin, cum, reads): running sums of the values of a bin's positions, and of the raw scores.

    ``best``: the largest score per position of the segments on a position. ``cover``: scores over ``per_read`` added in order of
    segments (lo, hi, score); what is added is capped, the first value is not. ``logs`` sums log(value + 1).
    """
    if mode not in ("best", "cover"):
        raise ValueError("mode is best or cover")
    cut = segments.where("hi >= lo and hi >= 1").select(*BY, "lo", "hi", F.col("score").cast("double").alias("score"), F.explode(F.sequence(F.expr(f"(greatest(lo, 1) - 1) div {BIN}"), F.expr(f"(hi - 1) div {BIN}"))).alias("bin"))
    dealt = cut.repartition(*BY, "bin").sortWithinPartitions(*BY, "bin", "lo", "hi", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("locus", pa.string()), ("frame6", pa.int32()), ("bin", pa.int64()), ("cum", pa.list_(pa.float64())), ("reads", pa.list_(pa.float64()))])
        key, value, isset, reads = None, np.zeros(BIN), np.zeros(BIN, bool), np.zeros(BIN)

        def row() -> tuple:
            v = np.where(isset, value, unset)
            return (*key, np.cumsum(np.log(v + 1) if logs else v).tolist(), np.cumsum(reads).tolist())

        for batch in batches:
            done = []
            for locus, frame6, lo, hi, score, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (locus, frame6, b) != key:
                    if key is not None:
                        done.append(row())
                    key, value, isset, reads = (locus, frame6, b), np.zeros(BIN), np.zeros(BIN, bool), np.zeros(BIN)
                at = slice(max(lo - 1 - b * BIN, 0), min(hi - b * BIN, BIN))
                if mode == "best":
                    one = score / (hi - lo + 1)
                    value[at] = np.where(isset[at], np.maximum(value[at], one), one)
                else:
                    one = score / per_read
                    value[at] = np.where(isset[at], np.minimum(value[at] + one, cap), one)
                    reads[at] += score
                # a position whose value equals that of an uncovered one counts as uncovered
                isset[at] = value[at] != unset
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kind.types, strict=True)] if done else [pa.array([], t) for t in kind.types], schema=kind)
        if key is not None:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(row(), kind.types, strict=True)], schema=kind)

    return dealt.select(*BY, "lo", "hi", "score", "bin").mapInArrow(run, "locus string, frame6 int, bin long, cum array<double>, reads array<double>")


def at_points(points: DataFrame, bins: DataFrame, unset: float = 0.0, column: str = "cum") -> DataFrame:
    """Distinct ``points`` (locus, frame6, pos) with ``upto``, the sum of the values of positions 1 to pos (0 at and before 0)."""
    p = points.select(*BY, F.col("pos").cast("long").alias("pos")).distinct().withColumn("bin", F.expr(f"(pos - 1) div {BIN}"))
    mine = bins.select(*BY, "bin", F.col(column).alias("cum"), (F.element_at(column, -1) - unset * BIN).alias("more"))
    asked = p.where("pos >= 1").select(*BY, "bin").distinct()
    both = mine.join(asked, [*BY, "bin"], "full").withColumn("more", F.coalesce("more", F.lit(0.0)))
    before = F.coalesce(F.sum("more").over(W.partitionBy(*BY).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) + F.col("bin") * unset * BIN
    known = both.select(*BY, "bin", "cum", before.alias("before"))
    off = F.expr(f"cast((pos - 1) % {BIN} as int)")
    got = p.join(known, [*BY, "bin"], "left")
    return got.select(*BY, "pos", F.when(F.col("pos") < 1, F.lit(0.0)).otherwise(F.col("before") + F.coalesce(F.get("cum", off), (off + 1) * unset)).alias("upto"))


def with_sums(ranges: DataFrame, bins: DataFrame, ends: dict[str, tuple[Column, Column]], unset: float = 0.0, column: str = "cum") -> DataFrame:
    """``ranges`` (locus, frame6 and what else there is) with a column for each of ``ends``: the sum over the positions after the first one of a pair up to the second."""
    named = {f"__{c}{i}": e for c, pair in ends.items() for i, e in enumerate(pair)}
    out = ranges.withColumns({c: e.cast("long") for c, e in named.items()})
    points = out.select(*BY, F.explode(F.array_distinct(F.array(*named))).alias("pos"))
    known = at_points(points, bins, unset, column)
    for c in named:
        out = out.join(known.select(*BY, F.col("pos").alias(c), F.col("upto").alias(f"{c}_upto")), [*BY, c], "left")
    return out.withColumns({c: F.col(f"__{c}1_upto") - F.col(f"__{c}0_upto") for c in ends}).drop(*named, *[f"{c}_upto" for c in named])


#: Types at whose left or right end (along the strand) nothing is transcribed, so no background is taken there: fixed names.
NO_LEFT, NO_RIGHT = ("First", "UTR_3prime_Internal_Half", "UTR_Terminal_Half", "Single"), ("Terminal", "UTR_5prime_Internal_Half", "UTR_First_Half", "Single")


def homology(exons: DataFrame, bins: DataFrame, unset: float = 0.0, flank: int = 0) -> DataFrame:
    """``exons`` (locus, strand, type, left_pos, right_pos from 0 on the strand, frame, length) with ``homology``: the track's sum in the exon's frame.

    With a ``flank`` the mean of the track over so many positions on either side is taken off for each position, except at
    ends where transcription begins or ends, and where there is no flank at all.
    """
    frame6 = (F.pmod(F.col("left_pos") + 1 + F.col("frame"), F.lit(3)) + F.when(F.col("strand") == "-", 3).otherwise(0)).cast("int")
    first, last = F.col("left_pos") + 1, F.col("right_pos") + 1
    ends = {"homology": (F.col("left_pos"), F.col("right_pos"))}
    if not flank:
        return with_sums(exons.withColumn("frame6", frame6), bins, ends, unset).drop("frame6")
    lo, hi = F.greatest(F.lit(0), first - flank), F.least(F.col("length") - 1, last + flank)
    left, right = ~F.col("type").isin(*NO_LEFT), ~F.col("type").isin(*NO_RIGHT) & (last < F.col("length"))
    ends |= {"__left": (lo, first), "__right": (last, F.greatest(hi, last))}
    out = with_sums(exons.withColumn("frame6", frame6), bins, ends, unset)
    n = F.when(left, first - lo).otherwise(0) + F.when(right, F.greatest(hi, last) - last).otherwise(0)
    around = F.when(left, F.col("__left")).otherwise(0.0) + F.when(right, F.col("__right")).otherwise(0.0)
    return out.withColumn("homology", F.col("homology") - F.when(n > 0, around / n * (last - first + 1)).otherwise(0.0)).drop("frame6", "__left", "__right")
