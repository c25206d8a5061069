"""Range, as-of and top-k joins, prefix sums and sweeps over positions, for any table.

All helpers take a list of partition columns; work of one partition is ordered by position and
never leaves Spark's own operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def next_at_or_after(df: DataFrame, by: list[str], pos: str, marked: Column, out: str) -> DataFrame:
    """Forward as-of: the first position at or after each row's at which ``marked`` holds."""
    w = W.partitionBy(*by).orderBy(F.desc(pos)).rangeBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.min(F.when(marked, F.col(pos))).over(w))


def last_before(df: DataFrame, by: list[str], pos: str, marked: Column, value: Column, out: str) -> DataFrame:
    """Backward as-of: ``value`` of the last marked row strictly before each row's position."""
    w = W.partitionBy(*by).orderBy(pos).rangeBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.max_by(F.when(marked, value), F.when(marked, F.col(pos))).over(w))


def range_join(left: DataFrame, right: DataFrame, by: list[str], lo: str, hi: str, pos: str, bin_size: int) -> DataFrame:
    """Pairs of equal ``by`` columns with lo <= pos < hi. Bins make it an equi-join: a left row is
    copied to the bins its range touches, a right row has one, so no pair comes up twice."""
    bins = F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor((F.col(hi) - 1) / bin_size)))
    a = left.where(F.col(hi) > F.col(lo)).withColumn("__bin", bins)
    b = right.withColumn("__bin", F.floor(F.col(pos) / bin_size))
    return a.join(b, [*by, "__bin"]).where((F.col(pos) >= F.col(lo)) & (F.col(pos) < F.col(hi))).drop("__bin")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in a total order."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def running_sum(df: DataFrame, by: list[str], pos: str, value: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(W.partitionBy(*by).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)))


def sweep(intervals: DataFrame, by: list[str], lo: str, hi: str, bin_size: int | None = None) -> DataFrame:
    """Coverage of half-open intervals as rows (by, start, end, depth) of constant depth over 0.

    Ends count once each before they are ordered, so common ends don't pile up. With a ``bin_size`` the
    positions of one key are swept in bins of that size, each from the depth at which the bins before it
    end: only a row for each bin is ordered as a whole.
    """
    ends = intervals.where(F.col(hi) > F.col(lo)).select(*by, F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(1).alias("d")), F.struct(F.col(hi).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*by, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    if bin_size is None:
        w = W.partitionBy(*by).orderBy("start")
        out = steps.withColumns({"depth": F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)), "end": F.lead("start").over(w)})
    else:
        steps = steps.withColumn("__bin", F.floor(F.col("start") / bin_size))
        order = W.partitionBy(*by).orderBy("__bin")
        bins = steps.groupBy(*by, "__bin").agg(F.sum("d").alias("__sum"), F.min("start").alias("__first"))
        bins = bins.withColumns({"__before": F.coalesce(F.sum("__sum").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "__next": F.lead("__first").over(order)})
        w = W.partitionBy(*by, "__bin").orderBy("start")
        inner = steps.withColumns({"__run": F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)), "__end": F.lead("start").over(w)})
        out = inner.join(bins, [*by, "__bin"]).withColumns({"depth": F.col("__before") + F.col("__run"), "end": F.coalesce("__end", "__next")})
    return out.where("depth > 0").select(*by, "start", "end", "depth")


def without_near(left: DataFrame, right: DataFrame, by: list[str], pos: str, before: int, after: int) -> DataFrame:
    """Anti-join: rows of ``left`` with no row of ``right`` in [pos - before, pos + after), by one ordered pass over both."""
    w = W.partitionBy(*by).orderBy(pos).rangeBetween(-before, after - 1)
    both = left.withColumn("__right", F.lit(0)).unionByName(right.select(*by, pos).withColumn("__right", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__near", F.sum("__right").over(w)).where("__right = 0 and __near = 0").select(*left.columns)


def islands(df: DataFrame, by: list[str], pos: Column, starts: Column, out: str) -> DataFrame:
    """Number the runs of rows that begin where ``starts`` holds."""
    return df.withColumn(out, F.sum(starts.cast("int")).over(W.partitionBy(*by).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)))
