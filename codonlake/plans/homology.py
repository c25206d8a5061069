"""Segments (order lines) as similarity and coverage tracks, and orders as exons that are scored on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators.tracks import BIN, homology, tracks, with_sums
from codonlake.sources.scratch import kept

#: Loci, places, value of a position without a segment, and the flank that is taken for background.
LOCI, PLACES, UNSET, FLANK = 40, 3000, -0.70710678, 60
TYPES = ("First", "Internal", "Terminal", "Single")
#: Added before rounding to four digits: sums are often just between two of them, where the last bit decides.
OFF = 1e-6


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lo = (1 + (F.col("l_partkey") * 37 + F.col("l_orderkey")) % PLACES).cast("long")
    return line.select((F.col("l_suppkey") % LOCI).cast("string").alias("locus"), (F.col("l_linenumber") % 6).cast("int").alias("frame6"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi"), (F.col("l_orderkey") % 200 - 20).cast("double").alias("score"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), (F.col("o_custkey") % LOCI).cast("string").alias("locus"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.get(F.array(*[F.lit(t) for t in TYPES]), (k % 4).cast("int")).alias("type"), (k % PLACES).alias("left_pos"), (k % 3).cast("int").alias("frame"), F.lit(PLACES + 100).cast("long").alias("length"))
    return o.withColumn("right_pos", F.col("left_pos") + F.col("id") % 173)


def homology_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exon's similarity in its frame, less the background around it, and plain."""
    bins = kept(tracks(segments(spark, sf_dir), "best", UNSET), "tracks")
    own = homology(exons(spark, sf_dir), bins, UNSET).withColumnRenamed("homology", "similarity")
    out = homology(own, bins, UNSET, FLANK)
    return out.select("id", F.round(F.col("similarity") + OFF, 4).alias("similarity"), F.round(F.col("homology") + OFF, 4).alias("over_background"))


def coverage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped coverage and raw reads of each bin; the first segment of a position isn't capped."""
    bins = tracks(segments(spark, sf_dir), "cover", UNSET)
    return bins.select("locus", F.col("frame6").cast("long").alias("frame6"), "bin", F.round(F.element_at("cum", -1) + OFF, 4).alias("coverage"), F.round(F.element_at("reads", -1), 6).alias("reads"))


def log_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of log(coverage + 1) over exons: two lookups each."""
    bins = kept(tracks(segments(spark, sf_dir).withColumn("score", F.abs("score")), "cover", 0.0, logs=True), "tracks")
    e = exons(spark, sf_dir).withColumn("frame6", (F.col("id") % 6).cast("int"))
    out = with_sums(e, bins, {"total": (F.col("left_pos"), F.col("right_pos") + 1)})
    return out.select("id", F.round(F.col("total") + OFF, 4).alias("total"))


_SEG = f"s AS (SELECT l_suppkey % {LOCI} AS locus, l_linenumber % 6 AS frame6, 1 + (l_partkey * 37 + l_orderkey) % {PLACES} AS lo, 1 + (l_partkey * 37 + l_orderkey) % {PLACES} + l_quantity::BIGINT AS hi, l_orderkey % 200 - 20 AS score FROM lineitem), b AS (SELECT *, unnest(range(lo, hi + 1)) AS pos FROM s)"
_TYPE = "['First', 'Internal', 'Terminal', 'Single']"
_EXON = f"x AS (SELECT o_orderkey AS id, o_custkey % {LOCI} AS locus, ({_TYPE})[o_orderkey % 4 + 1] AS type, o_orderkey % {PLACES} AS a, o_orderkey % {PLACES} + o_orderkey % 173 AS z, (o_orderkey % {PLACES} + 1 + o_orderkey % 3) % 3 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 3 END AS frame6 FROM orders)"
_BEST = f"WITH {_SEG}, {_EXON}, m AS (SELECT locus, frame6, pos, max(score / (hi - lo + 1.0)::DOUBLE) AS v FROM b GROUP BY ALL)"
_GRID = f"c AS (SELECT locus, frame6, pos, sum(coalesce(v, {UNSET})) OVER (PARTITION BY locus, frame6 ORDER BY pos) AS s FROM (SELECT * FROM range({LOCI}) p(locus), range(6) f(frame6), range(1, {PLACES} + 400) g(pos)) LEFT JOIN m USING (locus, frame6, pos)), k AS (SELECT locus, frame6, 0 AS pos, 0.0 AS s FROM (SELECT DISTINCT locus, frame6 FROM c) UNION ALL FROM c)"
_AT = "LEFT JOIN k AS {0} ON {0}.locus = e.locus AND {0}.frame6 = e.frame6 AND {0}.pos = e.{1}"
_BACK = f"""{_BEST}, {_GRID}, e AS (SELECT *, a + 1 AS first, z + 1 AS last, greatest(0, a + 1 - {FLANK}) AS lo, greatest(least({PLACES + 99}, z + 1 + {FLANK}), z + 1) AS hi, type NOT IN ('First', 'Single') AS l, type NOT IN ('Terminal', 'Single') AND z + 1 < {PLACES + 100} AS r FROM x),
 t AS (SELECT e.*, k1.s - k0.s AS own, k2.s - kl.s AS ls, kh.s - k3.s AS rs FROM e {_AT.format('k0', 'a')} {_AT.format('k1', 'z')} {_AT.format('k2', 'first')} {_AT.format('kl', 'lo')} {_AT.format('k3', 'last')} {_AT.format('kh', 'hi')}),
 n AS (SELECT *, CASE WHEN l THEN first - lo ELSE 0 END + CASE WHEN r THEN hi - last ELSE 0 END AS n, CASE WHEN l THEN ls ELSE 0 END + CASE WHEN r THEN rs ELSE 0 END AS around FROM t)
 SELECT id, round(own + {OFF}, 4) AS similarity, round(own - CASE WHEN n > 0 THEN around / n * (last - first + 1) ELSE 0 END + {OFF}, 4) AS over_background FROM n"""
_COVER = f"WITH {_SEG}, v AS (SELECT locus, frame6, pos, list_reduce(list(score / 15.0::DOUBLE ORDER BY lo, hi, score), lambda p, q: least(p + q, 15.0)) AS v, sum(score) AS reads FROM b GROUP BY ALL)"

ORACLES = {
    "homology_sum": _BACK,
    "coverage_fold": f"{_COVER} SELECT locus::VARCHAR AS locus, frame6::BIGINT AS frame6, (pos - 1) // {BIN} AS bin, round(sum(v) + ({BIN} - count(*)) * {UNSET} + {OFF}, 4) AS coverage, round(sum(reads), 6)::DOUBLE AS reads FROM v GROUP BY ALL",
    "log_coverage": _COVER.replace("l_orderkey % 200 - 20 AS score", "abs(l_orderkey % 200 - 20) AS score") + f", {_EXON}, w AS (SELECT id, locus, id % 6 AS frame6, unnest(range(a + 1, z + 2)) AS pos FROM x) SELECT id, round(sum(coalesce(ln(v + 1), 0)) + 1e-6, 4) AS total FROM w LEFT JOIN v USING (locus, frame6, pos) GROUP BY id",
}
QUERIES = {name: globals()[name] for name in ORACLES}
