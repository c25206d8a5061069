"""Ends of transcripts from coverage (order lines as reads), and untranslated exons between motifs of documents' letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.dna import STOPS
from codonlake.operators import utr as U
from codonlake.operators.lists import Sites, group_of, motif_lists
from codonlake.operators.tracks import CAP, PER_READ, tracks
from codonlake.plans.signals import _BASE, sequences
from codonlake.sources.scratch import kept

LOCI, PLACES = 400, 3000
LENGTH = PLACES + 100


def edge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where transcripts may begin and end, with the change of coverage's slope, but for those near a strong splice site."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lo = (1 + (F.col("l_partkey") * 37 + F.col("l_orderkey")) % PLACES).cast("long")
    reads = line.select((F.col("l_orderkey") % LOCI).cast("string").alias("locus"), (F.col("l_linenumber") % 2 * 3).cast("int").alias("frame6"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi"), (F.col("l_suppkey") % 90 + 10).cast("double").alias("score"))
    bins = kept(tracks(reads, "cover", logs=True), "tracks")
    k = F.col("o_orderkey")
    sites = spark.read.parquet(f"{sf_dir}/orders.parquet").select((k % LOCI).cast("string").alias("locus"), F.when(F.floor(k / 3) % 2 == 0, "+").otherwise("-").alias("strand"), F.when(F.floor(k / 5) % 2 == 0, "acceptor").otherwise("donor").alias("kind"), (k * 7 % PLACES).alias("pos"), (k % 10).cast("double").alias("score"))
    lengths = reads.select("locus").distinct().withColumn("length", F.lit(LENGTH).cast("long"))
    found = U.termini(bins, lengths, sites)
    return found.select(F.col("locus").cast("long").alias("locus"), "strand", "kind", "pos", F.round("score", 4).alias("score"))


#: Motifs that stand for sites, and how far a stop's place is before its codon.
MOTIFS = {"tss": ("TATAA",), "tes": ("AATAA",), "acceptor": ("CAGG", "TAGG"), "donor": ("GTAAG", "GTGAG"), "start": ("ATGG",), "stop": STOPS[:1]}


def utr_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven types of untranslated exons over whole texts: the best right sites of each left one. A text's sites meet in the task that reads
    it, so nothing is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, base, found in motif_lists(batches, MOTIFS, U.REACH):
            sites = {}
            for kind, at in found.items():
                doc = group_of(base, at)
                sites[kind] = Sites(at, np.fmod((at - base[doc]) * 7919 + ids[doc] * 31, 10), np.zeros(len(at), np.int32))
            for name, x, y in U.paired(sites, sites):
                doc = group_of(base, x.at)
                yield pa.record_batch([pa.array(ids[doc]), pa.repeat(name, len(doc)), *[pa.array(c) for c in (x.at - base[doc], y.at - base[doc], x.score, y.score)]], ["doc_id", "type", "left_pos", "right_pos", "left_score", "right_score"])

    return sequences(spark, sf_dir).where("doc_id is not null").mapInArrow(run, "doc_id long, type string, left_pos long, right_pos long, left_score long, right_score long")


_E = f"""WITH b AS (SELECT l_orderkey % {LOCI} AS locus, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, 1 + (l_partkey * 37 + l_orderkey) % {PLACES} AS lo, l_quantity::BIGINT AS n, l_suppkey % 90 + 10 AS score FROM lineitem),
 c AS (SELECT locus, strand, lo, lo + n AS hi, score, unnest(range(lo, lo + n + 1)) AS q FROM b),
 v AS (SELECT locus, strand, q, ln(list_reduce(list(score / {PER_READ}::DOUBLE ORDER BY lo, hi, score), lambda x, y: least(x + y, {CAP})) + 1) AS v FROM c GROUP BY ALL),
 g AS (SELECT locus, strand, q, coalesce(v, 0) AS v FROM (SELECT * FROM (SELECT DISTINCT locus FROM b), (VALUES ('+'), ('-')) s(strand), range(1, {LENGTH} + 8) r(q)) LEFT JOIN v USING (locus, strand, q)),
 p AS (SELECT *, CASE WHEN q - {U.SIDE} >= 0 AND q - 1 + {U.SIDE} < {LENGTH} - 1 THEN {U.FACTOR} * (coalesce(sum(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND {U.SIDE} FOLLOWING), 0) / {U.SIDE} - coalesce(sum(v) OVER (w ROWS BETWEEN {U.SIDE - 1} PRECEDING AND CURRENT ROW), 0) / {U.SIDE}) ELSE 0 END AS pes,
   lag(v, 1, 0) OVER w AS v0, lead(v, 1, 0) OVER w AS v2 FROM g WINDOW w AS (PARTITION BY locus, strand ORDER BY q)),
 e AS (SELECT locus, strand, q, kind, sign * pes AS e, lag(sign * pes, 1, 0) OVER w AS e1, lag(sign * pes, 2, 0) OVER w AS e2, least, CASE WHEN q - 2 >= 0 AND q < {LENGTH} - 1 AND v > 0 THEN CASE WHEN v2 = 0 THEN 'tes' WHEN v0 = 0 THEN 'tss' END END AS edge
   FROM p, (VALUES ('tss', 1, {U.RISE}), ('tes', -1, {U.FALL})) k(kind, sign, least) WINDOW w AS (PARTITION BY locus, strand, kind ORDER BY q)),
 s AS (SELECT o_orderkey % {LOCI} AS locus, CASE WHEN o_orderkey // 3 % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN o_orderkey // 5 % 2 = 0 THEN 'tss' ELSE 'tes' END AS kind, o_orderkey * 7 % {PLACES} AS pos FROM orders WHERE o_orderkey % 10 > {U.STRONG})
SELECT locus, strand, kind, q - 2 AS pos, round(e1, 4) AS score FROM e WHERE q BETWEEN 2 AND {LENGTH} AND (coalesce(edge = kind, false) OR (e1 > least AND e1 > e2 + 1e-9 AND e1 > e + 1e-9))
 AND NOT EXISTS (SELECT 1 FROM s WHERE s.locus = e.locus AND s.strand = e.strand AND s.kind = e.kind AND s.pos >= e.q - 2 - {U.NEAR} AND s.pos < e.q - 2 + {U.NEAR})"""
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, pos FROM words WHERE starts_with(word, '{w}')" for k, ws in MOTIFS.items() for w in ws)
_KINDS = ", ".join(f"('{t}', '{a}', '{b}', {n})" for t, a, b, n in U.KINDS)
_UTR = f"""{_BASE}, words AS (SELECT doc_id, pos, base || {' || '.join(f"coalesce(lead(base, {i}) OVER w, '')" for i in range(1, 5))} AS word FROM bases WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 t AS (SELECT doc_id, kind, pos, (pos * 7919 + doc_id * 31) % 10 AS score FROM ({_HITS}))
SELECT x.doc_id, type, x.pos AS left_pos, y.pos AS right_pos, x.score AS left_score, y.score AS right_score FROM t x JOIN (VALUES {_KINDS}) k(type, a, b, most) ON x.kind = a JOIN t y ON y.doc_id = x.doc_id AND y.kind = b AND y.pos > x.pos AND y.pos < x.pos + most
QUALIFY row_number() OVER (PARTITION BY x.doc_id, type, x.pos ORDER BY y.score::DOUBLE - {U.PER_BASE}::DOUBLE * (y.pos - x.pos + 1)::DOUBLE DESC, y.pos) <= {U.MOST}"""

ORACLES = {"edge_sites": _E, "utr_exons": f"WITH {_UTR}"}
QUERIES = {name: globals()[name] for name in ORACLES}
