"""Queries that go through files: tables are written in the formats of sequence tools and read back by the readers.

And exons built by the engine's own joins. Each query has the same rows as its SQL in ORACLES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.dna import STOPS
from codonlake.operators import exons as X
from codonlake.operators.lists import Sites, group_of, motif_lists
from codonlake.operators.signals import fragments, scan
from codonlake.plans.signals import _BASE, _SEQ, CUTOFF, FRAGMENT, OVERLAP, WEIGHTS, sequences
from codonlake.sources import formats
from codonlake.sources.chromosomes import read_fragments
from codonlake.sources.params import Profile
from codonlake.sources.scratch import scratch_path


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all documents written as FASTA, lines of 60, and scanned again."""
    path = scratch_path(spark, "fasta")
    formats.write_fasta(sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("locus"), "seq"), path)
    return formats.read_fasta(spark, path).select("locus", "length", F.md5(F.col("seq").cast("binary")).alias("digest"))


def fasta_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file read as overlapping fragments, no sequence held whole: ends and bases of each."""
    path = scratch_path(spark, "fasta")
    formats.write_fasta(sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("locus"), "seq"), path)
    found = read_fragments(spark, path, FRAGMENT, OVERLAP, "+")
    return found.select(F.col("locus").cast("long").alias("doc_id"), F.col("frag").alias("fragment"), "l1", "l2", F.md5(F.col("seq").cast("binary")).alias("digest"))


def _written(lines: DataFrame, name: str) -> str:
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _tabs(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def evidence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as annotations: an unknown score is forced, an unknown frame three rows, an intron also two UTR kinds; other kinds go."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, day = F.col("o_orderkey"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    kind = F.when(F.col("o_orderstatus") == "F", "Internal").when(F.col("o_orderstatus") == "O", "Intron").otherwise("Other")
    score = F.when(key % 5 == 0, ".").otherwise((key % 1000).cast("string"))
    frame = F.when(key % 4 == 0, ".").otherwise((key % 3).cast("string"))
    group = F.when(key % 6 == 0, ".").when(key % 6 == 1, F.concat(F.lit("g"), key.cast("string"))).otherwise(F.concat(F.lit("Parent=t"), key.cast("string"), F.lit(";donor=U12gtag;")))
    lines = o.select(_tabs("o_custkey", F.lit("orders"), kind, day, day + key % 50, score, F.when(key % 2 == 0, "+").otherwise("-"), frame, group).alias("value"))
    found = formats.read_evidence(spark, _written(lines, "evidence"), ["Internal", "Intron"], factor=2.0, weight=1.0)
    return found.select("locus", "feature", "start", F.col("end").alias("stop"), F.col("score").cast("double").alias("score"), "strand", F.col("frame").cast("long").alias("frame"), F.col("remainder").cast("long").alias("remainder"), F.col("group").alias("parent"), "donor", "acceptor")


def homology_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as similarity segments in no order: frames 1 to 3, or all; six frames with the strand."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    frame = F.when(n == 7, ".").otherwise((n % 3 + 1).cast("string"))
    lines = line.select(_tabs("l_orderkey", F.lit("x"), F.lit("sr"), "l_partkey", F.col("l_partkey") + F.col("l_quantity").cast("long"), F.col("l_quantity").cast("long"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), frame).alias("value"))
    found = formats.read_homology(spark, _written(lines, "homology"))
    return found.select("locus", "start", F.col("end").alias("stop"), F.col("score").cast("double").alias("score"), "strand", F.col("frame6").cast("long").alias("frame6"))


def bed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcripts in BED12, a block for each line: blocks are cut where the coding part begins and ends."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = F.col("l_quantity").cast("long")
    t = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("i"), size.alias("size")))).alias("b"))
    at = F.expr("transform(b, x -> 100 * (x.i - 1))")
    lo, hi = F.col("l_orderkey") * 10, F.col("l_orderkey") * 10 + F.expr("100 * (b[size(b) - 1].i - 1) + b[size(b) - 1].size")
    strand = F.when(F.col("l_orderkey") % 2 == 0, "-").otherwise("+")
    listed = lambda c: F.concat(F.array_join(c.cast("array<string>"), ","), F.lit(","))
    lines = t.select(_tabs(F.lit("c"), lo, hi, "l_orderkey", F.lit(0), strand, lo + 10, F.greatest(lo + 10, hi - 7), F.lit(0), F.size("b"), listed(F.expr("transform(b, x -> x.size)")), listed(at)).alias("value"))
    found = formats.read_bed12(spark, _written(lines, "bed"))
    return found.select("name", "strand", "feature", "start", F.col("end").alias("stop"))


def gff3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines written as GFF3 rows and read back as text."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey").cast("string")
    attrs = F.create_map(F.lit("ID"), F.concat_ws(".", key, F.col("l_linenumber").cast("string")), F.lit("Parent"), key)
    rows = line.select(
        F.concat(F.lit("chr"), key).alias("seqid"), F.when(F.col("l_linestatus") == "O", "codonlake").alias("source"), F.lit("CDS").alias("type"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 4).alias("score"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), (F.col("l_linenumber") % 3).cast("int").alias("phase"), attrs.alias("attributes"),
    )
    return spark.read.text(_written(formats.gff3_lines(rows), "gff3")).select(F.col("value").alias("row_text"))


def strand_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile sites of both strands, scanned in fragments: each site once, in places of its strand."""
    seqs = sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("locus"), F.length("seq").cast("long").alias("length"), "seq")
    frags = fragments(seqs, FRAGMENT, OVERLAP)
    found = scan(frags, {"site": Profile(6, 0, CUTOFF + 4, 0, weights=np.array(WEIGHTS, np.float32))}, once=OVERLAP)
    return found.select(F.col("locus").cast("long").alias("doc_id"), "strand", "pos", F.col("score").cast("long").alias("score"))


MOST_DONORS = 4


def exons_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, internal, terminal and single exons by the engine's as-of, range and top-k searches over sites of whole sequences. A text's sites
    meet in the task that reads it, so nothing is dealt."""
    motifs = {"start": ("ATG",), "stop": STOPS, "acceptor": tuple("AG" + b for b in "ACGTN"), "donor": tuple("GTA" + b for b in "ACGTN")}
    names = ["doc_id", "kind", "left_pos", "right_pos", "frame", "rest", "left_score", "right_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, base, found in motif_lists(batches, motifs, 6):
            sites = {}
            for kind, at in found.items():
                doc = group_of(base, at)
                score = np.fmod((at - base[doc]) * 7919 + ids[doc] * 31, 1000)
                if kind == "stop":  # a stop's place is that of the last coding base
                    inside = at > base[doc]
                    at, score = at[inside] - 1, score[inside]
                sites[kind] = Sites(at, score, np.zeros(len(at), np.int32))
            for kind, left, right, frame, rest, left_score, right_score, *_ in X.joined(sites, base, MOST_DONORS):
                doc = group_of(base, left)
                yield pa.record_batch([pa.array(ids[doc], pa.int64()), pa.repeat(kind, len(doc)), *[pa.array(c, pa.int64()) for c in (left - base[doc], right - base[doc], frame, rest, left_score, right_score)]], names)

    return sequences(spark, sf_dir).mapInArrow(run, ", ".join(f"{c} {'string' if c == 'kind' else 'long'}" for c in names))


_D = "CAST(o_orderdate::DATE - DATE '1970-01-01' AS BIGINT)"
_SUM = " + ".join("CASE b{i} WHEN 'A' THEN {0} WHEN 'C' THEN {1} WHEN 'G' THEN {2} WHEN 'T' THEN {3} ELSE {4} END".format(*row, i=i) for i, row in enumerate(WEIGHTS))
_W4 = _BASE + ", words AS (SELECT doc_id, pos, base || lead(base, 1) OVER w || lead(base, 2) OVER w AS word, lead(base, 3) OVER w AS fourth FROM bases WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
_BUILT = _W4 + """, t AS (SELECT doc_id, CASE WHEN kind = 'stop' THEN pos - 1 ELSE pos END AS pos, kind, (pos * 7919 + doc_id * 31) % 1000 AS score FROM (
  SELECT doc_id, pos, 'start' AS kind FROM words WHERE word = 'ATG' UNION ALL SELECT doc_id, pos, 'stop' FROM words WHERE word IN ('TAA', 'TAG', 'TGA') AND pos > 0
  UNION ALL SELECT doc_id, pos, 'acceptor' FROM words WHERE word[1:2] = 'AG' AND length(word) = 3 UNION ALL SELECT doc_id, pos, 'donor' FROM words WHERE word = 'GTA' AND fourth IS NOT NULL)),
 far AS (SELECT doc_id, max(pos) + 1 AS far FROM t GROUP BY doc_id),
 u AS (SELECT doc_id, kind, pos, score, 0 AS f, pos AS spot, pos % 3 AS phase, NULL AS mark FROM t WHERE kind = 'start'
  UNION ALL SELECT doc_id, kind, pos, score, f, pos, (pos + f) % 3, NULL FROM t, (VALUES (0), (1), (2)) v(f) WHERE kind = 'acceptor'
  UNION ALL SELECT doc_id, kind, pos, score, NULL, pos + 1, (pos + 1) % 3, pos FROM t WHERE kind = 'stop'),
 c AS (SELECT *, min(mark) OVER (PARTITION BY doc_id, phase ORDER BY spot RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM u),
 s AS (SELECT c.doc_id, c.kind, c.pos, c.score, c.f, c.stop, t.score AS stop_score FROM c LEFT JOIN t ON t.doc_id = c.doc_id AND t.kind = 'stop' AND t.pos = c.stop WHERE c.kind <> 'stop'),
 d AS (SELECT doc_id, pos, score FROM t WHERE kind = 'donor'),
 first AS (SELECT s.doc_id, 'First' AS kind, s.pos AS left_pos, d.pos AS right_pos, 0 AS frame, s.score AS left_score, d.score AS right_score, row_number() OVER (PARTITION BY s.doc_id, s.pos ORDER BY d.score DESC, d.pos) AS k
  FROM s JOIN far USING (doc_id) JOIN d ON d.doc_id = s.doc_id AND d.pos >= s.pos + 2 AND d.pos < coalesce(s.stop + 3, far) WHERE s.kind = 'start'),
 three AS (SELECT doc_id, pos, max(score) AS score, max(coalesce(stop + 3, 1099511627776)) AS hi FROM s WHERE kind = 'acceptor' GROUP BY doc_id, pos),
 inner_top AS (SELECT * FROM (SELECT h.doc_id, h.pos AS left_pos, d.pos AS right_pos, h.score AS left_score, d.score AS right_score, row_number() OVER (PARTITION BY h.doc_id, h.pos ORDER BY d.score DESC, d.pos DESC) AS k
  FROM three h JOIN far USING (doc_id) JOIN d ON d.doc_id = h.doc_id AND d.pos >= h.pos + 18 AND d.pos < least(h.hi, far)) WHERE k <= {k}),
 e AS (SELECT doc_id, kind, left_pos, right_pos, frame, (3 - (right_pos - left_pos + 1) % 3) % 3 AS rest, left_score, right_score FROM first WHERE k <= {k}
  UNION ALL SELECT i.doc_id, 'Internal', left_pos, right_pos, s.f, (3 - (right_pos - (left_pos + s.f) + 1) % 3) % 3, left_score, right_score FROM inner_top i JOIN s ON s.doc_id = i.doc_id AND s.kind = 'acceptor' AND s.pos = i.left_pos WHERE right_pos < coalesce(s.stop + 3, 1099511627776)
  UNION ALL SELECT doc_id, 'Terminal', pos, stop, f, 0, score, stop_score FROM s WHERE kind = 'acceptor' AND stop >= pos
  UNION ALL SELECT doc_id, 'Single', pos, stop, 0, 0, score, stop_score FROM s WHERE kind = 'start' AND stop + 4 - pos >= 60)""".replace("{k}", str(MOST_DONORS))

ORACLES = {
    "fasta_round_trip": f"WITH {_SEQ} SELECT CAST(doc_id AS VARCHAR) AS locus, length(seq) AS length, md5(seq) AS digest FROM seqs",
    "fasta_fragments": f"WITH {_SEQ}, q AS (SELECT doc_id, seq, unnest(range(greatest(0, (length(seq) - 1 - {OVERLAP}) // {FRAGMENT - OVERLAP}) + 1)) AS fragment FROM seqs WHERE seq <> '') SELECT doc_id, fragment, fragment * {FRAGMENT - OVERLAP} AS l1, least(fragment * {FRAGMENT - OVERLAP} + {FRAGMENT}, length(seq)) - 1 AS l2, md5(substr(seq, fragment * {FRAGMENT - OVERLAP} + 1, {FRAGMENT})) AS digest FROM q",
    "evidence_scan": f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS locus, o_orderstatus AS s, {_D} AS start FROM orders WHERE o_orderstatus IN ('F', 'O')),
 f AS (SELECT *, unnest(CASE WHEN s = 'F' THEN ['Internal'] ELSE ['Intron', 'UTR_5prime_Intron', 'UTR_3prime_Intron'] END) AS feature FROM o), g AS (SELECT *, unnest(CASE WHEN k % 4 = 0 THEN [0, 1, 2] ELSE [k % 3] END) AS fr FROM f)
 SELECT locus, feature, start, start + k % 50 AS stop, CASE WHEN k % 5 = 0 THEN 10000.0 ELSE 2.0 * (k % 1000) + 1 END::DOUBLE AS score, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand,
 CASE WHEN feature LIKE 'UTR%' THEN (3 - fr) % 3 ELSE fr END AS frame, CASE WHEN feature LIKE 'UTR%' THEN fr END AS remainder,
 CASE WHEN k % 6 = 0 THEN 'NON_GROUPED' WHEN k % 6 = 1 THEN 'g' || k ELSE 't' || k END AS parent, CASE WHEN k % 6 > 1 THEN 'U12gtag' ELSE 'U2' END AS donor, 'U2' AS acceptor FROM g""",
    "homology_scan": "WITH f AS (SELECT *, unnest(CASE WHEN l_linenumber = 7 THEN [0, 1, 2] ELSE [l_linenumber % 3 + 1] END) AS fr FROM lineitem) SELECT CAST(l_orderkey AS VARCHAR) AS locus, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS stop, floor(l_quantity)::DOUBLE AS score, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(fr % 3 + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END AS BIGINT) AS frame6 FROM f",
    "bed_scan": """WITH b AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS i, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
 x AS (SELECT k, r, k * 10 + 100 * (i - 1) AS lo, k * 10 + 100 * (i - 1) + size AS hi, k * 10 + 10 AS a, max(CASE WHEN r = n THEN k * 10 + 100 * (i - 1) + size END) OVER (PARTITION BY k) AS last FROM b),
 y AS (SELECT k, r, lo, hi, a, greatest(a, last - 7) AS z, CASE WHEN k % 2 = 0 THEN '-' ELSE '+' END AS strand FROM x),
 p AS (SELECT k, strand, CASE WHEN strand = '-' THEN '3utr' ELSE '5utr' END AS feature, lo AS start, least(hi, a) AS stop FROM y UNION ALL SELECT k, strand, 'cds', greatest(lo, a), least(hi, z) FROM y UNION ALL SELECT k, strand, CASE WHEN strand = '-' THEN '5utr' ELSE '3utr' END, greatest(lo, z), hi FROM y),
 n AS (SELECT k, strand, hi AS start, lead(lo) OVER (PARTITION BY k ORDER BY lo, hi) AS stop FROM y)
 SELECT CAST(k AS VARCHAR) AS name, strand, feature, start, stop FROM p WHERE start < stop UNION ALL SELECT CAST(k AS VARCHAR), strand, 'intron', start, stop FROM n WHERE stop IS NOT NULL""",
    "gff3_lines": "SELECT concat_ws(chr(9), 'chr' || l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'codonlake' ELSE '.' END, 'CDS', l_partkey, l_partkey + CAST(l_quantity AS BIGINT), CASE WHEN l_returnflag <> 'N' THEN printf('%.2f', l_quantity / 4) ELSE '.' END, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END, l_linenumber % 3, 'ID=' || l_orderkey || '.' || l_linenumber || ';Parent=' || l_orderkey) AS row_text FROM lineitem",
    "strand_scan": f"WITH {_SEQ}, strands AS (SELECT doc_id, '+' AS strand, seq FROM seqs UNION ALL SELECT doc_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs), l AS (SELECT doc_id, strand, unnest(string_split(seq, '')) AS b0, unnest(range(length(seq))) AS pos FROM strands WHERE seq <> ''), w AS (SELECT doc_id, strand, pos, b0, {', '.join(f'lead(b0, {i}) OVER v AS b{i}' for i in range(1, 6))} FROM l WINDOW v AS (PARTITION BY doc_id, strand ORDER BY pos)), z AS (SELECT doc_id, strand, pos, CAST({_SUM} AS BIGINT) AS score FROM w WHERE b5 IS NOT NULL) SELECT * FROM z WHERE score >= {CUTOFF + 4}",
    "exons_built": f"WITH {_BUILT} SELECT doc_id, kind, left_pos, right_pos, CAST(frame AS BIGINT) AS frame, CAST(rest AS BIGINT) AS rest, left_score, right_score FROM e",
}
QUERIES = {name: globals()[name] for name in ORACLES}
