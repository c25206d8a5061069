"""Sequence queries: letters of documents read as DNA, and everything a gene finder asks of it.

Each query has the same rows as its SQL in ORACLES. Texts are taken whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.functions.dna import AS_BASES, CODONS, LETTERS, STOPS, amino_acids, oligo_index, pseudo_dna, remainder, reverse_complement, split_codon_left, split_codon_right, split_words, words_of_bases
from codonlake.operators import ranges as R
from codonlake.operators.signals import fragments, motif_sites, running_digests, running_tracks, scan
from codonlake.sources.params import Profile

#: A made-up weight matrix of six positions for ACGTN, in eighths, so that sums are exact.
WEIGHTS = [[(3 * i + 5 * b + i * b) % 17 - 8 for b in range(4)] + [-2] for i in range(6)]
CUTOFF = 22
#: G+C ranges in percent; the first that holds a value wins.
ISOCHORES = [(1, 0, 45), (2, 45, 50), (3, 50, 100)]
FRAGMENT, OVERLAP = 2000, 200


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", pseudo_dna(F.col("text")).alias("seq"))


_SEQ = f"seqs AS (SELECT doc_id, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{LETTERS}', '{AS_BASES}') AS seq FROM documents)"
_BASE = f"{_SEQ}, bases AS (SELECT doc_id, unnest(string_split(seq, '')) AS base, unnest(range(length(seq))) AS pos FROM seqs WHERE seq <> '')"
_W3 = _BASE + ", words AS (SELECT * FROM (SELECT doc_id, pos, base || lead(base, 1) OVER w || lead(base, 2) OVER w AS word FROM bases WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE word IS NOT NULL)"
_STOP = "('TAA', 'TAG', 'TGA')"


def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir)
    return s.select("doc_id", F.length("seq").cast("long").alias("length"), F.md5(reverse_complement(F.col("seq")).cast("binary")).alias("digest"))


def oligo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = split_words(sequences(spark, sf_dir), 5).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", oligo_index(F.col("word"), 5).alias("idx"), "n")


def translate_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir).withColumn("words", words_of_bases("seq", 3))
    s = s.select("doc_id", F.filter("words", lambda w, i: i % 3 == 0).alias("codons"))
    protein = s.select("doc_id", amino_acids("seq", F.col("codons")).alias("protein"))
    return protein.select("doc_id", F.length("protein").cast("long").alias("n_aa"), F.md5(F.col("protein").cast("binary")).alias("digest"))


def pwm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six whose summed weights reach the cutoff, by the engine's own scan (whole numbers, so sums are exact)."""
    seqs = sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("locus"), F.length("seq").cast("long").alias("length"), "seq")
    profile = Profile(6, 0, CUTOFF, 0, weights=np.array(WEIGHTS, np.float32))
    found = scan(fragments(seqs, FRAGMENT, OVERLAP, "+"), {"site": profile}, once=OVERLAP)
    return found.select(F.col("locus").cast("long").alias("doc_id"), "pos", F.col("score").cast("long").alias("score"))


def gc_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running G+C at every base, as a digest of the whole track."""
    return running_digests(sequences(spark, sf_dir), [0, 1, 1, 0, 0])


def gc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G+C and known bases within 200 on either side of every base, as a digest of the whole track: two lookups in running sums."""
    t = running_tracks(sequences(spark, sf_dir), {"gc": [0, 1, 1, 0, 0], "known": [1, 1, 1, 1, 0]}).where("size(gc) > 0")
    between = lambda x: f"({x}[least(i + 200, size({x}) - 1)] - if(i > 200, {x}[greatest(i - 201, 0)], 0L))"
    text = F.expr(f"transform(sequence(0, size(gc) - 1), i -> concat({between('gc')}, '/', {between('known')}))")
    return t.select("doc_id", F.md5(F.array_join(text, ",").cast("binary")).alias("digest"))


def isochore_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence's parameter set by its G+C percentage; both bounds are inside, the first set wins."""
    s = sequences(spark, sf_dir).where("seq <> ''")
    gc = 100 * F.length(F.regexp_replace("seq", "[^GC]", "")) / F.length("seq").cast("double")
    which = F.coalesce(*[F.when((gc >= lo) & (gc <= hi), F.lit(i)) for i, lo, hi in ISOCHORES])
    return s.select("doc_id", F.round(gc, 6).alias("gc"), which.cast("long").alias("isochore"))


def stop_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each start codon's first stop codon in its frame (null without one)."""
    c = motif_sites(sequences(spark, sf_dir), {"start": ("ATG",), "stop": STOPS}).withColumn("frame", F.col("pos") % 3)
    out = R.next_at_or_after(c, ["doc_id", "frame"], "pos", F.col("kind") == "stop", "stop")
    return out.where("kind = 'start'").select("doc_id", F.col("pos").alias("start"), "frame", "stop")


def single_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start to stop in frame, 60 bases at least."""
    out = stop_in_frame(spark, sf_dir).where("stop - start >= 60")
    return out.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("length"))


def orf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reading frames between neighbouring stops of a frame, 60 bases at least."""
    c = motif_sites(sequences(spark, sf_dir), {"stop": STOPS}).withColumn("frame", F.col("pos") % 3)
    w = W.partitionBy("doc_id", "frame").orderBy("pos")
    return c.withColumn("stop", F.lead("pos").over(w)).where("stop - pos - 3 >= 60").select("doc_id", "frame", (F.col("pos") + 3).alias("start"), "stop")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, acceptors (AG), donors (GT) and stops, each with a score from its place. A site's codon is whole."""
    seqs = sequences(spark, sf_dir)
    two = {"acceptor": "AG", "donor": "GT"}
    motifs = {"start": ("ATG",), "stop": STOPS} | {kind: tuple(w + b for b in "ACGTN") for kind, w in two.items()}
    return motif_sites(seqs, motifs).withColumn("score", F.pmod(F.col("pos") * 7919 + F.col("doc_id") * 31, F.lit(1000)))


def first_exons_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start with the donors before its frame's stop: the five of best score, earlier ones first on a tie."""
    s = _sites(spark, sf_dir).where("kind in ('start', 'stop', 'donor')")
    starts = R.next_at_or_after(s.where("kind != 'donor'").withColumn("frame", F.col("pos") % 3), ["doc_id", "frame"], "pos", F.col("kind") == "stop", "stop").where("kind = 'start' and stop is not null")
    left = starts.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 2).alias("lo"), (F.col("stop") + 3).alias("hi"))
    right = s.where("kind = 'donor'").select("doc_id", F.col("pos").alias("donor"), "score")
    met = R.range_join(left, right, ["doc_id"], "lo", "hi", "donor", 128)
    return R.top_k(met, ["doc_id", "start"], [F.desc("score"), F.asc("donor")], 5).select("doc_id", "start", "donor", "score")


def internal_exons_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acceptor with donors 18 bases on at least, in each frame that no stop has closed; the three of best score, later ones first on a tie."""
    s = _sites(spark, sf_dir)
    acc = s.where("kind = 'acceptor'").select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).cast("long").alias("frame"), F.col("pos").alias("acceptor"), (F.col("pos") + f).alias("at")) for f in range(3)])).alias("a")).select("doc_id", "a.*")
    stops = s.where("kind = 'stop'").select("doc_id", F.lit(None).cast("long").alias("frame"), F.lit(None).cast("long").alias("acceptor"), F.col("pos").alias("at"))
    both = acc.union(stops).withColumn("phase", F.col("at") % 3)
    closed = R.next_at_or_after(both, ["doc_id", "phase"], "at", F.col("acceptor").isNull(), "stop").where("acceptor is not null and stop is not null")
    left = closed.select("doc_id", "acceptor", "frame", (F.col("acceptor") + 18).alias("lo"), F.col("stop").alias("hi"))
    right = s.where("kind = 'donor'").select("doc_id", F.col("pos").alias("donor"), "score")
    met = R.range_join(left, right, ["doc_id"], "lo", "hi", "donor", 128)
    best = R.top_k(met, ["doc_id", "acceptor", "frame"], [F.desc("score"), F.desc("donor")], 3)
    return best.select("doc_id", "acceptor", "frame", "donor", "score", remainder(F.col("acceptor"), F.col("donor"), F.col("frame")).alias("rest"))


def terminal_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acceptor with the first stop of each frame: three rows at most."""
    s = _sites(spark, sf_dir)
    acc = s.where("kind = 'acceptor'").select("doc_id", "pos", F.explode(F.array(*[F.lit(f).cast("long") for f in range(3)])).alias("frame"))
    both = acc.select("doc_id", "frame", F.col("pos").alias("acceptor"), (F.col("pos") + F.col("frame")).alias("at")).union(s.where("kind = 'stop'").select("doc_id", F.lit(None).cast("long"), F.lit(None).cast("long"), "pos")).withColumn("phase", F.col("at") % 3)
    out = R.next_at_or_after(both, ["doc_id", "phase"], "at", F.col("acceptor").isNull(), "stop")
    return out.where("acceptor is not null and stop is not null").select("doc_id", "acceptor", "frame", "stop")


def zero_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A donor right behind an acceptor (an exon of no length), both of good score: the site's next neighbour is two on."""
    s = _sites(spark, sf_dir).where("kind in ('acceptor', 'donor') and score > 300")
    w = W.partitionBy("doc_id").orderBy("pos", "kind")
    s = s.withColumn("on", F.collect_list(F.when(F.col("kind") == "donor", F.struct("pos", "score"))).over(w.rowsBetween(1, 2)))
    met = s.where("kind = 'acceptor'").withColumn("d", F.get(F.filter("on", lambda x: x["pos"] == F.col("pos") + 2), F.lit(0))).where("d is not null")
    return met.select("doc_id", F.col("pos").alias("acceptor"), F.col("score").alias("acc_score"), F.col("d.score").alias("don_score"))


def utr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop with the acceptors up to 300 bases on: the four best by score less two for each base."""
    s = _sites(spark, sf_dir)
    left = s.where("kind = 'stop'").select("doc_id", F.col("pos").alias("stop"), (F.col("pos") + 1).alias("lo"), (F.col("pos") + 300).alias("hi"))
    right = s.where("kind = 'acceptor'").select("doc_id", F.col("pos").alias("acceptor"), "score")
    met = R.range_join(left, right, ["doc_id"], "lo", "hi", "acceptor", 512).withColumn("worth", F.col("score") - 2 * (F.col("acceptor") - F.col("stop")))
    return R.top_k(met, ["doc_id", "stop"], [F.desc("worth"), F.asc("acceptor")], 4).select("doc_id", "stop", "acceptor", "worth")


def split_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each pair of codon halves would make a stop at a junction: words of three are counted by place in the
    codon before anything is shuffled."""
    c = split_words(sequences(spark, sf_dir), 3).withColumn("frame", F.col("pos") % 3)
    n = c.groupBy("frame", "word").agg(F.count("*").alias("n"))
    return n.groupBy(split_codon_left(F.col("frame"), F.col("word")).cast("long").alias("left_value"), split_codon_right(F.col("frame"), F.col("word")).cast("long").alias("right_value")).agg(F.sum("n").alias("n"))


def markov_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding potential of every open reading frame: the sum of codon weights by two lookups in a running sum."""
    seqs = sequences(spark, sf_dir)
    track = running_tracks(seqs, {"total": [i * 37 % 19 - 9 for i in range(125)]}, step=3)
    orfs = orf_scan(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("frame", "start", "stop")).alias("orfs"))
    each = orfs.join(track, "doc_id").select("doc_id", F.expr("inline(transform(orfs, o -> struct(o.frame as frame, o.start as start, o.stop as stop, total[int(o.stop) - 3] - total[int(o.start) - 3] as potential)))"))
    return each.select("doc_id", "frame", "start", "stop", "potential")


def fragment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping fragments of each sequence, and the start codons that each owns."""
    s = sequences(spark, sf_dir).where("length(seq) > 0").select("doc_id", F.length("seq").cast("long").alias("size"))
    hop = FRAGMENT - OVERLAP
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1 - OVERLAP) / hop)).cast("long")
    parts = s.select("doc_id", "size", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fragment"))
    parts = parts.select("doc_id", "fragment", (F.col("fragment") * hop).alias("l1"), F.least(F.col("fragment") * hop + FRAGMENT - 1, F.col("size") - 1).alias("l2"), (F.col("fragment") == F.col("last")).alias("is_last"))
    starts = motif_sites(sequences(spark, sf_dir), {"start": ("ATG",)}).select("doc_id", "pos")
    owned = R.range_join(parts.withColumn("hi", F.when(F.col("is_last"), F.col("l2") + 1).otherwise(F.col("l1") + hop)), starts, ["doc_id"], "l1", "hi", "pos", 1024)
    n = owned.groupBy("doc_id", "fragment").agg(F.count("*").alias("starts"))
    return parts.join(n, ["doc_id", "fragment"], "left").select("doc_id", "fragment", "l1", "l2", "is_last", F.coalesce("starts", F.lit(0)).alias("starts"))


def region_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of a region by kind and strand side; the region is cut before anything is grouped."""
    s = _sites(spark, sf_dir).where("pos between 1000 and 4000")
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


_SITES = _W3 + f""", sites AS (
 SELECT doc_id, pos, kind, (pos * 7919 + doc_id * 31) % 1000 AS score FROM (
  SELECT doc_id, pos, 'start' AS kind FROM words WHERE word = 'ATG' UNION ALL SELECT doc_id, pos, 'stop' FROM words WHERE word IN {_STOP}
  UNION ALL SELECT doc_id, pos, 'acceptor' FROM words WHERE word[1:2] = 'AG' UNION ALL SELECT doc_id, pos, 'donor' FROM words WHERE word[1:2] = 'GT'))"""
_CASE = "CASE substr(word, {i}, 1) WHEN 'A' THEN {0} WHEN 'C' THEN {1} WHEN 'G' THEN {2} WHEN 'T' THEN {3} ELSE {4} END"
_W6 = ", w6 AS (SELECT * FROM (SELECT doc_id, pos, " + " || ".join(["base", *[f"lead(base, {i}) OVER w" for i in range(1, 6)]]) + " AS word FROM bases WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE word IS NOT NULL)"
_W5 = ", w5 AS (SELECT * FROM (SELECT doc_id, pos, " + " || ".join(["base", *[f"lead(base, {i}) OVER w" for i in range(1, 5)]]) + " AS word FROM bases WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE word IS NOT NULL)"
_SUM6 = " + ".join(_CASE.format(*row, i=i + 1) for i, row in enumerate(WEIGHTS))
_IDX5 = " + ".join(f"{5 ** (4 - i)} * " + _CASE.format(0, 1, 2, 3, 4, i=i + 1) for i in range(5))
_IDX3 = " + ".join(f"{5 ** (2 - i)} * " + _CASE.format(0, 1, 2, 3, 4, i=i + 1) for i in range(3))
_CODON = "CASE word " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in CODONS.items()) + " ELSE 'X' END"
_CLOSED = ", closed AS (SELECT *, min(CASE WHEN acceptor IS NULL THEN spot END) OVER (PARTITION BY doc_id, spot % 3 ORDER BY spot RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM (SELECT doc_id, f AS frame, pos AS acceptor, pos + f AS spot FROM sites, (VALUES (0), (1), (2)) v(f) WHERE kind = 'acceptor' UNION ALL SELECT doc_id, NULL, NULL, pos FROM sites WHERE kind = 'stop'))"

ORACLES = {
    "revcomp": f"WITH {_SEQ} SELECT doc_id, length(seq) AS length, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM seqs",
    "oligo_counts": f"WITH {_BASE}{_W5} SELECT word, CAST({_IDX5} AS BIGINT) AS idx, count(*) AS n FROM w5 GROUP BY word",
    "translate_codons": f"WITH {_W3}, p AS (SELECT doc_id, string_agg({_CODON}, '' ORDER BY pos) AS protein FROM words WHERE pos % 3 = 0 GROUP BY doc_id) SELECT doc_id, length(coalesce(protein, '')) AS n_aa, md5(coalesce(protein, '')) AS digest FROM seqs LEFT JOIN p USING (doc_id)",
    "pwm_scan": f"WITH {_BASE}{_W6} SELECT doc_id, pos, CAST({_SUM6} AS BIGINT) AS score FROM w6 WHERE {_SUM6} >= {CUTOFF}",
    "gc_prefix": f"WITH {_BASE}, t AS (SELECT doc_id, pos, CAST(sum(CASE WHEN base IN ('G', 'C') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gc FROM bases), g AS (SELECT doc_id, count(*) AS n, max(gc) AS total, md5(string_agg(gc::VARCHAR, ',' ORDER BY pos)) AS digest FROM t GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(digest, md5('')) AS digest FROM seqs LEFT JOIN g USING (doc_id)",
    "gc_context": f"WITH {_BASE}, t AS (SELECT doc_id, pos, CAST(sum(CASE WHEN base IN ('G', 'C') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS gc, CAST(sum(CASE WHEN base <> 'N' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n FROM bases WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 200 PRECEDING AND 200 FOLLOWING)) SELECT doc_id, md5(string_agg(gc || '/' || n, ',' ORDER BY pos)) AS digest FROM t GROUP BY doc_id",
    "isochore_assign": f"WITH {_SEQ}, g AS (SELECT doc_id, 100 * length(regexp_replace(seq, '[^GC]', '', 'g')) / CAST(length(seq) AS DOUBLE) AS gc FROM seqs WHERE seq <> ''), r AS (SELECT * FROM (VALUES {', '.join(map(str, ISOCHORES))}) v(i, lo, hi)) SELECT doc_id, round(gc, 6) AS gc, CAST(min(i) AS BIGINT) AS isochore FROM g LEFT JOIN r ON gc >= lo AND gc <= hi GROUP BY doc_id, gc",
    "stop_in_frame": f"WITH {_W3}, f AS (SELECT doc_id, pos, word, min(CASE WHEN word <> 'ATG' THEN pos END) OVER (PARTITION BY doc_id, pos % 3 ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM words WHERE word = 'ATG' OR word IN {_STOP}) SELECT doc_id, pos AS start, pos % 3 AS frame, stop FROM f WHERE word = 'ATG'",
    "single_genes": f"WITH {_W3}, f AS (SELECT doc_id, pos, word, min(CASE WHEN word <> 'ATG' THEN pos END) OVER (PARTITION BY doc_id, pos % 3 ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM words WHERE word = 'ATG' OR word IN {_STOP}) SELECT doc_id, pos AS start, stop, stop - pos AS length FROM f WHERE word = 'ATG' AND stop - pos >= 60",
    "orf_scan": f"WITH {_W3}, f AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id, pos % 3 ORDER BY pos) AS stop FROM words WHERE word IN {_STOP}) SELECT doc_id, pos % 3 AS frame, pos + 3 AS start, stop FROM f WHERE stop - pos - 3 >= 60",
    "first_exons_topk": f"WITH {_SITES}, f AS (SELECT doc_id, pos, kind, min(CASE WHEN kind = 'stop' THEN pos END) OVER (PARTITION BY doc_id, pos % 3 ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM sites WHERE kind IN ('start', 'stop')), m AS (SELECT f.doc_id, f.pos AS start, d.pos AS donor, d.score, row_number() OVER (PARTITION BY f.doc_id, f.pos ORDER BY d.score DESC, d.pos) AS k FROM f JOIN sites d ON d.doc_id = f.doc_id AND d.kind = 'donor' AND d.pos >= f.pos + 2 AND d.pos < f.stop + 3 WHERE f.kind = 'start' AND f.stop IS NOT NULL) SELECT doc_id, start, donor, score FROM m WHERE k <= 5",
    "internal_exons_topk": f"WITH {_SITES}{_CLOSED}, m AS (SELECT c.doc_id, c.acceptor, c.frame, d.pos AS donor, d.score, row_number() OVER (PARTITION BY c.doc_id, c.acceptor, c.frame ORDER BY d.score DESC, d.pos DESC) AS k FROM closed c JOIN sites d ON d.doc_id = c.doc_id AND d.kind = 'donor' AND d.pos >= c.acceptor + 18 AND d.pos < c.stop WHERE c.acceptor IS NOT NULL AND c.stop IS NOT NULL) SELECT doc_id, acceptor, CAST(frame AS BIGINT) AS frame, donor, score, CAST((3 - (donor - (acceptor + frame) + 1) % 3) % 3 AS BIGINT) AS rest FROM m WHERE k <= 3",
    "terminal_exons": f"WITH {_SITES}{_CLOSED} SELECT doc_id, acceptor, CAST(frame AS BIGINT) AS frame, stop FROM closed WHERE acceptor IS NOT NULL AND stop IS NOT NULL",
    "zero_length": f"WITH {_SITES}, z AS (SELECT doc_id, pos, kind, score, lead(CASE WHEN kind = 'donor' THEN pos END, 1) OVER w AS p1, lead(CASE WHEN kind = 'donor' THEN score END, 1) OVER w AS s1, lead(CASE WHEN kind = 'donor' THEN pos END, 2) OVER w AS p2, lead(CASE WHEN kind = 'donor' THEN score END, 2) OVER w AS s2 FROM sites WHERE kind IN ('acceptor', 'donor') AND score > 300 WINDOW w AS (PARTITION BY doc_id ORDER BY pos, kind)) SELECT doc_id, pos AS acceptor, score AS acc_score, CASE WHEN p1 = pos + 2 THEN s1 ELSE s2 END AS don_score FROM z WHERE kind = 'acceptor' AND (p1 = pos + 2 OR p2 = pos + 2)",
    "utr_topk": f"WITH {_SITES}, m AS (SELECT s.doc_id, s.pos AS stop, a.pos AS acceptor, a.score - 2 * (a.pos - s.pos) AS worth FROM sites s JOIN sites a ON a.doc_id = s.doc_id AND a.kind = 'acceptor' AND a.pos > s.pos AND a.pos < s.pos + 300 WHERE s.kind = 'stop') SELECT doc_id, stop, acceptor, worth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stop ORDER BY worth DESC, acceptor) AS k FROM m) WHERE k <= 4",
    "split_codons": f"WITH {_W3}, v AS (SELECT CASE WHEN pos % 3 = 1 AND word[1] = 'A' THEN 2 WHEN pos % 3 = 1 AND word[1] = 'G' THEN 3 WHEN pos % 3 = 2 AND word[1:2] IN ('AG', 'AA', 'GA') THEN 1 ELSE 0 END AS left_value, CASE WHEN pos % 3 = 2 AND word[3] = 'T' THEN 1 WHEN pos % 3 = 1 AND word[2:3] = 'TG' THEN 2 WHEN pos % 3 = 1 AND word[2:3] = 'TA' THEN 3 ELSE 0 END AS right_value FROM words) SELECT CAST(left_value AS BIGINT) AS left_value, CAST(right_value AS BIGINT) AS right_value, count(*) AS n FROM v GROUP BY ALL",
    "markov_prefix": f"WITH {_W3}, t AS (SELECT doc_id, pos, word, weight, sum(weight) OVER (PARTITION BY doc_id, pos % 3 ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, ({_IDX3}) * 37 % 19 - 9 AS weight FROM words)), s AS (SELECT *, lead(pos) OVER w AS stop, lead(total - weight) OVER w AS upto FROM t WHERE word IN {_STOP} WINDOW w AS (PARTITION BY doc_id, pos % 3 ORDER BY pos)) SELECT doc_id, pos % 3 AS frame, pos + 3 AS start, stop, CAST(upto - total AS BIGINT) AS potential FROM s WHERE stop - pos - 3 >= 60",
    "fragment_windows": f"WITH {_W3}, z AS (SELECT doc_id, length(seq) AS size, CASE WHEN length(seq) - 1 - {OVERLAP} < 0 THEN 0 ELSE (length(seq) - 1 - {OVERLAP}) // {FRAGMENT - OVERLAP} END AS last FROM seqs WHERE length(seq) > 0), p AS (SELECT doc_id, size, last, unnest(range(last + 1)) AS fragment FROM z), q AS (SELECT doc_id, fragment, fragment * {FRAGMENT - OVERLAP} AS l1, least(fragment * {FRAGMENT - OVERLAP} + {FRAGMENT - 1}, size - 1) AS l2, fragment = last AS is_last FROM p) SELECT q.doc_id, fragment, l1, l2, is_last, count(w.pos) AS starts FROM q LEFT JOIN words w ON w.doc_id = q.doc_id AND w.word = 'ATG' AND w.pos >= l1 AND w.pos < CASE WHEN is_last THEN l2 + 1 ELSE l1 + {FRAGMENT - OVERLAP} END GROUP BY ALL",
    "region_sites": f"WITH {_SITES} SELECT kind, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM sites WHERE pos BETWEEN 1000 AND 4000 GROUP BY kind",
}
QUERIES = {name: globals()[name] for name in ORACLES}
