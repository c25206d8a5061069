"""Acceptors with their branch points in the letters of documents, by the engine's own scan of fragments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators.signals import fragments, owned
from codonlake.operators.splice import BRANCH, scan_sites
from codonlake.plans.signals import _SEQ, FRAGMENT, OVERLAP, WEIGHTS, sequences
from codonlake.sources.params import Isochore, Profile

#: A made-up branch point profile for ACGTN, cutoffs of both, and its place: context, least and usual distance, penalty. The
#: context less offset and usual distance is a power of two, so sums are exact.
BRANCH_WEIGHTS = [[(5 * i + 3 * b + i * b) % 13 - 6 for b in range(4)] + [-2] for i in range(6)]
ACCEPTOR_OFFSET, BRANCH_OFFSET, CUTOFF, BRANCH_CUTOFF, PLACE = 2, 3, 18, 10, (40, 6, 5, 4)


def branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptors that pass both cutoffs, with the score and the place of their branch point."""
    seqs = sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("locus"), F.length("seq").cast("long").alias("length"), "seq")
    table = lambda w: np.array(w, np.float32)
    profiles = {"Acceptor_profile": Profile(6, ACCEPTOR_OFFSET, CUTOFF, 0, weights=table(WEIGHTS)), BRANCH: Profile(6, BRANCH_OFFSET, BRANCH_CUTOFF, 0, extra=PLACE, weights=table(BRANCH_WEIGHTS))}
    frags = fragments(seqs, FRAGMENT, OVERLAP, "+")
    found = owned(scan_sites(frags, [Isochore(0, 100, {}, profiles)], edge=False), frags, OVERLAP)
    return found.select(F.col("locus").cast("long").alias("doc_id"), "pos", F.col("score").cast("double").alias("score"), F.col("bp").cast("double").alias("bp"), F.col("bp_at").cast("long").alias("bp_at"))


def _sum(weights) -> str:
    return " + ".join("CASE b{i} WHEN 'A' THEN {0} WHEN 'C' THEN {1} WHEN 'G' THEN {2} WHEN 'T' THEN {3} ELSE {4} END".format(*row, i=i) for i, row in enumerate(weights))


_CONTEXT, _LEAST, _USUAL, _PENALTY = PLACE
_SPAN = _CONTEXT - BRANCH_OFFSET - _USUAL
_BRANCH = f"""WITH {_SEQ}, l AS (SELECT doc_id, length(seq) AS n, unnest(string_split(seq, '')) AS b0, unnest(range(length(seq))) AS i FROM seqs WHERE seq <> ''),
 w AS (SELECT doc_id, n, i, {_sum(WEIGHTS)} AS raw, {_sum(BRANCH_WEIGHTS)} AS branch FROM (SELECT doc_id, n, i, b0, {', '.join(f'lead(b0, {j}) OVER v AS b{j}' for j in range(1, 6))} FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY i)) WHERE b5 IS NOT NULL),
 a AS (SELECT doc_id, n, i + {ACCEPTOR_OFFSET} AS pos, raw FROM w WHERE raw >= {CUTOFF}),
 c AS (SELECT *, unnest(range(greatest(0, pos - {_CONTEXT}), least(pos - {_LEAST} + 6 - {BRANCH_OFFSET}, n - 1, pos) - 6 + 1)) AS i FROM a),
 s AS (SELECT c.doc_id, c.pos, c.raw, c.i, w.branch - {_PENALTY} * pow(abs(c.i + {BRANCH_OFFSET} - greatest(0, c.pos - {_USUAL})) / {_SPAN}.0, 2)::DOUBLE AS bp FROM c JOIN w ON w.doc_id = c.doc_id AND w.i = c.i),
 b AS (SELECT * FROM s WHERE bp > {BRANCH_CUTOFF} QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY bp DESC, i DESC) = 1)
 SELECT doc_id, pos, (raw + bp)::DOUBLE AS score, bp::DOUBLE AS bp, i + {BRANCH_OFFSET} - pos AS bp_at FROM b WHERE raw + bp >= {CUTOFF}"""

ORACLES = {"branch_points": _BRANCH}
QUERIES = {name: globals()[name] for name in ORACLES}
