"""Toxicity by maximum-scoring segments.

Every word of at least LEAST_DOCS labelled documents scores the log-odds of toxic against other
documents that hold it, under a Dirichlet prior of PRIOR documents shared out as the two classes
are (so rare words shrink to zero, and words of other documents count against), less DRIFT; other
words cost DRIFT. A linear scan finds all maximal scoring segments of a text. Their scores follow
an extreme-value law in texts that aren't toxic, P(S >= x) = 1 - exp(-K m exp(-lambda x)) for m
words, whose lambda and K are fitted by maximum likelihood on the labelled other documents. Several
segments of one text are judged together by the sum of their normalized scores. The score of a
document is a logistic function of that evidence (-ln p), fitted on the labelled documents. For
both fits a labelled document's own counts are taken out of its words' scores.

Training takes at most about TRAIN labelled rows; all their words of LEAST_DOCS documents are
learned, and texts are scored whole.

Edge cases: null, empty and wordless texts have no segments and no evidence; with no labels or only
one class every score is the share of toxic labels (0 without labels); repeated rows get equal
scores, those of one labelled id count as documents of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm.kernels import ALNUM, LOWER, blocks, span_hashes, words
from codonlake.llm.segments import segments_between
from codonlake.llm.session import bounded, fold, stash, table, tune, whole_texts

TRAIN = 20_000
#: Labelled documents that a learned word is in, documents of the prior, cost of every word.
LEAST_DOCS, PRIOR, DRIFT = 2, 2.0, 0.75
#: P-value up to which a passage is reported.
SIGNIFICANT = 0.05
PASSAGE = "array<struct<first: int, last: int, score: double, pvalue: double>>"


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of learned words
    toxic: np.ndarray  # labelled documents that hold the word
    other: np.ndarray
    share: float  # of toxic documents
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, at: np.ndarray, label: int | None = None) -> np.ndarray:
        """Scores of learned words; with a label those without the document itself."""
        t, o = self.toxic[at].astype(float), self.other[at].astype(float)
        if label is not None:
            t, o = np.maximum(t - label, 0), np.maximum(o - 1 + label, 0)
        return np.log((t + PRIOR * self.share) / (o + PRIOR * (1 - self.share))) - math.log(self.share / (1 - self.share)) - DRIFT


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word hash, toxic, other): documents that hold the word, of rows (doc_id, text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, buf, offs in blocks(batch):
                buf = LOWER[buf]
                starts, ends, first = words(buf, offs, ALNUM)
                if not len(starts):
                    continue
                h = span_hashes(buf, starts, ends)
                sides: list[list[np.ndarray]] = [[], []]
                for i, (p, q) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    sides[int(toxic[a + i] == 1)].append(np.unique(h[p:q]))
                for side in (0, 1):
                    if sides[side]:
                        key, n = np.unique(np.concatenate(sides[side]), return_counts=True)
                        zero = np.zeros(len(key), np.int64)
                        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n if side else zero), pa.array(zero if side else n)], ["word", "toxic", "other"])

    return labelled.mapInArrow(run, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def extreme_law(best: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood lambda and K of the best segments' scores of texts of ``size`` words."""
    ok = (best > 0) & (size > 0)
    s, m = best[ok], size[ok].astype(float)
    if len(s) < 2 or s.std() < 1e-9:
        return 1.0, 0.1
    m = m / m.mean()

    def slope(x: float) -> float:
        w = m * np.exp(-x * (s - s.min()))
        return 1 / x - s.mean() + float((w * s).sum() / w.sum())

    lo, hi = 1e-3, 50.0
    for _ in range(100):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    return lo, float(len(s) / (size[ok] * np.exp(-lo * s)).sum())


def evidence(scores: list[float], size: int, rate: float, scale: float) -> float:
    """-ln p of the best segments together (0 without any): for r segments of normalized scores that sum to t,
    p is about exp(-t) t^(r-1) / (r! (r-1)!); the best r counts, each further one at twice the price."""
    best, t, log_f = 0.0, 0.0, 0.0
    chance = math.log(max(scale * size, 1e-300))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = rate * s - chance
        if r > 1 and x <= 0:
            break
        t += x
        log_f += math.log(r) + (math.log(r - 1) if r > 1 else 0)
        if t > 0:
            tail = t - (r - 1) * math.log(t) + log_f
            p = math.exp(-tail) if tail > -50 else 1.0
            one = tail if tail > 30 else -math.log(-math.expm1(-p)) if p < 700 else 0.0
            best = max(best, one - (r - 1) * math.log(2))
    return best


def _scan(batches: Iterator[pa.RecordBatch], m: Model, report: bool) -> Iterator[tuple]:
    """(batch, first row, end row, sizes, for each text its maximal segments) of blocks; a third column is the label."""
    for batch in batches:
        labels = batch.column(2).to_pylist() if batch.num_columns > 2 else None
        for a, b, buf, offs in blocks(batch):
            buf = LOWER[buf]
            starts, ends, first = words(buf, offs, ALNUM)
            found: list[list] = [[] for _ in range(b - a)]
            if len(starts) and len(m.keys):
                h = span_hashes(buf, starts, ends)
                near = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
                known = m.keys[near] == h
                value = np.full(len(h), -DRIFT)
                if labels is None:
                    value[known] = m.scores(near[known])
                else:
                    for d in range(b - a):
                        mine = slice(first[d], first[d + 1])
                        value[mine][known[mine]] = m.scores(near[mine][known[mine]], labels[a + d])
                upto = np.concatenate([[0.0], np.cumsum(value)])
                up = value > 0
                edge = up.copy()
                edge[1:] &= ~up[:-1]
                inner = first[:-1][(first[:-1] < first[1:])]
                edge[inner] = up[inner]
                lo = np.flatnonzero(edge)
                stop = up.copy()
                stop[:-1] &= ~up[1:]
                last = first[1:][(first[:-1] < first[1:])] - 1
                stop[last] = up[last]
                hi = np.flatnonzero(stop)
                cut = np.searchsorted(lo, first).tolist()
                low, high, lo, hi = upto[lo].tolist(), upto[hi + 1].tolist(), lo.tolist(), hi.tolist()
                for d in range(b - a):
                    p, q = cut[d], cut[d + 1]
                    if q > p:
                        found[d] = segments_between(lo[p:q], hi[p:q], low[p:q], high[p:q])
            yield batch, a, b, first, found


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Model | None:
    """Learn from at most about ``train`` rows of ``labels`` (doc_id, toxic); None without both classes."""
    sample = bounded(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), train, "toxic")
    # at most 1.25 * train rows of two numbers
    rows = stash(whole_texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    got = word_counts(rows).where(F.col("toxic") + F.col("other") >= LEAST_DOCS).toArrow()
    keys = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    toxic, other = (got.column(i).to_numpy()[order].astype(np.int32) for i in (1, 2))
    model = Model(keys[order], toxic, other, sizes[1] / (sizes[0] + sizes[1]))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, first, found in _scan(batches, shared.value, False):
            scores = pa.array([sorted((s for *_, s in x), reverse=True)[:1000] for x in found], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(2).slice(a, b - a), pa.array(np.diff(first), pa.int64()), scores], ["toxic", "n", "scores"])

    # numbers of at most 1.25 * train texts
    seen = rows.mapInArrow(run, "toxic int, n long, scores array<double>").toArrow().to_pydict()
    y, n, best = np.array(seen["toxic"], float), np.array(seen["n"]), np.array([s[0] if s else 0.0 for s in seen["scores"]])
    model.rate, model.scale = extreme_law(best[y == 0], n[y == 0])
    x = np.array([evidence(s, k, model.rate, model.scale) for s, k in zip(seen["scores"], seen["n"], strict=True)])
    model.slope, model.offset = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression with a light penalty; both classes weigh the same."""
    w = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    x = np.minimum(x, 50.0)
    slope, offset = 0.1, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        v = w * p * (1 - p)
        g = np.array([(w * (y - p) * x).sum() - slope, (w * (y - p)).sum() - 0.01 * offset])
        hess = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        slope, offset = slope + step[0], offset + step[1]
        if abs(step).max() < 1e-7:
            break
    return max(float(slope), 1e-6), float(offset)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, n_words, passages, evidence): segments that are more than chance, and -ln p of a text's segments together."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("pvalue", pa.float64())]))
        for batch, a, b, first, found in _scan(batches, m, True):
            size, begin = np.diff(first).tolist(), first.tolist()
            told, total = [], []
            for d, x in enumerate(found):
                total.append(evidence([s for *_, s in x], size[d], m.rate, m.scale))
                near = [(p - begin[d], q - begin[d], s, -math.expm1(-m.scale * size[d] * math.exp(-m.rate * s))) for p, q, s in x]
                told.append([{"first": p, "last": q, "score": s, "pvalue": v} for p, q, s, v in near if v <= SIGNIFICANT])
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(told, kind), pa.array(total, pa.float64())], ["doc_id", "n_words", "passages", "evidence"])

    return whole_texts(docs).mapInArrow(run, f"doc_id long, n_words long, passages {PASSAGE}, evidence double")


def score(docs: DataFrame, model: Model | None, share: float = 0.0) -> DataFrame:
    """passages() with ``score``; without a model every score is ``share``."""
    none = np.zeros(0, np.int32)
    own = model or Model(none.astype(np.uint64), none, none, 0.5, offset=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return passages(docs, own).withColumn("score", 1 / (1 + F.exp(-(F.lit(own.slope) * F.least("evidence", F.lit(50.0)) + own.offset))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    tune(spark)
    model = fit(docs.select("doc_id", "text"), labels.where(fold("doc_id", 5) != 0))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
