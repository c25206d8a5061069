"""Quality classifier: a sparse ensemble of rules.

Statistics of whole texts feed a random forest; every path of its trees is a conjunctive rule over
the statistics. A logistic regression with an L1 penalty over all rules keeps few of them, and
those are compiled into one Spark column expression over the statistics.

Training takes at most about TRAIN labelled rows. Statistics of all texts are written once to the
shared folder, so texts are read once and no text is shuffled.

Edge cases: null and empty texts have statistics of 0 and get a score like any other; without
labels, or with one class, every score is the share of label 1 (1 without labels); repeated rows
get equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm.kernels import SPACED, blocks, ngrams, span_hashes, words
from codonlake.llm.session import bounded, fold, stash, table, tune, whole_texts

TRAIN = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.001, 7
STATS = ("words", "mean_word", "symbols", "digits", "upper", "marks", "pipes", "wide", "dup_lines", "distinct", "echo", "repeats", "line_words")
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether it is at most, threshold)

_CLASSES = {"symbols": b"#*$%&|<>", "digits": b"0123456789", "upper": bytes(range(65, 91)), "marks": b"!?", "pipes": b"|"}


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[offs[1:]] - c[offs[:-1]]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS (double) of every text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in blocks(batch):
                starts, ends, first = words(buf, offs, SPACED)
                n = np.diff(first).astype(float)
                some = np.maximum(n, 1)
                chars = np.maximum(_sums(ends - starts, first), 1).astype(float)
                cols = {"words": np.log1p(n), "mean_word": chars / some * (n > 0)}
                for name, members in _CLASSES.items():
                    of = np.zeros(256, bool)
                    of[list(members)] = True
                    cols[name] = _sums(of[buf], offs) / chars
                cols["wide"] = _sums(buf >= 0x80, offs) / chars
                h = span_hashes(buf, starts, ends)
                same = np.zeros(len(h), bool)
                same[1:] = h[1:] == h[:-1]
                cols["echo"] = _sums(same, first) / some
                five = ngrams(h, 5)
                line_ends = np.flatnonzero(buf == 10)
                edges = np.unique(np.concatenate([offs, line_ends, line_ends + 1]))
                lo, hi = edges[:-1], edges[1:]
                text = (hi - lo > 1) | (buf[lo] != 10) if len(lo) else np.zeros(0, bool)
                lo, hi = lo[text], hi[text]
                line = span_hashes(buf, lo, hi)
                at = np.searchsorted(lo, offs)
                cols["line_words"] = np.log1p(n / np.maximum(np.diff(at), 1))
                dup, distinct, repeats = (np.zeros(b - a) for _ in range(3))
                for i in range(b - a):
                    p, q = first[i], first[i + 1]
                    if q > p:
                        distinct[i] = len(np.unique(h[p:q])) / (q - p)
                        if q - p >= 5:
                            repeats[i] = 1 - len(np.unique(five[p : q - 4])) / (q - p - 4)
                        x = line[at[i] : at[i + 1]]
                        dup[i] = 1 - len(np.unique(x)) / max(1, len(x))
                cols |= {"dup_lines": dup, "distinct": distinct, "repeats": repeats}
                yield pa.record_batch([batch.column(0).slice(a, b - a), *[pa.array(np.asarray(cols[c], float)) for c in STATS]], ["doc_id", *STATS])

    return whole_texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATS))


def tree_rules(model) -> list[Rule]:
    """The path to every node of every tree, each once; intervals of one statistic are joined."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict[tuple[int, bool], float]) -> None:
        if path:
            found[tuple(sorted((f, low, t) for (f, low), t in path.items()))] = None
        if node.numDescendants():
            split = node.split()
            f, t = split.featureIndex(), split.threshold()
            walk(node.leftChild(), path | {(f, True): min(t, path.get((f, True), t))})
            walk(node.rightChild(), path | {(f, False): max(t, path.get((f, False), t))})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for f, low, t in rule:
        out &= (F.col(STATS[f]) <= t) if low else (F.col(STATS[f]) > t)
    return out


def fit(stats: DataFrame, labels: DataFrame, train: int = TRAIN) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and the constant, from at most about ``train`` rows of ``labels`` (doc_id, quality)."""
    sample = bounded(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), train, "quality")
    rows = stats.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", *STATS, F.when(F.col("quality") == 1, 1.0).otherwise(0.0).alias("label"))
    rows = stash(rows.repartition(4), "train")
    share = rows.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        p = min(max(1.0 if share is None else share, 1e-6), 1 - 1e-6)
        return [], float(np.log(p / (1 - p)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", maxBins=64)
    rules = tree_rules(forest.fit(VectorAssembler(inputCols=list(STATS), outputCol="features").transform(rows)))
    if not rules:
        return [], float(np.log(share / (1 - share)))
    flags = rows.select("label", F.array(*[condition(r).cast("double") for r in rules]).alias("flags"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=False)
    fitted = lasso.fit(flags.select("label", array_to_vector("flags").alias("features")))
    return [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w], float(fitted.intercept)


def compiled(rules: list[tuple[Rule, float]], constant: float) -> Column:
    """The score as an expression over STATS."""
    total = F.lit(constant)
    for rule, weight in rules:
        total += F.when(condition(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    stats = stash(statistics(docs.select("doc_id", "text")), "statistics")
    rules, constant = fit(stats, labels.where(fold("doc_id", 4) != 2))
    out = stats.withColumn("score", compiled(rules, constant))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
