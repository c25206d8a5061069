"""Language identification with a string kernel.

The kernel of two texts counts the byte n-grams (lengths 1 to MOST together: a blended spectrum)
that both hold, each once, over the geometric mean of their numbers. Landmark texts give a Nyström
map; ridge regression, one against the rest, is fitted in its space. Scoring a block of texts is
three matrix products: presence by landmark, whitening, class weights.

Landmarks and training rows are bounded samples of the labelled rows, the same number for each
language (LANDMARKS and TRAIN in all, EACH for a language at least). All n-grams of the landmarks
count, by their exact bytes, and all languages that rows are labelled with are classes.

Edge cases: null and empty texts and texts without a letter are "und" with score 0; with no
labelled text everything is "und"; ties go to the first language by name; repeated rows get equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm.kernels import LOWER, blocks
from codonlake.llm.session import fold, stash, table, tune, whole_texts

MOST, LANDMARKS, TRAIN, EACH, RIDGE = 3, 96, 3_000, 4, 1e-3
UNKNOWN = "und"
#: Numbers of all n-grams of up to MOST bytes; numbers of a presence matrix that are in memory at once.
CODES, CELLS = 256 + 256**2 + 256**3, 1 << 23


@dataclass
class Model:
    grams: np.ndarray  # sorted codes of the landmarks' n-grams: the features
    by_landmark: np.ndarray  # features x landmarks, 0 or 1
    sizes: np.ndarray  # n-grams of each landmark
    whiten: np.ndarray | None = None
    weights: np.ndarray | None = None
    languages: list[str] | None = None

    def slots(self) -> np.ndarray:
        """The feature of each n-gram code, or -1; made where it is used, not shipped."""
        out = np.full(CODES, -1, np.int32)
        out[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        return out


def gram_codes(buf: np.ndarray) -> list[np.ndarray]:
    """The code of the n-gram that starts at each byte, for each n: its bytes as a number, after those of shorter ones."""
    x = LOWER[buf].astype(np.int32)
    out, code, base = [], np.zeros(len(x), np.int32), 0
    for n in range(1, MOST + 1):
        code = code[: max(0, len(x) - n + 1)] * 256 + x[n - 1 :]
        out.append(code + base)
        base += 256**n
    return out


def presence(buf: np.ndarray, offs: np.ndarray, slots: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts x features (0 or 1), and the number of features that each text holds."""
    texts = len(offs) - 1
    out = np.zeros((texts, features + 1), np.float32)
    text = np.repeat(np.arange(texts), np.diff(offs))
    size = np.diff(offs)
    for n, code in enumerate(gram_codes(buf), 1):
        inner = np.ones(len(code), bool)
        for t in range(1, n):  # not across texts
            edge = offs[1:-1] - t
            edge = edge[(edge >= 0) & (edge < len(code))]
            inner[edge] = False
        own = slots[code].astype(np.int64)
        own[~inner] = -1
        out.ravel()[text[: len(code)] * (features + 1) + own + 1] = 1.0
    out = out[:, 1:]
    return out, np.where(size > 0, np.maximum(out.sum(1), 1), 1)


def kernel(buf: np.ndarray, offs: np.ndarray, m: Model, slots: np.ndarray) -> np.ndarray:
    """Texts x landmarks; as many texts at a time as CELLS allows, so memory doesn't depend on the block."""
    out = []
    for x, o in _cut(buf, offs, max(1, min(256, CELLS // (len(m.grams) + 1)))):
        p, n = presence(x, o, slots, len(m.grams))
        out.append((p @ m.by_landmark) / np.sqrt(n[:, None] * m.sizes[None, :]))
    return np.concatenate(out)


def _cut(buf: np.ndarray, offs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(offs) - 1, most):
        o = offs[i : i + most + 1]
        yield buf[o[0] : o[-1]], o - o[0]


def sampled(rows: DataFrame, each: dict[str, float], salt: str) -> DataFrame:
    """Rows whose hashed id falls under the share of their language."""
    u = F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[x for k, v in each.items() for x in (F.lit(k), F.lit(v))])
    return rows.where(u < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))


def fit(rows: DataFrame, landmarks: int = LANDMARKS, train: int = TRAIN) -> Model | None:
    """Learn from (doc_id, text, lang); None without labelled texts."""
    rows = rows.where("lang is not null and doc_id is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a number for each class
    if not sizes:
        return None
    names = sorted(sizes)
    landmarks, train = (max(x, EACH * len(names)) for x in (landmarks, train))
    share = lambda most: {k: min(1.0, most / len(names) / n) for k, n in sizes.items()}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in blocks(batch):
                own = [np.unique(np.concatenate(gram_codes(buf[offs[i] : offs[i + 1]]))) for i in range(b - a)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], ["doc_id", "grams"])

    # at most 2 * LANDMARKS texts, each as its distinct n-grams
    marks = whole_texts(sampled(rows, share(landmarks), "landmark").limit(2 * landmarks)).mapInArrow(distinct, "doc_id long, grams array<long>")
    marks = [np.array(r.grams, np.int64) for r in marks.orderBy("doc_id").toLocalIterator() if r.grams]
    if not marks:
        return None
    grams = np.unique(np.concatenate(marks))
    by = np.zeros((len(grams), len(marks)), np.float32)
    for j, g in enumerate(marks):
        by[np.searchsorted(grams, g), j] = 1
    model = Model(grams.astype(np.int32), by, np.maximum(by.sum(0), 1))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value.slots()
        for batch in batches:
            for a, b, buf, offs in blocks(batch):
                k = kernel(buf, offs, shared.value, slots)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(list(k.astype(np.float64)), pa.list_(pa.float64()))], ["doc_id", "lang", "k"])

    picked = whole_texts(sampled(rows, share(train), "train").limit(2 * train), "lang")
    got = picked.mapInArrow(mapped, "doc_id long, lang string, k array<double>").orderBy("doc_id").collect()  # bounded: at most 2 * TRAIN rows of LANDMARKS numbers
    x = np.array([r.k for r in got])
    y = np.array([[1.0 if r.lang == n else -1.0 for n in names] for r in got])
    # Nyström: whiten by the kernel of the landmarks among themselves
    between = (by.T @ by) / np.sqrt(model.sizes[:, None] * model.sizes[None, :])
    value, vector = np.linalg.eigh(between.astype(float))
    ok = value > 1e-6 * value.max()
    model.whiten = (vector[:, ok] / np.sqrt(value[ok])).astype(np.float32)
    z = np.concatenate([x @ model.whiten, np.ones((len(x), 1))], 1)
    per = np.array([1.0 / max(1, sum(r.lang == n for r in got)) for n in names])
    weight = np.array([per[names.index(r.lang)] for r in got])
    weight /= weight.mean()
    gram = (z * weight[:, None]).T @ z + RIDGE * len(z) * np.eye(z.shape[1])
    model.weights = np.linalg.solve(gram, (z * weight[:, None]).T @ y).astype(np.float32)
    model.languages = names
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score) of every text."""
    import regex

    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letter = shared.value, regex.compile(r"\p{L}")
        slots = m.slots() if m is not None else None
        for batch in batches:
            texts = batch.column(1)
            for a, b, buf, offs in blocks(batch):
                lang, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                if m is not None:
                    k = kernel(buf, offs, m, slots)
                    margin = (k @ m.whiten) @ m.weights[:-1] + m.weights[-1]
                    best = margin.argmax(1)
                    soft = np.exp(4 * (margin - margin.max(1, keepdims=True)))
                    sure = soft.max(1) / soft.sum(1)
                    for i in range(b - a):
                        if letter.search(texts[a + i].as_py()):
                            lang[i], score[i] = m.languages[best[i]], sure[i]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tune(spark)
    model = fit(docs.select("doc_id", "text", "lang").where(fold("doc_id", 4) != 2))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
