"""Benchmark decontamination by winnowing.

Words are compared in runs of GRAM words. Of every WINDOW neighbouring runs the one with the
smallest hash is kept as a fingerprint, in documents and in benchmark items alike, so every shared
span of GRAM + WINDOW - 1 words (the window of the contract: 10) holds a fingerprint that both sides
keep. A document's fingerprint that the benchmark has, too, is extended to the windows around it;
these are joined with the windows of the items by 128 bits of hash. Items shorter than a window are
looked up by their own length.

Documents are read once. Which fingerprints the benchmark has is told by a bit table of fixed size
(2 MB), built by Spark and broadcast: as it fills up, more windows come to the join, and none is lost.
Windows of the benchmark are broadcast up to BLOCK_WORDS words and shuffled beyond. Hits of a row
meet by a key of that row, so rows of one id, or of none, stay apart.

Edge cases: null and empty texts have no words; items without words are left out; items of the
same id are one item; null item ids read as the text "null" in the digest. An empty benchmark
gives no hits, empty documents an empty table; repeated rows and rows with a null id each have a row
of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm.kernels import ALNUM, LOWER, blocks, mix, ngrams, sliding_min, span_hashes, words
from codonlake.llm.session import stash, table, tune

GRAM, WINDOW = 6, 5
SPAN = GRAM + WINDOW - 1
#: Words of the benchmark up to which its windows (some 40 bytes a word) are broadcast.
BLOCK_WORDS = 400_000
#: Bits of the table of fingerprints.
BITS = 24
_U = np.uint64
_HIT = "array<struct<item: string, first: int, last: int>>"


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash of each window (the last one of equals)."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    low = sliding_min(grams, WINDOW)
    keep = np.zeros(len(grams), bool)
    for t in range(WINDOW):
        keep[t : t + len(low)] |= grams[t : t + len(low)] == low
    return np.flatnonzero(keep)


def grams_at(h: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the runs of ``k`` words at some places; the length is part of the hash."""
    g = np.full(len(at), _U(0x9E3779B97F4A7C15 + 2 * (64 * salt + k)), _U)
    for t in range(k):
        g = g * _U(0xD1342543DE82EF95) + h[at + t]
    return mix(g)


def fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of all texts of a block (word hashes, first words of the texts)."""
    grams = ngrams(h, GRAM)
    at = winnowed(grams)
    text = np.searchsorted(first, at, "right") - 1
    at = at[at + GRAM <= first[text + 1]] if len(at) else at
    return at, grams[at]


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, index of each text's first word) of blocks."""
    for a, b, buf, offs in blocks(batch):
        buf = LOWER[buf]
        starts, ends, first = words(buf, offs, ALNUM)
        yield a, b, span_hashes(buf, starts, ends), first


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (item, text) to rows (item, size, h1, h2) of their windows and rows (size, print) of what finds them."""
    names = ["item", "size", "h1", "h2", "print"]
    for batch in batches:
        for a, b, h, first in _hashed(batch):
            size = np.diff(first)
            text = np.repeat(np.arange(b - a), size)
            at = np.flatnonzero(np.arange(len(h)) + np.minimum(size[text], SPAN) <= first[1:][text]) if len(h) else np.zeros(0, np.int64)
            k = np.minimum(size[text[at]], SPAN)
            for n in np.unique(k).tolist():
                own = at[k == n]
                h1, h2 = grams_at(h, own, n), grams_at(h, own, n, 1)
                ids = batch.column(0).take(pa.array(a + text[own]))
                yield pa.record_batch([ids, pa.array(np.full(len(own), n), pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(h1.view(np.int64) if n < SPAN else np.zeros(len(own), np.int64))], names)
            _, prints = fingerprints(h, first)
            none = pa.nulls(len(prints), pa.int64())
            yield pa.record_batch([pa.nulls(len(prints), pa.string()), pa.array(np.full(len(prints), SPAN), pa.int32()), none, none, pa.array(prints.view(np.int64))], names)


def bit_table(prints: DataFrame) -> np.ndarray:
    """The bits of the column ``print``: 2^18 words come to the driver at most."""
    spot = F.col("print").bitwiseAND(F.lit((1 << BITS) - 1))
    each = prints.select(spot.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w"))
    got = each.agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("x")).toArrow()
    out = np.zeros(1 << (BITS - 6), "<i8")
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def candidates(docs: DataFrame, known: np.ndarray, sizes: list[int]) -> DataFrame:
    """Rows (row, doc_id, n_words, near): the windows of each row around fingerprints that the benchmark may have."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(known, bitorder="little"), sizes))
    mask = _U((1 << BITS) - 1)
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, short = shared.value
        bits = np.unpackbits(packed, bitorder="little").view(bool)
        for batch in batches:
            for a, b, h, first in _hashed(batch):
                found = []
                if len(h):
                    at, prints = fingerprints(h, first)
                    at = at[bits[(prints & mask).astype(np.int64)]]
                    start = np.unique((at[:, None] - np.arange(WINDOW)[None, :]).ravel())
                    text = np.searchsorted(first, start, "right") - 1
                    ok = (start >= 0) & (start + SPAN <= first[np.clip(text, 0, b - a - 1) + 1])
                    found.append((SPAN, start[ok]))
                    text = np.repeat(np.arange(b - a), np.diff(first))
                    for k in short:
                        at = np.flatnonzero(np.arange(len(h)) + k <= first[1:][text])
                        found.append((k, at[bits[(grams_at(h, at, k) & mask).astype(np.int64)]]))
                place = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
                size = np.concatenate([np.full(len(x), k) for k, x in found]) if found else place
                h1, h2 = (np.concatenate([grams_at(h, x, k, salt) for k, x in found]) if found else np.zeros(0, _U) for salt in (0, 1))
                order = np.argsort(place, kind="stable")
                place = place[order]
                text = np.searchsorted(first, place, "right") - 1
                inner = pa.StructArray.from_arrays([pa.array(h1[order].view(np.int64)), pa.array(h2[order].view(np.int64)), pa.array((place - first[text]).astype(np.int32)), pa.array(size[order].astype(np.int32))], fields=list(kind))
                upto = np.searchsorted(text, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), inner)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first), pa.int64()), lists], ["row", "doc_id", "n_words", "near"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, near array<struct<h1: long, h2: long, first: int, size: int>>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (row, hits: first, size, item) to runs of each item: windows that touch or overlap become one."""
    for batch in batches:
        out = []
        for hits in batch.column(1).to_pylist():
            hits.sort(key=lambda x: (x["item"], x["first"]))
            own: list[dict] = []
            for x in hits:
                last = x["first"] + x["size"] - 1
                if own and own[-1]["item"] == x["item"] and x["first"] <= own[-1]["last"] + 1:
                    own[-1]["last"] = max(last, own[-1]["last"])
                else:
                    own.append({"item": x["item"], "first": x["first"], "last": last})
            out.append(own)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("last", pa.int32())])))], ["row", "hits"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, hits) for every row of ``docs``: each hit is an item and the first and last word of a run of its windows."""
    tune(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    both = stash(items.mapInArrow(_windows, "item string, size int, h1 long, h2 long, print long"), "windows", scan=True)
    own = both.where("h1 is not null").select("item", "size", "h1", "h2").distinct()
    sizes = sorted(r["size"] for r in both.where(f"size < {SPAN}").select("size").distinct().collect())  # nine at most
    near = stash(candidates(docs, bit_table(both.where(f"size < {SPAN} or h1 is null")), sizes), "near", scan=True)
    if both.count() <= 2 * broadcast_words:
        own = F.broadcast(own)
    met = near.select("row", F.explode("near").alias("x")).select("row", "x.*").join(own, ["h1", "h2", "size"])
    hits = met.groupBy("row").agg(F.collect_list(F.struct("item", "first", "size")).alias("hits")).mapInArrow(_runs, f"row long, hits {_HIT}")
    out = near.select("row", "doc_id", "n_words").join(hits, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast(_HIT)).alias("hits"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of item ids from decontaminate()."""
    run = F.expr("sort_array(transform(hits, h -> struct(h.first as a, h.last as b)))")
    covered = F.aggregate(
        run,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("e")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["e"] + 1, x["a"]) + 1)).cast("long").alias("n"), F.greatest(s["e"], x["b"]).alias("e")),
        lambda s: s["n"],
    )
    items = F.array_sort(F.array_distinct(F.col("hits.item")))
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute_force(docs: list[tuple], benchmark: list[tuple]) -> dict:
    """What op4 returns, by a plain scan of every window; for tests."""
    import re

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins: dict[tuple, set[str]] = {}
    for item, text in benchmark:
        w = word.findall(lower(text))
        k = min(SPAN, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(x) for x in wins}
    out = {}
    for doc, text in docs:
        w, hit, items = word.findall(lower(text)), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if got := wins.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    items |= got
        out[doc] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out
