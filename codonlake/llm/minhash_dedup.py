"""Near duplicates by circulant MinHash, banding and exact verification, to connected components.

A document is the set of its distinct n-word shingles. One permutation (sigma) scatters the shingles on a
circle of 2^32 places; a second one (pi), shifted along the circle by k places, gives coordinate k of the
signature as the least value on the set. So two permutations make all COORDINATES. BANDS bands of ROWS
coordinates each propose pairs: two sets of similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS, all but one in ten million at s = 0.8. Every link is confirmed on the full
sets, read from the texts.

Equal sets meet by hash first and are one document from then on, so a group of copies is one row of each band.
In the lists of documents that share a band no list emits all its pairs. A document's popularity is how
many others it shares bands with. First each document is compared with one partner, of the most popular ones of its
lists (their middle, which the others were copied from) the one it meets most often; links merge documents
into classes. Then the most popular one of a list is compared with the members of other classes, then eight, 64
and so on, with classes merged after each round, so a group of near copies costs about its size. A list is
done when it has one class or each member has been compared with the others that are in other classes; no
partner is dropped. Pairs are ruled out before texts are read by their sizes, by bitmaps of both sets (a bit that
one set alone has stands for a shingle that the other lacks, which is exact) and by the low bits of the
signatures: a pair at the threshold differs in more than FAR of those once in a billion.

Edge cases: null and empty texts and those without words have the empty set, link with nothing
and are their own component; a text of fewer words than n is one shingle; equal texts share a component;
rows of one id with different texts are one document, linked by its largest set (the larger hash on a
tie), though each row has its own n_shingles; a row with a null id keeps its n_shingles, links
with nothing, has no component and is kept; empty tables give empty results; extra columns are ignored. Shingles are
known by 64-bit hashes, which aren't made for hostile input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.llm.jaccard_join import BINS, _Search, set_hashes, shingle_sets
from codonlake.llm.kernels import blocks
from codonlake.llm.session import discard, fewer, stash, table, tune, whole_texts

_U = np.uint64
#: Coordinates of a band, bands, and coordinates in all (a multiple of 64, each with a bit in the sketch).
ROWS, BANDS, COORDINATES = 5, 38, 192
#: Sketch bits that may differ: a pair of similarity 0.8 differs in 19.2 of 192, with a deviation of 4.2.
FAR = 45
#: Words of 64 bits in a document's bitmap of shingle hashes.
MAP = 32
#: Documents of a list that are compared with the others in the first round, and the factor of each further round.
GROW = 8


def _scatter(x: np.ndarray) -> np.ndarray:
    """Sigma: from 64-bit hashes to the circle."""
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x >> _U(32)).astype(np.uint32)


def _permute(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Pi: a permutation of the circle, in place of ``x``; ``out`` is room to work in."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=out)
        np.bitwise_xor(x, out, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=out)
    return np.bitwise_xor(x, out, out=x)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant min-hashes of non-empty sets: one row for each, COORDINATES columns."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    place = _scatter(np.concatenate(sets))
    out = np.empty((COORDINATES, len(sets)), np.uint32)
    x, room = np.empty_like(place), np.empty_like(place)
    for k in range(COORDINATES):
        np.add(place, np.uint32(k), out=x)  # the circle turned by k places
        out[k] = np.minimum.reduceat(_permute(x, room), at)
    return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, the band's number included."""
    key = np.zeros((len(signature), BANDS), _U)
    for r in range(ROWS):
        key = (key ^ signature[:, r : ROWS * BANDS : ROWS].astype(_U)) * _U(0x9E3779B97F4A7C15)
        key ^= key >> _U(31)
    return (key + np.arange(BANDS, dtype=_U)) * _U(0xD6E8FEB86659FD93)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, s1, s2, keys, sketch, map, bins) of each document: size and 128-bit hash of its set, band keys, low bits of the signature, bitmap and histogram of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in blocks(batch):
                sets = list(shingle_sets(buf, offs, n))
                full = [i for i, x in enumerate(sets) if len(x)]
                size = np.array([len(x) for x in sets], np.int64)
                s1, s2 = np.array([set_hashes(x) for x in sets], np.int64).reshape(-1, 2).T
                keys, sketch = np.zeros((len(full), BANDS), np.int64), np.zeros((len(full), COORDINATES // 64), np.int64)
                if full:
                    sig = signatures([sets[i] for i in full])
                    keys = band_keys(sig).view(np.int64)
                    sketch = np.ascontiguousarray(np.packbits((sig & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little")).view("<i8")
                maps = np.zeros((len(full), 64 * MAP), np.uint8)
                for k, i in enumerate(full):
                    maps[k, ((sets[i] >> _U(8)) % _U(64 * MAP)).astype(np.int64)] = 1
                maps = np.ascontiguousarray(np.packbits(maps, axis=1, bitorder="little")).view("<i8")
                bins = [np.minimum(np.bincount((x & _U(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() for x in sets]
                has = np.zeros(len(sets) + 1, np.int64)
                has[1:] = np.cumsum(size > 0)
                lists = lambda x, k: pa.ListArray.from_arrays(pa.array(k * has, pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(size), pa.array(s1), pa.array(s2), lists(keys, BANDS), lists(sketch, COORDINATES // 64), lists(maps, MAP), pa.array(bins, pa.binary())], ["doc_id", "n", "s1", "s2", "keys", "sketch", "map", "bins"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch array<long>, map array<long>, bins binary")


def near_components(docs: DataFrame, n: int = 5, num: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); documents link at a similarity of num / 100, 80 at least."""
    if num < 80:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    tune(docs.sparkSession)
    docs = whole_texts(docs)
    every = stash(signed(docs, n), "signed", scan=True)
    # of rows of one id the largest set stands for the document; of equal sets the smallest id
    one = every.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2")).alias("set")).select("doc_id", "set.*")
    first = stash(one.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id")), "reps")
    rows = stash(every.join(first, ["doc_id", "n", "s1", "s2"], "left_semi").dropDuplicates(["doc_id"]), "sets")
    entries = rows.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"), "n")
    a_list = W.partitionBy("key")
    shared = stash(entries.withColumn("size", F.count("*").over(a_list)).where("size > 1"), "shared")
    # popularity: how many others a document meets in its bands
    popular = shared.groupBy("doc").agg(F.sum(F.col("size") - 1).alias("popularity"))
    live = stash(shared.join(popular, "doc").withColumn("nth", F.row_number().over(a_list.orderBy(F.desc("popularity"), "doc"))), "live")
    discard(shared)
    search = _Search(docs.where("doc_id is not null"), rows.select("doc_id", "bins"), n, num)
    sketches = rows.select(F.col("doc_id").alias("doc"), *[F.get("sketch", F.lit(i)).alias(f"w{i}") for i in range(COORDINATES // 64)], *[F.get("map", F.lit(i)).alias(f"m{i}") for i in range(MAP)])
    # one partner for each document
    head = live.where("nth = 1").select("key", F.col("doc").alias("h_doc"), F.col("n").alias("h_n"))
    times = live.where("nth > 1").join(head, "key").where(f"least(n, h_n) * 100 >= greatest(n, h_n) * {num}").groupBy("doc", "n", "h_doc", "h_n").agg(F.count("*").alias("times"))
    partner = times.groupBy("doc", "n").agg(F.max(F.struct("times", (-F.col("h_doc")).alias("neg"), "h_n")).alias("x")).select("doc", "n", (-F.col("x.neg")).alias("h_doc"), F.col("x.h_n").alias("h_n"))
    search.test(_ordered(partner))
    low, high = 0, 1
    while True:
        open_ = search.classes.of(live, "doc", "class")
        counted = open_.groupBy("key", "class").agg(F.count("*").alias("k"), F.max("size").alias("size"))
        mixed = counted.groupBy("key").agg(F.count("*").alias("classes"), F.max("size").alias("size"), F.max(F.struct("k", "class"))["class"].alias("main")).where(f"classes > 1 and size > {low}").select("key", "main")
        lists = stash(open_.join(mixed, "key").join(sketches, "doc"), "lists")
        if lists.isEmpty():
            discard(lists)
            break
        search.test(_met(lists, low, high, num))
        discard(lists)
        low, high = high, high * GROW
    out = every.where("doc_id is not null").select("doc_id", "n").join(one.join(first.withColumnRenamed("doc_id", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep"), "doc_id", "left")
    rep = out.select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    found = search.classes.of(rep, "rep", "component").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    found = found.unionByName(every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    result = stash(found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    for done in (every, first, rows, live, search.classes.rows):
        discard(done)
    return fewer(result)


def _met(lists: DataFrame, low: int, high: int, num: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb) that may link: members of a list that aren't of its main class, each with those members after
    ``low`` up to ``high`` in order that are of another class than itself. Of two classes one isn't the main one, so every pair comes up."""
    words, maps = [f"w{i}" for i in range(COORDINATES // 64)], [f"m{i}" for i in range(MAP)]
    heads = lists.where((F.col("nth") > low) & (F.col("nth") <= high)).select("key", *[F.col(c).alias(f"h_{c}") for c in ("doc", "n", "class", *words, *maps)])
    far = " + ".join(f"bit_count({c} ^ h_{c})" for c in words)
    apart = " + ".join(f"bit_count({c} ^ h_{c})" for c in maps)  # so many shingles at least are in one set alone
    met = lists.where("class != main").join(heads, "key").where(f"class != h_class and least(n, h_n) * 100 >= greatest(n, h_n) * {num} and {far} <= {FAR} and (n + h_n - ({apart})) * (100 + {num}) >= 2 * {num} * (n + h_n)")
    return _ordered(met).distinct()


def _ordered(met: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb), the smaller id first, of documents (doc, n) and partners (h_doc, h_n)."""
    first = F.col("doc") < F.col("h_doc")
    return met.select(F.least("doc", "h_doc").alias("a"), F.greatest("doc", "h_doc").alias("b"), F.when(first, F.col("n")).otherwise(F.col("h_n")).alias("na"), F.when(first, F.col("h_n")).otherwise(F.col("n")).alias("nb"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), n=2, num=80)


#: Components over all pairs that share a shingle, for shingles of ``n`` words and a similarity of ``num`` / 100.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [ws] ELSE list_transform(range(1, len(ws) - {less} + 1), lambda i: ws[i : i + {less}]) END)) AS h FROM w),
sizes AS (SELECT doc_id, count(h) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
sets AS (SELECT doc_id, list(h ORDER BY h)::VARCHAR AS key FROM s GROUP BY doc_id),
reps AS (SELECT key, min(doc_id) AS rep FROM sets GROUP BY key),
r AS (SELECT s.doc_id, h, n FROM s JOIN reps ON rep = s.doc_id JOIN sizes ON sizes.doc_id = s.doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.h = y.h AND x.doc_id < y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {num}
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*) * {over} >= (x.n + y.n) * {num}),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS doc_id, rep AS c FROM reps UNION SELECT b, c FROM reach JOIN edges ON a = doc_id),
comp AS (SELECT doc_id AS rep, min(c) AS c FROM reach GROUP BY doc_id)
SELECT sizes.doc_id, n AS n_shingles, coalesce(c, sizes.doc_id) AS component_id{more}
FROM sizes LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (key) LEFT JOIN comp USING (rep)
"""
OP12_SQL = COMPONENTS_SQL.format(n=2, less=1, num=80, over=180, more=", coalesce(c, sizes.doc_id) = sizes.doc_id AS kept")
OP7_SQL = COMPONENTS_SQL.format(n=4, less=3, num=85, over=185, more="")
