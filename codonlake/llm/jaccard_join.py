"""N-gram Jaccard self-join by T-occurrence search, to connected components.

A document is the set of its distinct n-word shingles (64-bit hashes). Two documents link when
their Jaccard similarity reaches num / 100. T, the overlap they need, follows from their sizes, and
the inverted lists of a document are divided as in DivideSkip:

* L = T - NEED long lists, those of its most frequent shingles, are never merged;
* the short lists, the other n - L, are merged: rows (shingle, document) go through one sorted
  shuffle, and a pair of documents that reaches T must meet in at least NEED of them, so pairs are
  counted and those below are dropped;
* pairs that remain are probed: each shingle of the smaller set, those of the long lists included,
  is looked up in the sorted set of the other by binary search.

"Frequent" is by an order that all documents share: how often a shingle's bucket occurs in the
corpus, counted in a table of fixed size over all documents, then the hash. It only sets the cost.

Copies meet first (equal sets have one representative), so a group of copies never pairs up. Then
every document meets the first document of its lists, the one it meets most often before the
others, and its neighbours in an order of each list's own; links found there merge documents into
classes, and the counted search runs over documents of one list that are still in different classes. So a large group of
near copies costs its size, not its square, and no link between classes is lost. In that search a
list is dealt by bands of set size, so only sizes that may link meet, and a pair is left out where
its places in the list or the bitmaps of both sets show that too much is not shared.

Lists of shingles from crowded buckets are dealt over several groups by document; the groups' first
documents meet one another, too. Candidates are cut by an upper bound of the overlap (histograms of
shingle hashes), which is exact, before any text is moved.

Edge cases: null and empty texts and those without words have the empty set, link with nothing
and are their own component; a text of fewer words than n is one shingle; repeated rows and equal
texts share a component; rows of one id with different texts are one document, linked by its largest
set (the larger hash on a tie), though each row has its own n_shingles; rows with a null id are left
out; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.llm.graph import Classes
from codonlake.llm.kernels import LOWER, SPACED, blocks, mix, ngrams, span_hashes, words
from codonlake.llm.session import discard, fewer, sieve, stash, table, tune, whole_texts

_U = np.uint64
#: Buckets of the table of shingle counts and of a document's histogram.
COUNT_BITS, BINS = 17, 256
#: Occurrences of a bucket, over the mean, from which its lists are dealt over groups; and the least such number.
CROWDED, GROUP = 2, 1000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, offs, SPACED)
    h = span_hashes(buf, starts, ends)
    g = ngrams(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:
            yield ngrams(h[a:b], b - a, salt=1) if b > a else h[:0]


def set_hashes(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    if not len(x):
        return 0, 0
    return int(np.add.reduce(mix(x)).view(np.int64)), int(np.bitwise_xor.reduce(mix(x ^ _U(0xA5A5A5A5A5A5A5A5))).view(np.int64))


def bucket(x: np.ndarray) -> np.ndarray:
    return (x >> _U(64 - COUNT_BITS)).astype(np.int64)


def least_overlap(n: int, num: int) -> int:
    """Shingles of a set of ``n`` that any linked set must share: ceil(num / 100 * n)."""
    return -(-num * n // 100)


#: Short lists that a linked pair must meet in (fewer where T is less).
NEED = 2
#: Words of 64 bits in a document's bitmap of shingle hashes.
MAP = 8


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, s1, s2) for each document, s1 and s2 a 128-bit hash of its set, and for each task one row of ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        names = ["doc_id", "n", "s1", "s2", "counts"]
        for batch in batches:
            for a, b, buf, offs in blocks(batch):
                size, s1, s2 = (np.zeros(b - a, np.int64) for _ in range(3))
                for i, x in enumerate(shingle_sets(buf, offs, n)):
                    size[i] = len(x)
                    if len(x):
                        counts += np.bincount(bucket(x), minlength=len(counts)) if len(x) > 20000 else 0
                        if len(x) <= 20000:
                            np.add.at(counts, bucket(x), 1)
                        s1[i], s2[i] = set_hashes(x)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(size), pa.array(s1), pa.array(s2), pa.nulls(b - a, pa.binary())], names)
        if counts.any():
            none = pa.nulls(1, pa.int64())
            yield pa.record_batch([none, none, none, none, pa.array([counts.tobytes()], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, counts binary")


def summed(rows: DataFrame, tasks: int) -> np.ndarray:
    """The sum of the tasks' count tables, 32 at a time; what comes to the driver is one table of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                c = np.frombuffer(x.as_py(), np.int64)
                total = c.copy() if total is None else total + c
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    while tasks > 1:
        tasks = -(-tasks // 32)
        rows = rows.repartition(tasks).mapInArrow(add, "counts binary")
    got = rows.first()
    return np.frombuffer(got.counts, np.int64) if got else np.zeros(1 << COUNT_BITS, np.int64)


def groups_of(counts: np.ndarray) -> np.ndarray:
    """How many groups the lists of each bucket are dealt over."""
    most = max(GROUP, CROWDED * int(counts.sum()) // len(counts))
    return np.maximum(-(-counts // most), 1)


def short_lists(docs: DataFrame, n: int, num: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, s1, s2, short: its rarest shingles, part: the group of each (-1: the only one), bins and map: histogram and bitmap of all)."""
    shared = docs.sparkSession.sparkContext.broadcast((np.minimum(counts, 2**31 - 1).astype(np.int32), np.minimum(groups_of(counts), 2**15).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, groups = shared.value
        for batch in batches:
            for a, b, buf, offs in blocks(batch):
                size, one, two, short, part, bins, maps = [], [], [], [], [], [], []
                for x in shingle_sets(buf, offs, n):
                    k = len(x)
                    t = least_overlap(k, num)
                    take = k - t + min(NEED, t) if k else 0
                    at = bucket(x)
                    order = np.argsort(common[at], kind="stable")[:take]
                    h1, h2 = set_hashes(x)
                    of = groups[at[order]]
                    size.append(k)
                    one.append(h1)
                    two.append(h2)
                    short.append(x[order].view(np.int64))
                    part.append(np.where(of > 1, (h1 & 0x7FFFFFFF) % of, -1).astype(np.int32))
                    bins.append(np.minimum(np.bincount((x & _U(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                    bit = np.zeros(64 * MAP, np.uint8)
                    bit[((x >> _U(8)) & _U(64 * MAP - 1)).astype(np.int64)] = 1
                    maps.append(np.packbits(bit, bitorder="little").view("<i8"))
                upto = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in short])]), pa.int32())
                eight = pa.ListArray.from_arrays(pa.array(MAP * np.arange(len(maps) + 1), pa.int32()), pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64)))
                flat = lambda v, kind: pa.ListArray.from_arrays(upto, pa.array(np.concatenate(v) if v else np.zeros(0, kind)))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), flat(short, np.int64), flat(part, np.int32), pa.array(bins, pa.binary()), eight],
                    ["doc_id", "n", "s1", "s2", "short", "part", "bins", "map"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, short array<long>, part array<int>, bins binary, map array<long>")


def _possible(num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                na, nb = (t.column(i).to_numpy() for i in (2, 3))
                x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
                most = np.minimum(x, y).sum(1, dtype=np.int64)
                most[((x == 255) & (y == 255)).any(1)] = 1 << 40
                ok = most * (100 + num) >= num * (na + nb)
                yield pa.RecordBatch.from_arrays(t.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array(ok))

    return run


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    batch = pa.record_batch([texts.cast(pa.large_string())], ["text"])
    return [x for _, _, buf, offs in blocks(batch) for x in shingle_sets(buf, offs, n)]


def _linked(n: int, num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb, b = (t.column(i).to_numpy() for i in (2, 3, 1))
            # rows come in runs of one b: its set is made once
            lead = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
            run_of = np.searchsorted(lead, np.arange(len(b)), "right") - 1
            theirs, ok = _sets(t.column(5).take(pa.array(lead)), n), []
            for i, x in enumerate(_sets(t.column(4), n)):
                y = theirs[run_of[i]]
                x, y = sorted((x, y), key=len)
                at = np.searchsorted(y, x)  # the binary probes
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
                ok.append({len(x), len(y)} == {int(na[i]), int(nb[i])} and both * (100 + num) >= num * int(na[i] + nb[i]))
            yield pa.RecordBatch.from_arrays(t.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _may_link(x: tuple, y: tuple, num: int):
    """Sizes and places of a shared shingle allow a link; each side is (size, place in its order).

    For the first shingle that two sets share, no more can be shared than what follows it.
    """
    (n, i), (m, j) = x, y
    return (F.least(n, m) * 100 >= F.greatest(n, m) * num) & (F.least(n - i, m - j) * (100 + num) >= (n + m) * num)


class _Search:
    """The candidate rounds of one join."""

    def __init__(self, docs: DataFrame, bins: DataFrame, n: int, num: int):
        self.docs, self.bins, self.n, self.num = docs, bins, n, num
        self.classes, self.degrees = Classes(), None

    def test(self, pairs: DataFrame, count: bool = False) -> None:
        """Merge the classes of the linked ones of ``pairs`` (a, b, na, nb); ``count`` the links of each document."""
        h = self.bins
        bounded = (
            pairs.join(h.select(F.col("doc_id").alias("a"), F.col("bins").alias("ha")), "a")
            .join(h.select(F.col("doc_id").alias("b"), F.col("bins").alias("hb")), "b")
            .select("a", "b", "na", "nb", "ha", "hb")
            .mapInArrow(_possible(self.num), "a long, b long, na long, nb long")
        )
        left = stash(bounded, "possible")
        if left.isEmpty():
            discard(left)
            return
        texts = sieve(self.docs, left.select(F.explode(F.array("a", "b")).alias("doc")), "doc")
        linked = (
            left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "na", "nb", "ta", "tb")
            .mapInArrow(_linked(self.n, self.num), "a long, b long")
        )
        new = stash(linked, "links")
        discard(left)
        if not new.isEmpty():
            self.classes.merge(new)
        if count:
            discard(self.degrees)
            self.degrees = stash(new.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("degree")), "degrees")
        discard(new)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose ends are in different classes."""
        both = self.classes.of(self.classes.of(pairs, "a", "ca"), "b", "cb")
        return both.where("ca != cb").drop("ca", "cb")


def _met(rows: DataFrame, other: str, num: int) -> DataFrame:
    """Pairs (a, b, na, nb) of documents and the struct ``other`` (doc, n, at), counted."""
    o = F.col(other)
    ok = rows.where((F.col("doc") != o["doc"]) & _may_link((F.col("n"), F.col("at")), (o["n"], o["at"]), num))
    return ok.select(F.col("doc").alias("a"), o["doc"].alias("b"), F.col("n").alias("na"), o["n"].alias("nb"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, near_rounds: int = 2) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    docs = whole_texts(docs).where(F.col("doc_id").isNotNull())
    seen = stash(profiles(docs, n), "profiles", scan=True)
    every = seen.where(F.col("doc_id").isNotNull()).drop("counts")
    tables = seen.where(F.col("counts").isNotNull()).select("counts")
    counts = summed(tables, max(1, tables.count()))
    # of rows of one id the largest set stands for the document; of equal sets the smallest id
    one = every.where("n > 0").groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2")).alias("set")).select("doc_id", "set.*")
    first = stash(one.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "reps")
    rows = stash(short_lists(docs, n, num, counts).join(first.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "s1", "s2"], "left_semi").dropDuplicates(["doc_id"]).drop("s1", "s2"), "short")

    entries = rows.select(F.posexplode(F.arrays_zip("short", "part")).alias("at", "x"), F.col("doc_id").alias("doc"), "n")
    entries = entries.select(F.col("x.short").alias("shingle"), F.col("x.part").alias("part"), "doc", "n", F.col("at").cast("int").alias("at"))
    a_list = W.partitionBy("shingle", "part")
    live = stash(entries.withColumns({"size": F.count("*").over(a_list), "head": F.min(F.struct("doc", "n", "at")).over(a_list)}).where("size > 1 or part >= 0"), "live")
    search = _Search(docs, rows.select("doc_id", "bins"), n, num)
    # the groups of a dealt list meet by their first documents
    heads = live.where("part >= 0 and doc = head.doc").select("shingle", "doc", "n", "at")
    tops = heads.join(heads.groupBy("shingle").agg(F.min(F.struct("doc", "n", "at")).alias("top")), "shingle")
    met = stash(_met(live, "head", num).unionByName(_met(tops, "top", num)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("times")), "met")
    # first the partner that a document meets most often, then those that are still apart
    best = met.groupBy("a", "na").agg(F.max(F.struct("times", (-F.col("b")).alias("neg"), "nb")).alias("x"))
    search.test(best.select("a", (-F.col("x.neg")).alias("b"), "na", F.col("x.nb").alias("nb")))
    search.test(search.apart(met.drop("times")))
    discard(met)
    for k in range(near_rounds):
        # in lists of several classes each document meets its neighbours in an order of the list's own: in a group of near
        # copies that is another few documents in every list. Then those with the most links meet the rest of their list
        for hub in (False, True):
            linked = search.classes.of(live.select("shingle", "part", "doc", "n", "at"), "doc", "class")
            mixed = linked.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("shingle")
            linked = linked.join(mixed, "shingle", "left_semi")
            if not hub:
                near = linked.withColumn("near", F.lag(F.struct("doc", "n", "at")).over(a_list.orderBy(F.xxhash64(F.lit(k), "shingle", "doc"))))
            elif search.degrees is None:
                continue
            else:
                most = F.max(F.when(F.col("degree").isNotNull(), F.struct("degree", "doc", "n", "at"))).over(a_list)
                near = linked.join(search.degrees, "doc", "left").withColumn("near", most)
            search.test(search.apart(_met(near.where("near is not null"), "near", num).distinct()), count=not hub)
    # T-occurrence search among documents of different classes
    linked = search.classes.of(live.select("shingle", "doc", "n", "at"), "doc", "class")
    mixed = linked.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("shingle")
    step = 1.000001 * math.log(100 / num)
    maps = rows.select(F.col("doc_id").alias("doc"), *[F.get("map", F.lit(i)).alias(f"m{i}") for i in range(MAP)])
    rest = linked.join(mixed, "shingle", "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    rest = stash(rest.join(maps, "doc"), "rest")
    discard(live)
    words = [f"m{i}" for i in range(MAP)]
    x = rest.select("shingle", *[F.col(c).alias(c + "x") for c in ("doc", "n", "at", "class", *words)], F.explode(F.array(F.col("band") - 1, "band")).alias("band"))
    y = rest.select("shingle", "band", *[F.col(c).alias(c + "y") for c in ("doc", "n", "at", "class", *words)])
    # each pair once: from the larger set, or the larger id, to the other. At the k-th list that two sets share, no more than
    # k - 1 and what follows it can be shared in all: a linked pair passes in its first NEED lists, and is counted there
    reached = f"(100 + {num}) >= (nx + ny) * {num}"
    room = f"({NEED} - 1 + least(nx - atx, ny - aty)) * {reached}"
    # a bit that only one of two sets has stands for a shingle that the other hasn't
    only = lambda s, t: " + ".join(f"bit_count({m}{s} & ~{m}{t})" for m in words)
    maps = f"(nx - ({only('x', 'y')})) * {reached} and (ny - ({only('y', 'x')})) * {reached}"
    pairs = x.join(y, ["shingle", "band"]).where(f"struct(nx, docx) > struct(ny, docy) and classx != classy and ny * 100 >= nx * {num} and {room} and {maps}")
    counted = pairs.groupBy(F.col("docx").alias("a"), F.col("docy").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb")).agg(F.count("*").alias("times"), F.min("atx").alias("ia"), F.min("aty").alias("ib"))
    enough = f"times >= least({NEED}, (nb * {num} + 99) div 100)"
    search.test(counted.where(F.expr(enough) & _may_link((F.col("na"), F.col("ia")), (F.col("nb"), F.col("ib")), num)).select("a", "b", "na", "nb"))
    discard(rest)
    rep = every.join(one.join(first, ["n", "s1", "s2"]).select("doc_id", "rep"), "doc_id", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    out = stash(search.classes.of(rep, "rep", "component").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "components")
    for done in (seen, first, rows, search.classes.rows, search.degrees):
        discard(done)
    return fewer(out)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85)


def brute_force(docs: list[tuple], n: int, num: int) -> dict:
    """doc_id: (n_shingles, component_id) by comparing all pairs that share a shingle; for tests."""
    import re
    from collections import Counter, defaultdict

    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    at, top = defaultdict(list), {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for d in sorted(sets):
        for other, both in Counter(o for s in sets[d] for o in at[s]).items():
            if 100 * both >= num * (len(sets[d]) + len(sets[other]) - both):
                x, y = sorted((root(d), root(other)))
                top[y] = x
        for s in sets[d]:
            at[s].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}
