"""Prefix trie of conversations as a z-fast trie: a table of compacted nodes hashed at two-fattest depths.

A conversation is the path of its prefix hashes: 128 bits for each number of first turns. A compacted
node is a row (lo, hi, top, up, path, words): the edge from depth ``lo`` to its extent's depth ``hi``
with the prefix hashes and running word counts of the depths on it. Its handle is the prefix hash at the
two-fattest depth of the edge, the number in (lo, hi] that is divisible by the highest power of two.

* ``locate`` finds the exit node of each path by fat binary search: a round joins the prefix hash at the
  two-fattest depth of what is still open with the handles and halves it, so log2(depth) joins
  find what a walk would find in one join for each turn. The child below the last node that matches is found by
  its first prefix hash, and the length of what is shared on its edge by the hashes of both.
* ``insert`` takes a batch of located paths: edges are cut where paths leave or end, what is left of the
  paths is compacted (a depth stays where paths part or end), and equal edges become one. Batches grow,
  so the prefixes that many conversations share are in the trie before most of them arrive and are
  not expanded again.
* Counts of subtrees are summed over the compacted nodes by doubled jumps to ancestors, log2(depth) rounds
  of joins and sums; conversations that are equal are one path with a count.
* Edges are expanded to nodes, one for each depth, at the end: on an edge only the saved words change.

Words saved: over the subtree of a node, sum of (members - 1) * words of a node = for all members the words behind the
node, less the words of all nodes there. Both are sums over compacted nodes.

The digest of the members that end at a node is sequential by nature. Their ids are joined in blocks of 4096 consecutive numbers
first; a node with more than one block has them streamed in order through one hash, in constant memory.

Edge cases: null roles and texts are empty; null turns come first; turns of one number are in the order of
a hash of their role and text; rows with a null conv_id are left out; a conversation whose base is
missing starts with its own turns; one without turns is a member of the root only; an empty table has no
nodes; extra columns are ignored. The turns of one conversation are the unit of work (32 bytes each).
Prefixes are told apart by 128-bit hashes, which aren't made for hostile input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm.kernels import mix
from codonlake.llm.merkle_manifest import CRC32, CRC_SQL
from codonlake.llm.session import discard, stash, table, tune

_U = np.uint64
#: Conversation numbers of a block of joined ids.
BLOCK_IDS = 4096
#: Shares of the paths that the trie holds after each batch.
BATCHES = (0.1, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
#: The hash of no turns, of the root.
ROOT = b""
NODE = ["top", "up", "lo", "hi", "before", "path", "words"]


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that is divisible by the highest power of two."""
    bits = F.length(F.bin(a.cast("long").bitwiseXOR(b.cast("long")))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b.cast("long"), bits), bits).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 20, then the own turns after the first h; h = crc32(c) % 4."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = stash(own, "turns")
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left").withColumn("h", h)
    seq = F.when(F.col("conv_id") == F.col("base"), F.col("turns")).otherwise(F.concat(F.expr("slice(coalesce(head, slice(turns, 1, 0)), 1, h)"), F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")))
    out = both.select("conv_id", seq.alias("turns"))
    out._stash_path = own._stash_path
    return out


def paths(seqs: DataFrame) -> DataFrame:
    """(conv_id, m, path, words): prefix hashes and running word counts of (conv_id, turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).combine_chunks() if hasattr(batch.column(1), "combine_chunks") else batch.column(1)
            upto = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(upto[0], upto[-1] - upto[0])
            upto = upto - upto[0]
            sizes = np.diff(upto)
            at = (np.arange(len(flat)) - np.repeat(upto[:-1], sizes)).astype(_U)
            place = mix(at * _U(0x9E3779B97F4A7C15) + _U(1))

            def running(x: np.ndarray) -> np.ndarray:
                total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
                return total[1:] - np.repeat(total[upto[:-1]], sizes)

            a, b = (np.ascontiguousarray(flat.field(c).to_numpy()).view(_U) for c in ("a", "b"))
            hashes = np.stack([running(mix(a ^ place)), running(mix(b + place))], 1)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(np.ascontiguousarray(hashes))]).cast(pa.binary())
            cut = pa.array(upto, pa.int32())
            words = running(flat.field("w").to_numpy().astype(np.int64))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(cut, raw), pa.ListArray.from_arrays(cut, pa.array(words))], ["conv_id", "m", "path", "words"])

    return seqs.mapInArrow(run, "conv_id long, m int, path array<binary>, words array<long>")


def classes(seqs: DataFrame) -> DataFrame:
    """One row (end, m, path, words, n, low, ends) for all conversations of one path: their number, smallest id and digest."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    bucket = F.floor(F.col("conv_id") / BLOCK_IDS).cast("long")
    end = F.coalesce(F.get("path", F.col("m") - 1), F.lit(ROOT))
    same = lambda c: F.first(c).alias(c)
    blocks = stash(seqs.groupBy(end.alias("end"), bucket.alias("bucket")).agg(same("m"), same("path"), same("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"), ids.alias("ids")), "blocks")
    whole = blocks.groupBy("end").agg(same("m"), same("path"), same("words"), F.sum("n").alias("n"), F.min("low").alias("low"), F.count("*").alias("blocks"), F.first("ids").alias("ids"))
    whole = stash(whole, "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        kinds = pa.schema([("end", pa.binary()), ("streamed", pa.string())])
        for batch in batches:
            done: list[tuple] = []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and end == last:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = end, hashlib.sha256(ids.encode())
            yield pa.record_batch(list(map(pa.array, zip(*done, strict=True), kinds.types)) if done else [pa.array([], t) for t in kinds.types], schema=kinds)
        if state is not None:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], schema=kinds)

    many = whole.where("blocks > 1").select("end")
    tasks = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("end", "bucket", "ids").join(many, "end", "left_semi").repartition(tasks, "end").sortWithinPartitions("end", "bucket")
    streamed = dealt.mapInArrow(run, "end binary, streamed string")
    out = stash(whole.join(streamed, "end", "left").select("end", "m", "path", "words", "n", "low", F.coalesce("streamed", F.sha2(F.col("ids").cast("binary"), 256)).alias("ends")), "classes")
    discard(blocks)
    discard(whole)
    return out


def locate(trie: DataFrame | None, seqs: DataFrame, deepest: int) -> DataFrame:
    """``seqs`` (end, m, path, words) with ``l``, how many turns the trie has of each, and ``edge``, the node on whose edge it leaves (null: at a node)."""
    if trie is None:
        return seqs.withColumns({"l": F.lit(0), "edge": F.lit(None).cast("binary")})
    f = two_fattest(F.col("lo"), F.col("hi"))
    handles = trie.select(F.get("path", f - F.col("lo") - 1).alias("key"), F.col("hi").alias("__hi"), F.col("top").alias("__top"))
    now = seqs.withColumns({"a": F.lit(0), "b": F.col("m"), "edge": F.lit(None).cast("binary")})
    for _ in range(deepest.bit_length()):
        open_ = F.col("edge").isNull() & (F.col("a") < F.col("b"))
        now = now.withColumn("f", F.when(open_, two_fattest(F.col("a"), F.col("b")))).withColumn("key", F.get("path", F.col("f") - 1))
        now = now.join(handles, "key", "left")
        found = F.col("__top").isNotNull()
        inside = found & (F.col("__hi") <= F.col("m")) & (F.get("path", F.col("__hi") - 1) == F.col("__top"))
        now = now.withColumns({"a": F.when(inside, F.col("__hi")).otherwise(F.col("a")), "b": F.when(F.col("f").isNotNull() & ~found, F.col("f") - 1).otherwise(F.col("b")), "edge": F.when(found & ~inside, F.col("__top")).otherwise(F.col("edge"))}).drop("key", "f", "__hi", "__top")
    first = trie.select(F.get("path", F.lit(0)).alias("key"), F.col("top").alias("__top"))
    now = now.withColumn("key", F.when(F.col("edge").isNull() & (F.col("a") < F.col("m")), F.get("path", "a"))).join(first, "key", "left").withColumn("edge", F.coalesce("edge", "__top")).drop("key", "__top", "b")
    edges = trie.select(F.col("top").alias("edge"), F.col("lo").alias("__lo"), F.col("path").alias("__path"))
    shared = F.size(F.array_intersect("__path", F.expr("slice(path, __lo + 1, greatest(least(size(__path), m - __lo), 0))")))
    return now.join(edges, "edge", "left").withColumn("l", F.when(F.col("edge").isNotNull(), F.col("__lo") + shared).otherwise(F.col("a"))).drop("a", "__lo", "__path")


def _pieces(rows: DataFrame, cuts: str) -> DataFrame:
    """The edges (NODE) of ``rows`` (up, lo, hi, before, path, words) cut at the sorted depths of the array column ``cuts``, which end with hi."""
    one = rows.select("*", F.posexplode(cuts).alias("__k", "__y")).withColumn("__x", F.coalesce(F.expr(f"get({cuts}, __k - 1)"), F.col("lo")))
    part = lambda c: F.expr(f"slice({c}, __x - lo + 1, __y - __x)")
    inner = F.col("__x") > F.col("lo")
    at = F.expr("__x - lo - 1")
    return one.select(
        F.get("path", F.expr("__y - lo - 1")).alias("top"),
        F.when(inner, F.get("path", at)).otherwise(F.col("up")).alias("up"),
        F.col("__x").alias("lo"),
        F.col("__y").alias("hi"),
        F.when(inner, F.get("words", at)).otherwise(F.col("before")).alias("before"),
        part("path").alias("path"),
        part("words").alias("words"),
    )


def insert(trie: DataFrame | None, exits: DataFrame) -> DataFrame:
    """The trie with the located paths of a batch."""
    exits = stash(exits, "exits")
    tails = exits.where("m > l").select(
        "end",
        F.when(F.col("l") > 0, F.get("path", F.col("l") - 1)).otherwise(F.lit(ROOT)).alias("up"),
        F.col("l").alias("lo"),
        F.col("m").alias("hi"),
        F.when(F.col("l") > 0, F.get("words", F.col("l") - 1)).otherwise(F.lit(0)).alias("before"),
        F.expr("slice(path, l + 1, m - l)").alias("path"),
        F.expr("slice(words, l + 1, m - l)").alias("words"),
    )
    # depths where two tails part or one of them ends inside another
    steps = tails.select("end", "lo", F.posexplode("path").alias("k", "node"), "path").select("end", F.expr("lo + k + 1").alias("depth"), "node", F.expr("get(path, k + 1)").alias("next"))
    met = steps.groupBy("node").agg(F.count("*").alias("n"), F.count("next").alias("on"), F.min("next").alias("low"), F.max("next").alias("high"))
    kept = met.where("n > 1 and (on < n or low != high)").select("node")
    cuts = steps.join(kept, "node").groupBy("end").agg(F.collect_set("depth").alias("cuts"))
    cut = tails.join(cuts, "end", "left").withColumn("cuts", F.sort_array(F.array_union(F.coalesce("cuts", F.array().cast("array<int>")), F.array("hi"))))
    same = F.first(F.struct(*NODE[1:])).alias("x")
    new = _pieces(cut, "cuts").groupBy("top").agg(same).select("top", *[f"x.{c}" for c in NODE[1:]])
    if trie is not None:
        left = exits.where("edge is not null").select(F.col("edge").alias("top"), "l").distinct().groupBy("top").agg(F.collect_set("l").alias("cuts"))
        old = trie.join(left, "top", "left").withColumn("cuts", F.sort_array(F.array_union(F.expr("filter(coalesce(cuts, array()), x -> x > lo and x < hi)"), F.array("hi"))))
        new = new.unionByName(_pieces(old, "cuts"))
    out = stash(new.select(*NODE), "trie")
    discard(exits)
    discard(trie)
    return out


def build(seqs: DataFrame, shares: tuple[float, ...] = BATCHES) -> DataFrame:
    """The z-fast trie of distinct paths (end, m, path, words), inserted batch by batch."""
    deepest = seqs.agg(F.max("m")).first()[0] or 0
    place = F.pmod(F.xxhash64("end"), F.lit(1 << 20)) / float(1 << 20)
    trie, low = None, 0.0
    for high in shares:
        batch = seqs.where((place >= low) & (place < high) & (F.col("m") > 0)).select("end", "m", "path", "words")
        trie, low = insert(trie, locate(trie, batch, deepest)), high
    return trie


SUMS = ["n", "d", "w", "leaves"]


def subtrees(values: DataFrame) -> DataFrame:
    """``values`` (top, up, low, *SUMS) with the sums and the smallest ``low`` of each node's subtree: jumps to ancestors double."""
    now = stash(values.withColumn("jump", F.when(F.length("up") > 0, F.col("up"))).select("top", "jump", "low", *SUMS), "sums")
    while not now.where("jump is not null").isEmpty():
        below = now.where("jump is not null").groupBy(F.col("jump").alias("top")).agg(F.min("low").alias("__low"), *[F.sum(c).alias(f"__{c}") for c in SUMS])
        over = now.where("jump is not null").select(F.col("top").alias("__top"), F.col("jump").alias("__jump"))
        got = now.join(below, "top", "left").join(over, F.col("jump") == F.col("__top"), "left")
        new = stash(got.select("top", F.col("__jump").alias("jump"), F.least("low", "__low").alias("low"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in SUMS]), "sums")
        discard(now)
        now = new
    return now.drop("jump")


def nodes(conversations: DataFrame, shares: tuple[float, ...] = BATCHES) -> DataFrame:
    """The result of op11: a row for each distinct prefix of the rebuilt conversations."""
    tune(conversations.sparkSession)
    turns = rebuilt(conversations)
    ended = classes(paths(turns))
    discard(turns)
    trie = build(ended, shares)
    last = F.element_at("words", -1)
    kids = trie.groupBy(F.col("up").alias("top")).agg(F.count("*").alias("kids"))
    known = ended.select(F.col("end").alias("top"), "n", "low", "ends")
    values = trie.select("top", "up", last.alias("all"), (last - F.col("before")).alias("w")).join(known, "top", "left").join(kids, "top", "left")
    n = F.coalesce("n", F.lit(0))
    values = stash(values.select("top", "up", n.alias("n"), (n * F.col("all")).alias("d"), "w", F.col("kids").isNull().cast("long").alias("leaves"), "low", "ends", F.coalesce("kids", F.lit(0)).alias("kids")), "values")
    sums = subtrees(values)

    none = F.sha2(F.lit(b""), 256)
    top = values.agg(F.sum("d").alias("d"), F.sum("w").alias("w"), F.sum("leaves").alias("leaves"), F.count_if(F.length("up") == 0).alias("kids"))
    total = ended.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max(F.when(F.col("m") == 0, F.col("ends"))).alias("ends")).first()
    root_low = F.lit(total.low).cast("long")
    root = top.select(
        root_low.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total.n).cast("long").alias("n_convs"), F.col("kids").alias("n_children"),
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.col("d") - F.col("w"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.lit(total.ends), none).alias("ends_sha256"),
    ).where(F.col("conv_id").isNotNull())

    parents = sums.select(F.col("top").alias("up"), F.col("low").alias("parent"))
    mine = sums.select("top", "low", *[F.col(c).alias(f"s_{c}") for c in SUMS])
    edges = trie.join(mine, "top").join(values.select("top", "w", "ends", "kids"), "top").join(parents, "up", "left")
    edges = edges.withColumns({"all": last, "below": F.col("s_d") - F.col("s_n") * last - (F.col("s_w") - F.col("w"))})
    each = edges.select("*", F.posexplode("words").alias("k", "upto")).withColumn("depth", F.expr("lo + k + 1"))
    end = F.col("depth") == F.col("hi")
    before = F.coalesce(F.expr("get(words, k - 1)"), F.col("before"))
    rows = each.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("k") > 0, F.col("low")).otherwise(F.coalesce("parent", root_low)).alias("parent_conv_id"), F.col("s_n").alias("n_convs"), F.when(end, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("s_leaves").alias("n_leaves"), ((F.col("s_n") - 1) * (F.col("all") - before) + F.col("below")).alias("saved_tokens"), F.when(end, F.coalesce("ends", none)).otherwise(none).alias("ends_sha256"),
    )
    return rows.unionByName(root)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "conversations"))


#: Every prefix as a row, joined with all its ancestors.
OP11_SQL = (
    "WITH "
    + CRC_SQL
    + r"""
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, """
    + CRC32.format(x="c")
    + r""" % 4 AS h FROM t, poly),
parts AS (SELECT ids.c, 0 AS part, t.i, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.i <= h
  UNION ALL SELECT ids.c, 1, t.i, role, text FROM ids JOIN t ON t.c = ids.c AND t.i > h),
seqs AS (SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
  sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, ',') OVER (PARTITION BY c ORDER BY part, i ROWS UNBOUNDED PRECEDING)) AS p
  FROM parts WINDOW w AS (PARTITION BY c ORDER BY part, i)),
steps AS (SELECT c, d, words, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS up, lead(p) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM seqs
  UNION ALL SELECT ids.c, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM seqs WHERE seqs.c = ids.c) FROM ids),
nodes AS (SELECT p, d, min(c) AS c, min(up) AS up, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM steps GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY up),
below AS (SELECT a.p, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (n.p NOT IN (SELECT p FROM kids)) AS leaves
  FROM nodes n JOIN steps a ON a.c = n.c AND a.d <= n.d GROUP BY a.p)
SELECT n.c AS conv_id, n.d AS depth, m.c AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below USING (p) LEFT JOIN kids USING (p) LEFT JOIN nodes m ON m.p = n.up
"""
)
