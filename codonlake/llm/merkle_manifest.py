"""Merkle manifest of a dataset: a postorder append log written by aligned builders.

Every row is a leaf, the SHA-256 of its length-prefixed values. The leaves of a partition value (the
language) ascend by id; every two consecutive nodes become the hash of their digests' hex text,
and so on until one is left (a run that is cut off at the end, even of one node, is hashed too).
The subroots form a tree of their own in the order of their partition values.

The log holds nodes in the order in which they are completed, children before their parent. The
place of a node follows from its level and index alone: ``position()``. So a
builder that owns an aligned block of 2^HEIGHT leaves writes its nodes without knowing the others,
and the sibling of any node is found by arithmetic instead of a search. Blocks are rows; their roots
are the leaves of the next band of blocks, until one node is left: a hundred billion leaves take
four bands. Proofs run the other way, from the top band down: a block's row gets the path
above it by a join, and each leaf adds the siblings inside its block.

Leaves get their index in the tree from one range shuffle by (partition value, id): tasks number
their rows, and the counts of earlier tasks are added. No task holds more than one block or reads
more than its share, whatever the sizes of the partitions.

Edge cases: a null value is ``-``; null partition values come first, null ids before others; rows of
one id are ordered by their leaves, so equal rows give the same tree in any order; an empty table gives an empty
result; extra columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.llm.session import discard, stash, table, tune

#: Levels of a block: it has 2^HEIGHT leaves and no more than twice as many nodes.
HEIGHT = 10
#: Bytes of a digest in the log (hex text).
WIDE = 64


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*text), 256)


def position(level: int, index: int, leaves: int) -> int:
    """The place in postorder of node ``index`` of ``level`` in a tree over ``leaves`` leaves.

    Before a complete node come all nodes of the leaves left of it, 2 m - popcount(m) for m leaves, and its own
    2^(level + 1) - 2 descendants. The nodes that the end cuts off come last, from low to high.
    """
    m = index << level
    if m + (1 << level) <= leaves:
        return 2 * m - m.bit_count() + (2 << level) - 2
    first = (leaves & -leaves).bit_length()  # the lowest level that the end cuts off
    return 2 * leaves - leaves.bit_count() + level - first


def height_of(leaves: int) -> int:
    return (leaves - 1).bit_length()


def append(leaves: list[bytes], height: int) -> bytes:
    """The log of one block: digests in the order in which nodes are completed, up to ``height``."""
    log, open_ = [], []  # open_: for each level the left node that waits for its sibling, or None
    for one in leaves:
        log.append(one)
        for level in range(height):
            if level == len(open_):
                open_.append(None)
            if open_[level] is None:
                open_[level] = one
                break
            one, open_[level] = sha256(open_[level] + one).hexdigest().encode(), None
            log.append(one)
    # close what the end cuts off
    right = None
    for level in range(height):
        left = open_[level] if level < len(open_) else None
        if left is not None or right is not None:
            right = sha256((left or b"") + (right or b"")).hexdigest().encode()
            log.append(right)
    return b"".join(log)


def siblings(log: bytes, index: int, leaves: int, height: int) -> list[tuple[bool, bytes | None]]:
    """For each level of a block: whether the sibling is the left one, and its digest (None: alone in its run)."""
    out = []
    for level in range(height):
        at = (index >> level) ^ 1
        if at << level < leaves:
            p = WIDE * position(level, at, leaves)
            out.append((at < index >> level, log[p : p + WIDE]))
        else:
            out.append((False, None))
    return out


def pack(path: list[tuple[bool, bytes | None]]) -> bytes:
    """A path as bytes: for each level L, R or - and the digest."""
    return b"".join(b"-" if d is None else (b"L" if left else b"R") + d for left, d in path)


def unpack(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    k = 0
    while k < len(path):
        side = path[k : k + 1]
        n = 0 if side == b"-" else WIDE
        yield side, path[k + 1 : k + 1 + n]
        k += 1 + n


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for side, d in path:
        leaf = sha256(d + leaf if side == b"L" else leaf + d).hexdigest().encode()
    return leaf


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, leaf, ...) with ``index`` (from 0 in its tree by ``order``) and ``n``, the leaves of the tree.

    One range shuffle; tasks number what they have of each tree, counts of the tasks before are added.
    """
    spark = leaves.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *order]
    dealt = leaves.repartitionByRange(tasks, *by).sortWithinPartitions(*by)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            index = []
            for t in batch.column(0).to_pylist():
                at = at + 1 if t == last else 0
                last = t
                index.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(index), pa.int64()), pa.array(index, pa.int64())], [*batch.schema.names, "task", "nth"])

    kinds = ", ".join(f"{c} {k}" for c, k in leaves.dtypes)
    rows = stash(dealt.select("tree", *[c for c in leaves.columns if c != "tree"]).mapInArrow(number, f"tree string, {kinds.replace('tree string, ', '')}, task long, nth long"), "ranked", scan=True)
    parts = rows.groupBy("tree", "task").agg(F.count("*").alias("k"))
    w = W.partitionBy("tree").orderBy("task")
    parts = parts.select("tree", "task", (F.sum("k").over(w) - F.col("k")).alias("before"), F.sum("k").over(W.partitionBy("tree")).alias("n"))
    out = rows.join(parts, ["tree", "task"]).withColumn("index", F.col("before") + F.col("nth")).drop("task", "nth", "before")
    out._stash_path = rows._stash_path
    return out


class Manifest:
    """The bands of a forest, lowest first: each a table (tree, block, n, log, extra...) with a row for each block."""

    def __init__(self, leaves: DataFrame, extra: list[str], height: int = HEIGHT):
        """``leaves``: (tree, index, n, leaf, *extra); ``extra`` are columns of type string or long that blocks keep for each leaf."""
        self.height = height
        self.bands = [self._band(leaves, extra, "band0")]
        while not self.bands[-1].where("n > len").isEmpty():  # some tree has several blocks
            now = self.bands[-1]
            up = now.where("n > len").select("tree", F.col("block").alias("index"), F.ceil(F.col("n") / (1 << self.height)).cast("long").alias("n"), F.col("top").alias("leaf"))
            self.bands.append(self._band(up, [], f"band{len(self.bands)}"))

    def _band(self, leaves: DataFrame, extra: list[str], name: str) -> DataFrame:
        kinds, most = dict(leaves.dtypes), self.height

        def build(t: pa.Table) -> pa.Table:
            t = t.sort_by("index")
            got, n = t.column("leaf").to_pylist(), t.column("n")[0].as_py()
            log = append([x.encode() for x in got], height_of(n) if n == len(got) else most)
            cols = {"tree": [t.column("tree")[0].as_py()], "block": [t.column("index")[0].as_py() >> most], "n": [n], "len": [len(got)], "log": [log], "top": [log[-WIDE:].decode()]}
            cols |= {c: [t.column(c).to_pylist()] for c in extra}
            return pa.table(cols, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("len", pa.int64()), ("log", pa.binary()), ("top", pa.string()), *[(c, pa.list_(pa.string() if kinds[c] == "string" else pa.int64())) for c in extra]]))

        rows = leaves.withColumn("__block", F.shiftright("index", most)).groupBy("tree", "__block")
        more = "".join(f", {c} array<{kinds[c]}>" for c in extra)
        return stash(rows.applyInArrow(build, f"tree string, block long, n long, len long, log binary, top string{more}"), name, scan=True)

    def roots(self) -> DataFrame:
        """(tree, root): the top of each tree is in the one band in which it has a single block."""
        out = None
        for band in self.bands:
            one = band.where("n = len").select("tree", F.col("top").alias("root"))
            out = one if out is None else out.unionByName(one)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The lowest band with ``path`` and ``root`` of each block's top, from ``above`` (tree, path, root)."""
        known = None
        for band in reversed(self.bands):
            new = band.where("n = len").join(above, "tree")
            if known is not None:
                new = new.unionByName(band.where("n > len").join(known, ["tree", "block"]))
            if band is self.bands[0]:
                return new
            last, known = known, stash(new.mapInArrow(_down(self.height), "tree string, block long, path binary, root string"), "paths")
            discard(last)
        raise AssertionError

    def log(self) -> DataFrame:
        """Rows (tree, position, digest) of the lowest band's nodes: the postorder place among the nodes of its blocks."""
        from_ = F.posexplode(F.expr(f"transform(sequence(0, length(log) div {WIDE} - 1), i -> decode(substring(log, i * {WIDE} + 1, {WIDE}), 'UTF-8'))")).alias("at", "digest")
        return self.bands[0].select("tree", "block", from_).select("tree", (F.col("block") * ((2 << self.height) - 1) + F.col("at")).alias("position"), "digest")

    def close(self, above: int = 0) -> None:
        """Delete the bands from ``above`` on."""
        for band in self.bands[above:]:
            discard(band)


def _down(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From blocks with the path above them to the path above each of their leaves, which are blocks of the band below."""
        for batch in batches:
            col = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            out: dict[str, list] = {"tree": [], "block": [], "path": [], "root": []}
            for tree, block, n, size, log, path, root in zip(*(col[c] for c in ("tree", "block", "n", "len", "log", "path", "root")), strict=True):
                for i in range(size):
                    out["tree"].append(tree)
                    out["block"].append((block << most) + i)
                    out["path"].append(pack(siblings(log, i, size, height_of(n) if n == size else most)) + path)
                    out["root"].append(root)
            yield pa.record_batch(list(map(pa.array, out.values(), (pa.string(), pa.int64(), pa.binary(), pa.string()))), list(out))

    return run


def _proofs(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                n, size, log, path, root, subroot = (col[c][k].as_py() for c in ("n", "len", "log", "path", "root", "subroot"))
                ids, forged = col["doc_id"][k].as_py(), col["forged"][k].as_py()
                height, above = height_of(n) if n == size else most, list(unpack(path))
                out: dict[str, list] = {c: [] for c in kinds}
                for i in range(size):
                    at = WIDE * position(0, i, size)
                    leaf = log[at : at + WIDE]
                    own = [*unpack(pack(siblings(log, i, size, height))), *above]
                    folded = fold(forged[i].encode() if forged[i] else leaf, own).decode()
                    row = (ids[i], leaf.decode(), subroot, root, sha256(b"".join(d for _, d in own)).hexdigest(), folded, folded == root)
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
                yield pa.record_batch([pa.array(v, kinds[c]) for c, v in out.items()], list(out))

    return run


def manifest(leaves: DataFrame, order: list[str], extra: list[str], height: int = HEIGHT) -> Manifest:
    """The logs of the trees of ``leaves`` (tree string, leaf string, *order, *extra)."""
    rows = ranked(leaves, order)
    out = Manifest(rows.select("tree", "index", "n", "leaf", *extra), extra, height)
    discard(rows)
    return out


def prove(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The result of op13 for ``docs`` (doc_id, source, lang, n_chars, text)."""
    tune(docs.sparkSession)
    forged = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    leaf = lambda n: digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    narrow = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("n_chars")).alias("leaf"),
        F.when(forged & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1)).alias("forged"),
    )
    leaves = stash(narrow, "leaves", scan=True)  # a range shuffle reads its input twice: texts are read once
    low = manifest(leaves, ["doc_id", "leaf"], ["doc_id", "forged"], height)
    discard(leaves)
    # the subroots are the leaves of one more tree, in the order of their partition values
    subroots = stash(low.roots(), "subroots")
    top = manifest(subroots.select(F.lit("").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("name")), ["name"], ["name"], height)
    whole = top.roots().select("tree", F.lit(b"").alias("path"), "root")
    over = top.paths(whole).mapInArrow(_named(height), "tree string, path binary, root string, subroot string")
    over = stash(over, "over")
    top.close()
    discard(subroots)
    known = low.paths(over.select("tree", "path", "root"))
    low.close(above=1)
    rows = known.join(over.select("tree", "subroot"), "tree").select("n", "len", "log", "path", "root", "subroot", "doc_id", "forged")
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.mapInArrow(_proofs(height), kinds)


def _named(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tree, path, root, subroot) of each subroot from the top tree's blocks."""
        for batch in batches:
            col = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            out: dict[str, list] = {"tree": [], "path": [], "root": [], "subroot": []}
            for n, size, log, path, root, names in zip(*(col[c] for c in ("n", "len", "log", "path", "root", "name")), strict=True):
                for i in range(size):
                    at = WIDE * position(0, i, size)
                    out["tree"].append(names[i])
                    out["path"].append(pack(siblings(log, i, size, height_of(n) if n == size else most)) + path)
                    out["root"].append(root)
                    out["subroot"].append(log[at : at + WIDE].decode())
            yield pa.record_batch(list(map(pa.array, out.values(), (pa.string(), pa.binary(), pa.string(), pa.string()))), list(out))

    return run


#: crc32 of a value's text in SQL, from the table of its polynomial.
CRC_SQL = """
poly AS (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) x(n)),
"""
CRC32 = "xor(list_reduce([4294967295] || list_transform(string_split({x}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295)"
OP13_SQL = (
    "WITH RECURSIVE "
    + CRC_SQL
    + """
raw AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, """
    + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang"))
    + """ AS head, n_chars, coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-') AS tail, """
    + CRC32.format(x="doc_id")
    + """ % 7 = 0 AS forge FROM documents, poly),
hashed AS (SELECT doc_id, tree, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN forge AND n_chars IS NOT NULL THEN sha256(head || length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS forged FROM raw),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
nodes AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n),
subs AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, n, h FROM subs
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
low AS (SELECT doc_id, leaf, tree, i AS k, 0 AS level, i, n, coalesce(forged, leaf) AS f, '' AS proof FROM leaves
  UNION ALL SELECT l.doc_id, l.leaf, l.tree, l.k, l.level + 1, l.i // 2, (l.n + 1) // 2,
    CASE WHEN s.h IS NULL THEN sha256(l.f) WHEN l.i % 2 = 1 THEN sha256(s.h || l.f) ELSE sha256(l.f || s.h) END, l.proof || coalesce(s.h, '')
  FROM low l LEFT JOIN nodes s ON s.tree = l.tree AND s.level = l.level AND s.i = xor(l.i, 1) WHERE l.n > 1),
up AS (SELECT l.doc_id, l.leaf, s.h AS subroot, l.tree, l.k, 0 AS level, s.i, s.n, l.f, l.proof FROM low l JOIN subs s ON s.name = l.tree WHERE l.n = 1
  UNION ALL SELECT l.doc_id, l.leaf, l.subroot, l.tree, l.k, l.level + 1, l.i // 2, (l.n + 1) // 2,
    CASE WHEN s.h IS NULL THEN sha256(l.f) WHEN l.i % 2 = 1 THEN sha256(s.h || l.f) ELSE sha256(l.f || s.h) END, l.proof || coalesce(s.h, '')
  FROM up l LEFT JOIN tops s ON s.level = l.level AND s.i = xor(l.i, 1) WHERE l.n > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM up, (SELECT h FROM tops WHERE n = 1) r WHERE up.n = 1
"""
)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove(table(spark, sf_dir, "documents"))
