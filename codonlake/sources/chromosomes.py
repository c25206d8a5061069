"""FASTA files of chromosomes as fragments, without ever holding a whole sequence.

Spark splits the file by bytes wherever it likes. A first pass over the lines makes one row for each split: what it has of
a record that began before it, and of the last one that begins in it. A window over these rows tells each split in which record and at
which base it begins. A second pass cuts the lines of a split into pieces with their places, and a fragment
gathers the pieces that it touches. Most of a task's memory is one fragment; paths go through Spark's own readers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.functions.dna import reverse_complement
from codonlake.operators.signals import FRAGMENT, OVERLAP
from codonlake.sources.scratch import kept

#: Bases of a piece, and rows of splits up to which they are broadcast.
PIECE, FEW = 1 << 15, 100_000
_SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _summaries(lines: DataFrame) -> DataFrame:
    """For each split: records that begin in it, bases before the first of them, bases of the last one, its name."""
    kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("records", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("last", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = (file, block), [0, 0, 0, None]
                if line.startswith(">"):
                    state[0], state[2], state[3] = state[0] + 1, 0, (line[1:].split() or [""])[0]
                else:
                    state[2 if state[0] else 1] += len("".join(line.split()))
        if key is not None:
            done.append((*key, *state))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds.types, strict=True)] if done else [pa.array([], t) for t in kinds.types], schema=kinds)

    return lines.mapInArrow(run, "file string, block long, records long, before long, after long, last string")


def _begun(summaries: DataFrame) -> DataFrame:
    """For each split the record in which it begins (number in its file, name) and how many of its bases lie before."""
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    s = summaries.withColumns({"number": F.coalesce(F.sum("records").over(w), F.lit(0)), "name": F.last(F.when(F.col("records") > 0, F.col("last")), True).over(w)})
    # bases since the last split in which a record began
    g = W.partitionBy("file", "number").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    started = F.last(F.when(F.col("records") > 0, F.col("after")), True).over(w)
    return s.withColumn("offset", F.coalesce(started, F.lit(0)) + F.coalesce(F.sum("before").over(g), F.lit(0))).select(*_SPLIT, "number", "name", "offset")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Rows (locus, file, number, pos, bases): stretches of up to PIECE bases of each record, upper case, with their places from 0.

    Bases before the first record of a file are an error.
    """
    lines = _lines(spark, path)
    begun = kept(_begun(_summaries(lines)), "splits")
    small = begun.count() <= FEW
    both = lines.withColumn("__id", F.monotonically_increasing_id()).join(F.broadcast(begun) if small else begun, _SPLIT)
    both = both if small else both.sortWithinPartitions(*_SPLIT, "__id")
    kinds = pa.schema([("locus", pa.string()), ("file", pa.string()), ("number", pa.int64()), ("pos", pa.int64()), ("bases", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, number, pos, held, size = None, None, 0, 0, [], 0

        def flush() -> tuple | None:
            nonlocal pos, held, size
            text, held, size = "".join(held), [], 0
            at, pos = pos, pos + len(text)
            return (name, key[0], number, at, text) if text else None

        for batch in batches:
            done = []
            for file, block, line, n, own, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != key:
                    done.append(flush() if key else None)
                    key, name, number, pos = (file, block), own, n, offset
                if line.startswith(">"):
                    done.append(flush())
                    name, number, pos = (line[1:].split() or [""])[0], number + 1, 0
                    continue
                bases = "".join(line.split()).upper()
                if bases and name is None:
                    raise ValueError("a FASTA file starts with >")
                held.append(bases)
                size += len(bases)
                if size >= PIECE:
                    done.append(flush())
            rows = [x for x in done if x]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)] if rows else [pa.array([], t) for t in kinds.types], schema=kinds)
        last = flush() if key else None
        if last:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(last, kinds.types, strict=True)], schema=kinds)

    return both.select(*_SPLIT, "value", "number", "name", "offset").mapInArrow(run, "locus string, file string, number long, pos long, bases string")


def read_fragments(spark: SparkSession, path: str, fragment: int = FRAGMENT, overlap: int = OVERLAP, strands: str = "+-") -> DataFrame:
    """Rows (locus, length, frag, strand, l1, l2, seq) as ``fragments`` makes them of whole sequences."""
    hop = fragment - overlap
    p = kept(pieces(spark, path), "pieces")
    record = ["locus", "file", "number"]
    length = p.groupBy(*record).agg(F.max(F.col("pos") + F.length("bases")).cast("long").alias("length"))
    p = p.join(length, record).withColumn("most", F.greatest(F.lit(0), F.floor((F.col("length") - 1 - overlap) / hop)).cast("long"))
    end = F.col("pos") + F.length("bases")
    lo = F.least(F.greatest(F.lit(0), F.ceil((F.col("pos") - fragment + 1) / hop)), F.col("most")).cast("long")
    hi = F.least(F.floor((end - 1) / hop), F.col("most")).cast("long")
    touched = p.withColumn("frag", F.explode(F.sequence(lo, hi)))
    cut = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "bases"))), lambda x: x["bases"]), "")
    f = touched.groupBy(*record, "length", "frag").agg(F.min("pos").alias("from"), cut.alias("text"))
    f = f.withColumns({"a": F.col("frag") * hop, "end": F.least(F.col("frag") * hop + fragment, "length")})
    f = f.withColumn("seq", F.substring("text", (F.col("a") - F.col("from") + 1).cast("int"), (F.col("end") - F.col("a")).cast("int")))
    both = f.withColumn("strand", F.explode(F.array(*[F.lit(s) for s in strands])))
    back = F.col("strand") == "-"
    return both.select(
        "locus", "length", "frag", "strand", F.when(back, F.col("length") - F.col("end")).otherwise(F.col("a")).alias("l1"), (F.when(back, F.col("length") - F.col("a")).otherwise(F.col("end")) - 1).alias("l2"),
        F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
    )
