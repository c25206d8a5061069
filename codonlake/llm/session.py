"""Session helpers: shared scratch tables and bounded samples of labelled rows."""

from __future__ import annotations

import contextlib
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; long texts are cut into smaller blocks again inside the kernels.
ARROW_ROWS = 1000
#: Stashed tables between two looks at the driver's heap, and the share of its limit over which garbage is collected.
LOOK, FULL = 2, 0.5
_stashed = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and the master is local, a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fewer(df: DataFrame) -> DataFrame:
    """``df`` in an eighth of the shuffle partitions, but four for each core at least: narrow rows make small files
    otherwise. Partitions are read one after another, so a task needs no more memory."""
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-shuffle // 8)))


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage if its heap has grown.

    Each query leaves plans, broadcast tables and send buffers of megabytes; where many small ones follow one another
    the JVM would rather grow its heap to the limit. A collection packs what lives, gives memory back and lets
    broadcasts and shuffle files of finished queries be deleted; trim() does the same for memory beside the heap.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > FULL * heap.maxMemory():
        gc.collect()  # plans that only Python's cycles hold
        spark._jvm.System.gc()
        trim(spark)


def trim(spark: SparkSession) -> None:
    """Let the driver's C library give back what the JVM has freed, as ``jcmd PID System.trim_native_heap`` does.

    Compiling the classes of many plans allocates outside the heap, in hundreds of threads, each with free lists that
    the library keeps. A JVM without that command is left as it is.
    """
    jvm = spark._jvm
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # the server's own class isn't exported, so the method is taken from its interface
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(beans, args)


def stash(df: DataFrame, name: str, scan: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors.

    What comes from a shuffle is narrow and goes into fewer() files; a ``scan`` of texts keeps its tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codonlake/{name}-{uuid.uuid4().hex}"
    (df if scan else fewer(df)).write.parquet(path)
    if next(_stashed) % LOOK == 0:
        tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a stashed table that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a run of very long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null as the empty text) and the named columns."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id's text modulo ``k``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(k))


def bounded(df: DataFrame, rows: int, salt: str, key: str = "doc_id") -> DataFrame:
    """A pseudo-random part of ``df`` of about ``rows`` rows, and never over 1.25 times that.

    The share kept comes from a count; which rows are kept depends on the key alone, so reruns agree.
    """
    n = df.count()
    if n <= rows:
        return df
    u = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    return df.where(u < rows / n).limit(rows + rows // 4)


def sieve(docs: DataFrame, ids: DataFrame, column: str, bits: int = 24, rest: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id first) whose id falls on a bit of the ids in ``column``: all with one of those ids, few
    others; with ``rest`` the other rows.

    The bit table is broadcast and has a fixed size (2 MB); in front of a join it keeps most texts
    without a partner out of the shuffle. When it fills up it only lets more through.
    """
    mask = (1 << bits) - 1
    c = F.col(column)
    spot = c.bitwiseXOR(F.shiftrightunsigned(c, 24)).bitwiseXOR(F.shiftrightunsigned(c, 48)).bitwiseAND(F.lit(mask))
    each = ids.select(spot.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w"))
    got = each.agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("x")).toArrow()  # 2^18 rows at most
    words = np.zeros(1 << (bits - 6), "<i8")
    words[got.column(0).to_numpy()] = got.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            b = (x ^ (x >> np.uint64(24)) ^ (x >> np.uint64(48))) & np.uint64(mask)
            bit = (table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(bit == (0 if rest else 1)))

    return docs.mapInArrow(run, docs.schema)
