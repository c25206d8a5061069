"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes every stage's rows to the shared folder and reads them back, so a lost
executor never repeats an earlier stage; what no later stage reads is deleted.

Every row counts, whatever its id: inside a stage a row has a key of its own, which is its doc_id, or
a hash of id and text where the id is null or several rows have it. Rows of one id and different texts
are different documents; equal rows are copies of one another, of which one stays. Null and empty
texts fail the quality rules; in a later stage they stay as they are. Empty tables give empty results.

SQL can't express the method's own verdicts of the first stage nor the last three, so ORACLE_SQL is
None and tests compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm import bpe, decontamination, jaccard_join, quality_rules, substring_dedup
from codonlake.llm.session import discard, stash, table

KEY = "__row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with KEY: equal for equal rows (id and text), different for others."""
    own = F.xxhash64(F.lit("row"), "doc_id", "text")
    again = stash(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(KEY)), "again")
    if again.isEmpty():
        return docs.withColumn(KEY, F.coalesce("doc_id", own))
    marked = docs.join(again, F.col("doc_id") == F.col(KEY), "left")
    return marked.withColumn(KEY, F.when(F.col(KEY).isNotNull() | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; equal rows get the same verdict and all stay or go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) the smallest key stays, of equal rows one.
    Documents without words are in no group."""
    rows = keyed(docs)
    classes = jaccard_join.jaccard_components(rows.select(F.col(KEY).alias("doc_id"), "text"), n=5, num=80)
    gone = stash(classes.where("doc_id != component_id").select(F.col("doc_id").alias(KEY)).distinct(), "gone")
    left = rows.join(gone, KEY, "left_anti")
    if not rows.groupBy(KEY).count().where("count > 1").isEmpty():
        left = left.dropDuplicates([KEY])
    return left.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller key holds are cut out; documents left without a word go."""
    rows = keyed(docs).withColumnRenamed("doc_id", "__doc_id").withColumnRenamed(KEY, "doc_id")
    found = substring_dedup.repeats(rows.select("doc_id", "text"))
    cut = substring_dedup.without_repeats(rows, found).drop("doc_id").withColumnRenamed("__doc_id", "doc_id")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; texts decide, so rows of any id or none do."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    found = decontamination.decontaminate(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = stash(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(KEY)).distinct(), "contaminated")
    return docs.withColumn(KEY, text).join(bad, KEY, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, for every row."""
    return bpe.round_trip(docs.select("doc_id", "text"), bpe.vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, before = stash(stage(spark, docs, sf_dir), name, scan=True), docs
        discard(before)
    return docs
