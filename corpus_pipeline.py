"""A corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Every stage takes all that its predecessor kept, and its decisions take effect. All but
the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import line_quality, near_duplicates, packing, toxicity
from tallyframe.llm.scratch import Scratch

#: Rows up to which the set of rejected rows is broadcast: 8 bytes each.
BROADCAST_IDS = 300_000
#: Words that a packing worker remembers: fewer than by default, as the stages before leave less memory.
REMEMBER = 100_000
#: Rows that are sent to a Python worker at a time. Spark's 10,000 whole texts, on both sides of the pipe, are memory outside the heap that an executor keeps.
BATCH_ROWS = 1000
#: Similarity, in percent, from which documents are near-duplicates here; the query op2 has its own.
PERCENT = 80


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, for this session, as a stage's table is computed after the stage returns; no result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their lines above the limits. Every row is judged for itself."""
    small_batches(spark)
    return line_quality.frequent_lines_removed(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not scored toxic; the score runs along with the row, so nothing is joined. Every row is judged for itself; null and empty
    texts stay, and everything does where the labels do not suffice for a model."""
    small_batches(spark)
    model = toxicity.fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id (rows without an id last). Rows are told apart by a
    number of their own, so repeated rows and rows without an id are members like others; texts without words are copies of nothing."""
    small_batches(spark)
    scratch = Scratch(spark, "dedup")
    rows = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent=PERCENT)
    found = scratch.keep(found.select(F.col("doc_id").alias("_row"), "component_id"), "found")
    # Only groups of several rows need their smallest id.
    several = found.filter(F.col("_row") != F.col("component_id")).select("component_id").distinct()
    members = found.join(several, "component_id", "left_semi").join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    stays = members.groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    gone = scratch.keep(members.select("_row").join(stays, "_row", "left_anti").select(F.col("_row").alias("_gone")), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, rows["_row"] == gone["_gone"], "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences; see :func:`packing.pack` for null, empty, long and repeated texts."""
    small_batches(spark)
    return packing.pack(docs, remember=REMEMBER, rows=256)


STAGES = [("quality rules", quality), ("toxicity", clean), ("near-duplicates", distinct), ("packing", pack)]

#: Minhash components and packing have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), "docs")
    return STAGES[-1][1](spark, docs, sf_dir)
