"""Stored results: the response cache, analyses, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_responses(fresh: DataFrame, path: str) -> DataFrame:
    """Add responses (``request_key`` and whatever goes with it) that the cache at ``path`` lacks; returns the cache.

    A key is stored once, whichever of its responses comes first by their JSON; what is stored already stays.
    """
    spark = fresh.sparkSession
    new = fresh.groupBy("request_key").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "request_key"]), F.to_json(F.struct(*fresh.columns))).alias("r")).select("request_key", "r.*")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.schema(fresh.schema).parquet(path).select("request_key"), "request_key", "left_anti")
    new.select(*fresh.columns).write.mode("append").parquet(path)
    return spark.read.schema(fresh.schema).parquet(path)


def analysis_json(parts: dict[str, DataFrame], key: str = "filing_id") -> DataFrame:
    """One JSON document per filing: every part's rows of it as an array, in the order of their own JSON.

    A part is bounded by a filing: identities, concepts, segments.
    """
    out = None
    for name, df in parts.items():
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in df.columns if c != key])))).alias(name))
        out = rows if out is None else out.join(rows, key, "full")
    body = [F.concat(F.lit(f'"{name}":['), F.array_join(F.coalesce(name, F.array().cast("array<string>")), ","), F.lit("]")) for name in parts]
    head: Column = F.concat(F.lit("{"), F.substring(F.to_json(F.struct(key)), 2, 2**31 - 1))
    return out.select(key, F.concat(F.regexp_replace(head, r"\}$", ","), F.concat_ws(",", *body), F.lit("}")).alias("analysis"))


def cached_analyses(wanted: DataFrame, analyses: DataFrame, force: bool = False, key: str = "filing_id") -> tuple[DataFrame, DataFrame]:
    """Stored analyses of the wanted filings, and the filings still to be analysed: all of them if forced."""
    if force:
        return analyses.limit(0), wanted.select(key).distinct()
    return analyses.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(analyses, key, "left_anti")


def write_leaderboard(board: DataFrame, path: str) -> None:
    """The leaderboard, a row per model, as one JSON file; a handful of rows."""
    board.orderBy("model").coalesce(1).write.mode("overwrite").json(path)


def transcript_calls(turns: DataFrame) -> DataFrame:
    """Tool calls of agents' transcripts: ``answer_id, tool_calls array<struct<concept, fiscal_year, value>>``, in order, with what the tool replied.

    ``turns``: answer_id, turn, concept, fiscal_year, value (null where the tool had none). A transcript without an answer within its turns keeps its calls.
    """
    call = F.struct("turn", "concept", "fiscal_year", "value")
    calls = turns.filter(F.col("concept").isNotNull()).groupBy("answer_id").agg(F.array_sort(F.collect_list(call)).alias("c"))
    return calls.select("answer_id", F.transform("c", lambda x: F.struct(x["concept"].alias("concept"), x["fiscal_year"].alias("fiscal_year"), x["value"].alias("value"))).alias("tool_calls"))
