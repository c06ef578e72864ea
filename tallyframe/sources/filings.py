"""Sources: filing look-up, raw tagged facts, gold questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import DIMS
from ..plans.ontology import tag_index

# Axes that get a short name.
AXES = {"StatementBusinessSegmentsAxis": "segment", "OperatingSegmentsAxis": "segment", "StatementGeographicalAxis": "geography", "ProductOrServiceAxis": "product", "ConsolidationItemsAxis": "consolidation_item"}
GOLD = "questions array<struct<question_id:string,filing_ref:struct<cik:string,accession:string,fiscal_year:int,issuer:string>,prompt:string,answer_type:string,category:string,difficulty:string,gold_answer:struct<value:string,unit:string,fiscal_year:int,fiscal_period:string>,citation:string,verified:boolean,draft_confidence:string>>"


BENCH = "questions array<struct<id:string,ticker:string,fiscal_year:int,skill:string,question:string,gold:struct<value:double,unit:string,tolerance:double,answerable:boolean>,required_concepts:array<string>,formula:string,note:string,rubric:array<struct<type:string,text:string,concept:string,fiscal_year:int,weight:double>>>>"


def companies(snapshots: DataFrame) -> DataFrame:
    """Ticker index: rank, ticker, ten-digit cik and name, from rows of JSON text ``{position: {cik_str, ticker, title}}``; the position is the rank."""
    rows = snapshots.select(F.explode(F.from_json("value", "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("rank", "c"))
    return rows.select(F.col("rank").cast("int").alias("rank"), F.upper("c.ticker").alias("ticker"), F.lpad("c.cik_str", 10, "0").alias("cik"), F.col("c.title").alias("name"))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """:func:`companies` of a snapshot file."""
    return companies(spark.read.text(path, wholetext=True))


def find_10k(submissions: DataFrame, fiscal_year: int | None = None) -> DataFrame:
    """The newest annual report of every company, or that of a fiscal year.

    ``submissions``: cik and parallel arrays form, accession, primary_doc, filing_date, report_date, newest first.
    """
    each = submissions.select("cik", F.posexplode(F.arrays_zip("form", "accession", "primary_doc", "filing_date", "report_date")).alias("pos", "f")).select("cik", "pos", "f.*")
    each = each.filter("form = '10-K'").withColumn("fiscal_year", F.year(F.coalesce(F.expr("try_cast(report_date AS date)"), F.expr("try_cast(filing_date AS date)"))))
    each = each if fiscal_year is None else each.filter(F.col("fiscal_year") == fiscal_year)
    found = each.groupBy("cik").agg(F.min_by(F.struct("accession", "primary_doc", "filing_date", "report_date", "fiscal_year"), "pos").alias("f")).select("cik", "f.*")
    return found.withColumn("url", F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.expr("try_cast(cik AS bigint)").cast("string"), F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), "primary_doc"))


def axis_name(axis: Column) -> Column:
    """Short name of an axis; others lose a trailing Axis and are lower-cased, and without one stay."""
    short = F.create_map(*[F.lit(x) for pair in AXES.items() for x in pair])
    return F.coalesce(F.try_element_at(short, axis), F.when(axis.endswith("Axis"), F.lower(F.regexp_replace(axis, "Axis$", ""))), axis)


def map_raw_facts(raw: DataFrame, focus: DataFrame) -> DataFrame:
    """Tagged facts to facts: tags, units, decimals, dimensions, segments and fiscal years.

    ``raw``: filing_id, ord, ns, tag, value string, unit_measure, decimals string, period_kind, start, end, dims.
    ``focus``: filing_id, ord, focus_year, period_end, of the document's fiscal-year focus. A year is
    that of the period's end plus the focus's offset from its own end.
    """
    tags = F.create_map(*[F.lit(x) for pair in tag_index().items() for x in pair])
    offset = focus.groupBy("filing_id").agg(F.min_by(F.col("focus_year") - F.year("period_end"), "ord").alias("offset"))
    dims = F.array_sort(F.transform(F.coalesce("dims", F.array().cast(DIMS)), lambda d: F.struct(axis_name(d["axis"]).alias("axis"), d["member"].alias("member"))))
    unit = F.coalesce(F.col("unit_measure"), F.lit("USD"))
    local = F.element_at(F.split(unit, ":"), -1)
    unit = F.when(local == "USD", "USD").when(F.lower(unit).contains("shares"), "shares").otherwise(local)
    df = raw.filter("ns = 'us-gaap' AND period_kind IN ('instant', 'duration')").withColumn("concept", F.try_element_at(tags, F.col("tag"))).withColumn("value", F.expr("try_cast(value AS decimal(20,4))"))
    df = df.filter("concept IS NOT NULL AND value IS NOT NULL AND `end` IS NOT NULL").join(offset, "filing_id", "left").withColumn("dims", dims)
    segment = F.exists("dims", lambda d: d["axis"] == "segment")
    routed = F.when(segment & F.col("concept").isin("revenue.total", "operating_income.total"), F.replace(F.col("concept"), F.lit(".total"), F.lit(".segment"))).otherwise(F.col("concept"))
    return df.select(
        "filing_id", "ord", routed.alias("concept"), "value", F.col("period_kind").alias("period_type"), (F.year("end") + F.coalesce("offset", F.lit(0))).alias("fiscal_year"), F.lit("FY").alias("fiscal_period"),
        F.lit("xbrl").alias("source"), unit.alias("unit"), F.lit("ones").alias("reported_scale"), F.expr("try_cast(decimals AS int)").alias("decimals"), F.lit(None).cast("double").alias("band"), "dims",
    )


def gold_questions(files: DataFrame) -> DataFrame:
    """Gold questions of JSON texts, in file order; values stay text, periods default to FY, lists and marks to empty and false."""
    rows = files.select(F.posexplode(F.from_json("value", GOLD)["questions"]).alias("ord", "q")).select("ord", "q.*")
    rows = rows.withColumn("value", F.expr("try_cast(gold_answer.value AS decimal(38,10))")).withColumn("fiscal_period", F.coalesce("gold_answer.fiscal_period", F.lit("FY")))
    return rows.withColumn("verified", F.coalesce("verified", F.lit(False))).withColumn("citation", F.coalesce("citation", F.lit(""))).withColumn("draft_confidence", F.coalesce("draft_confidence", F.lit("")))


def benchmark_questions(files: DataFrame) -> DataFrame:
    """Benchmark questions of JSON texts, in file order, in the form that grading takes: ``gold``, ``required_concepts``, ``rubric``."""
    rows = files.select(F.posexplode(F.from_json("value", BENCH)["questions"]).alias("ord", "q")).select("ord", "q.*")
    rubric = F.transform("rubric", lambda i: F.struct(i["type"].alias("type"), i["concept"].alias("concept"), i["fiscal_year"].alias("fiscal_year"), i["weight"].alias("weight")))
    gold = F.struct("gold.value", "gold.unit", "gold.tolerance", F.coalesce("gold.answerable", F.lit(True)).alias("answerable"))
    return rows.select("ord", F.col("id").alias("question_id"), "ticker", "fiscal_year", "skill", "question", gold.alias("gold"), F.coalesce("required_concepts", F.array().cast("array<string>")).alias("required_concepts"), F.coalesce(rubric, F.array().cast("array<struct<type:string,concept:string,fiscal_year:int,weight:double>>")).alias("rubric"))


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as rows of text, for :func:`gold_questions` and :func:`benchmark_questions`."""
    return spark.read.text(path, wholetext=True)
