"""Checking and grading answers: cited numbers, arithmetic, rubrics, leaderboard, gold questions, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ontology import CONCEPTS
from .facts import is_consolidated

# Concepts that count as the same when graded.
SAME = {"equity.parent": "equity.total", "net_income.parent": "net_income.consolidated"}


def truth_values(facts: DataFrame) -> DataFrame:
    """First trusted consolidated annual fact of each concept and year, of the concept's own period type; the grounded look-up of a figure."""
    instant = F.col("concept").isin([c.id for c in CONCEPTS if c.period_type == "instant"])
    rows = facts.filter((F.col("source") == "xbrl") & is_consolidated() & (F.col("fiscal_period") == "FY") & ((F.col("period_type") == "instant") == instant))
    return rows.groupBy("filing_id", "concept", "fiscal_year").agg(F.min_by(F.col("value").cast("double"), "ord").alias("truth"))


def close(a: Column, b: Column, ratio: Column) -> Column:
    """Money within 1 % or one million, ratios within 0.005."""
    return F.when(ratio, F.abs(a - b) <= 0.005).otherwise(F.abs(a - b) <= F.greatest(0.01 * F.abs(b), F.lit(1_000_000.0)))


def calc_consistent(value: Column, numbers: Column) -> Column:
    """Whether the answer follows from two of its cited values; null without a value or with fewer than two.

    Small answers are quotients or changes (as they are, or as percent), large ones sums or differences.
    """
    v = F.filter(F.transform(numbers, lambda n: n["value"]), lambda x: x.isNotNull())
    near = lambda x, y, ratio: F.coalesce(close(x, y, F.lit(ratio)), F.lit(False))

    def some(candidate: Column) -> Column:
        def pair(a, b):
            quotients = [F.try_divide(a, b), F.try_divide(a - b, a), F.try_divide(a - b, b)]
            small = F.lit(False)
            for q in quotients:
                small = small | near(candidate, q, True)
            return F.when(F.abs(candidate) < 1.5, small & (b != 0)).otherwise(near(candidate, a - b, False) | near(candidate, a + b, False))

        indexed = F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.exists(indexed, lambda p: F.exists(indexed, lambda q: (p["i"] != q["i"]) & F.coalesce(pair(p["x"], q["x"]), F.lit(False))))

    return F.when(value.isNull() | (F.size(v) < 2), F.lit(None).cast("boolean")).otherwise(some(value) | ((F.abs(value) > 1.5) & some(value / 100)))


def verify(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """``answer_id, n_cited, n_graded, n_ok, retrieval_ok, calc_ok, trusted``.

    ``answers``: answer_id, filing_id, fiscal_year, value, numbers_used array<struct<label, concept, fiscal_year, value>>. A number
    without a year is of the answer's. One without a concept or a trusted value is not graded; one without a value is wrong. Ratios
    are held to the band of money too, as everything cited is.
    """
    each = F.transform("numbers_used", lambda n: F.struct(n["concept"].alias("concept"), F.coalesce(n["fiscal_year"], F.col("fiscal_year")).alias("cited_year"), n["value"].alias("cited")))
    cited = answers.select("answer_id", "filing_id", F.inline(each)).withColumnRenamed("cited_year", "fiscal_year")
    graded = cited.join(truth, ["filing_id", "concept", "fiscal_year"], "left")
    ok = F.when(F.col("truth").isNotNull(), F.coalesce(close(F.col("cited"), F.col("truth"), F.lit(False)), F.lit(False)))
    each = graded.groupBy("answer_id").agg(F.count("*").alias("n_cited"), F.count(ok).alias("n_graded"), F.count_if(ok).alias("n_ok"))
    out = answers.join(each, "answer_id", "left").na.fill(0, ["n_cited", "n_graded", "n_ok"])
    out = out.withColumn("retrieval_ok", (F.col("n_graded") > 0) & (F.col("n_ok") == F.col("n_graded"))).withColumn("calc_ok", calc_consistent(F.col("value"), F.col("numbers_used")))
    return out.select("answer_id", "n_cited", "n_graded", "n_ok", "retrieval_ok", "calc_ok", (F.col("retrieval_ok") & F.coalesce("calc_ok", F.lit(True))).alias("trusted"))


def same_concept(c: Column) -> Column:
    """Representative of a concept's equivalence class."""
    for a, b in SAME.items():
        c = F.when(c == a, b).otherwise(c)
    return c


def within_gold(value: Column, gold: Column) -> Column:
    """Whether a value answers a gold answer ``struct<value, unit, tolerance, answerable>``."""
    tolerance = F.coalesce(gold["tolerance"], F.lit(0.004))
    ratio = (F.abs(value - gold["value"]) <= tolerance) | (F.abs(value / 100 - gold["value"]) <= tolerance)
    money = close(value, gold["value"], F.lit(False))
    graded = F.coalesce(F.when(gold["unit"] == "ratio", ratio).otherwise(money), F.lit(False))
    return F.when(~F.coalesce(gold["answerable"], F.lit(True)), value.isNull()).otherwise(graded)


def grade(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Rubric and final grade of every answer.

    ``questions``: question_id, gold, required_concepts, rubric array<struct<type, concept, fiscal_year, weight>>.
    ``answers``: model, question_id, value, tool_calls array<struct<concept, fiscal_year, value>>, judge_yes.
    """
    rows = answers.join(questions, "question_id")
    final = within_gold(F.col("value"), F.col("gold"))
    called = lambda concept, year: F.exists("tool_calls", lambda c: (same_concept(c["concept"]) == same_concept(concept)) & c["value"].isNotNull() & F.coalesce(c["fiscal_year"] == year, year.isNull()))
    all_called = F.forall("required_concepts", lambda r: F.exists("tool_calls", lambda c: same_concept(c["concept"]) == same_concept(r)))
    passed = lambda i: F.when(i["type"] == "retrieval", called(i["concept"], i["fiscal_year"])).when(i["type"] == "definition", all_called).when(i["type"] == "calculation", final).otherwise(False)
    items = F.transform("rubric", lambda i: F.struct(F.coalesce(passed(i), F.lit(False)).alias("ok"), F.coalesce(i["weight"], F.lit(1.0)).alias("w")))
    out = rows.select("model", "question_id", final.alias("final_ok"), items.alias("items"), F.coalesce("judge_yes", F.lit(False)).alias("judge_yes"))
    total = F.aggregate("items", F.lit(0.0), lambda a, i: a + i["w"])
    won = F.aggregate("items", F.lit(0.0), lambda a, i: a + F.when(i["ok"], i["w"]).otherwise(0.0))
    return out.select("model", "question_id", "final_ok", "judge_yes", (won / F.when(total == 0, 1.0).otherwise(total)).alias("rubric"))


def leaderboard(grades: DataFrame) -> DataFrame:
    """Means per model, the answers a judge passes though they are wrong, and rubric less final."""
    mean = lambda c: F.round(F.avg(c), 3)
    out = grades.groupBy("model").agg(
        F.count("*").alias("n"), mean("rubric").alias("rubric"), mean(F.col("final_ok").cast("int")).alias("final"),
        mean(F.col("judge_yes").cast("int")).alias("judge"), F.count_if(F.col("judge_yes") & ~F.col("final_ok")).alias("judge_misses"),
    )
    return out.withColumn("gap", F.round(F.col("rubric") - F.col("final"), 3))


def model_label(model: Column, vendor: str = "") -> Column:
    """A model's name for tables: without the vendor's prefix, its version with a dot, words capitalised."""
    plain = F.regexp_replace(model, f"^{vendor}-" if vendor else "^$", "")
    return F.initcap(F.replace(F.regexp_replace(plain, r"-(\d+)-(\d+)$", " $1.$2"), F.lit("-"), F.lit(" ")))


def judge_says_yes(reply: Column) -> Column:
    """A judge's reply counts as yes if it begins with y or **y, or says yes in its first six characters."""
    r = F.lower(F.trim(reply))
    return F.coalesce(r.startswith("y") | r.startswith("**y") | F.substring(r, 1, 6).contains("yes"), F.lit(False))


def triage(gold: DataFrame) -> DataFrame:
    """Unverified gold questions in order of confidence, lowest first."""
    rank = F.when(F.col("draft_confidence") == "low", 0).when(F.col("draft_confidence") == "high", 2).otherwise(1)
    return gold.filter(~F.coalesce("verified", F.lit(False))).withColumn("priority", rank).orderBy("priority", "ord")


def search(companies: DataFrame, text: str, limit: int = 8, aliases: dict[str, str] | None = None) -> DataFrame:
    """Companies for what was typed, best first; ``companies``: ticker, name, rank."""
    q = " ".join(text.lower().split())
    ticker, name = F.lower("ticker"), F.lower("name")
    score = (
        F.when(ticker == q, 1000).when(ticker.startswith(q), 720).when(name.startswith(q), 600).when(name.contains(" " + q), 380)
        .when(name.contains(q), 220).when(ticker.contains(q), 150).otherwise(0)
    )
    for alias, owner in (aliases or {}).items():
        if q and alias.startswith(q):
            score = F.when(ticker == owner.lower(), F.greatest(score, F.lit(900))).otherwise(score)
    found = companies.withColumn("score", score).filter((F.col("score") > 0) & F.lit(bool(q)))
    return found.orderBy(F.desc("score"), "rank").limit(limit)  # the limit is the feature: a type-ahead list
