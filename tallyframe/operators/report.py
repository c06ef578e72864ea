"""Text against trusted data: attribution of violations, comparisons, scorecards, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.identities import AGG_SLOT, IDENTITIES, SLOT, Ref, ends, first_of, refs, registry, struct, verdict
from ..scratch import Scratch
from .facts import PERIOD, is_aggregable, is_consolidated, slots

LABELS = ("extraction_error", "filing_inconsistency", "constraint_model_error", "undetermined")


def agrees(value: Column, truth: Column) -> Column:
    """Within 0.2 % of the trusted value or one million, whichever is more."""
    return F.abs(value - truth) <= F.greatest(0.002 * F.abs(truth), F.lit(1_000_000.0))


def _value(r: Ref, side: str) -> str:
    """The plain value behind a leaf, as SQL."""
    return f"{side}{AGG_SLOT[(r.concept, r.over)]}.value" if r.over else first_of(r, side, "value")


class Reconciliation:
    """Text facts beside trusted facts.

    The prepared facts and the slots of both sides are computed once, in one scan and one aggregation, and written to the shared folder;
    every answer reads those tables. ``facts`` holds both: trusted ones have source ``xbrl``, the others are the text's.
    """

    def __init__(self, facts: DataFrame):
        scratch = Scratch(facts.sparkSession, "reconciliation")
        side = F.when(F.col("source") == "xbrl", "truth").otherwise("text").alias("side")
        self.facts = scratch.keep(facts.select("*", side), "facts")
        rows = scratch.keep(slots(self.facts, ("side",)), "slots")
        names = [*SLOT.values(), *AGG_SLOT.values()]
        half = lambda name, as_: rows.filter(F.col("side") == name).select(*PERIOD, F.struct(*names).alias(as_))
        #: A row per period of either side, its slots in the structs ``t`` (text) and ``x`` (truth).
        self.rows = half("text", "t").join(half("truth", "x"), PERIOD, "full")
        self.text, self.truth = (self.facts.filter(F.col("side") == name) for name in ("text", "truth"))

    def _results(self, templates, **more: str) -> DataFrame:
        """Every identity of every period on both sides, with the values behind its leaves; ``more`` are further columns as SQL."""
        each = []
        for t in templates:
            leaves = [struct({"label": f"'{r.label}'", "value": _value(r, "t."), "truth": _value(r, "x.")}) for r in (t.target, *refs(t.expr))]
            each.append(struct({"text": ends(t, "t."), "trusted": ends(t, "x."), "kind": f"'{t.period_type}'", "leaves": f"array({', '.join(leaves)})"}))
        rows = self.rows.selectExpr(*PERIOD, *[f"{sql} AS {name}" for name, sql in more.items()], f"inline(array({', '.join(each)}))")
        (status, residual, _), (truth_status, truth_residual, _) = verdict(False, "text."), verdict(True, "trusted.")
        return rows.selectExpr(
            *PERIOD, *more, "text.template_id", "text.severity", "kind", "leaves", f"{status} AS status", f"{residual} AS residual", f"{truth_status} AS truth_status", f"{truth_residual} AS truth_residual"
        )

    def attribute(self) -> DataFrame:
        """The cause of every hard violation in the text facts, judged by the trusted facts.

        Violated in the trusted data too: the filing is inconsistent. Undecidable there: undetermined. Otherwise a
        value that disagrees makes it an extraction error, and without one the identity itself does not fit.
        Identities are looked at in every period, whatever its type.
        """
        bad = self._results([t for t in IDENTITIES if t.severity == "hard"]).filter("status = 'violated'")
        return _causes(bad)

    def compare_facts(self) -> DataFrame:
        """See :func:`compare_facts`."""
        return compare_facts(self.text, self.truth)

    def compare_identities(self) -> DataFrame:
        """Every identity of the registry in every filing and year of the trusted data: status there and in the text, ``n/a`` where a side has no such period."""
        key = ["filing_id", "fiscal_year", "template_id"]
        known = lambda side, status: F.when(F.col(f"in_{side}"), F.col(status)).otherwise("n/a").alias(f"{side}_status")
        out = self._results(IDENTITIES, in_truth="x IS NOT NULL", in_text="t IS NOT NULL").filter(F.col("kind") == F.col("period_type"))
        out = out.select(*key, known("truth", "truth_status"), known("text", "status"), "truth_residual", F.col("residual").alias("text_residual"))
        filings = self.truth.select("filing_id", "fiscal_year").distinct()
        every = filings.crossJoin(F.broadcast(registry(self.facts.sparkSession).select("template_id")))  # 16 rows, fixed
        return every.join(out, key, "left").na.fill("n/a", ["truth_status", "text_status"])

    def scorecard(self) -> DataFrame:
        """One row per filing: facts, agreement, results over the periods of the trusted data, and causes."""
        facts = self.compare_facts().groupBy("filing_id").agg(F.count("*").alias("n_facts"), F.count_if("agrees").alias("n_agree"), F.count_if(~F.col("agrees")).alias("n_disagree"))
        every = self._results(IDENTITIES, known="x IS NOT NULL")
        counted = F.col("known") & (F.col("kind") == F.col("period_type"))
        hard = (F.col("status") == "violated") & (F.col("severity") == "hard")
        every = every.withColumn("cause", F.when(hard, _cause()))
        out = every.groupBy("filing_id").agg(
            F.max("known").alias("known"),
            F.count_if(counted & (F.col("status") == "satisfied")).alias("n_satisfied"), F.count_if(counted & hard).alias("n_hard"),
            F.count_if(counted & (F.col("status") == "violated") & (F.col("severity") == "soft")).alias("n_soft"), F.count_if(counted & (F.col("status") == "indeterminate")).alias("n_indeterminate"),
            *[F.count_if(F.col("cause.label") == x).alias(f"n_{x}") for x in LABELS], F.count_if("cause.judge_invisible").alias("n_judge_invisible"),
        )
        return out.filter("known").drop("known").join(facts, "filing_id", "left").na.fill(0)

    def markdown(self, name: str = "Text") -> DataFrame:
        """See :func:`markdown`."""
        return markdown(self.scorecard(), self.attribute(), name)


def _cause() -> Column:
    """``label, evidence, judge_invisible`` of a violated result that carries the values behind its leaves."""
    money = lambda c: F.format_number(c, 0)
    differ = F.filter("leaves", lambda x: ~agrees(x["value"], x["truth"]))
    part = lambda x: F.concat(x["label"], F.lit(": text="), money(x["value"]), F.lit(" vs xbrl="), money(x["truth"]), F.lit(" (delta "), money(x["value"] - x["truth"]), F.lit(")"))
    error = F.size(differ) > 0
    decided = (
        F.when(F.col("truth_status") == "violated", "filing_inconsistency").when(F.col("truth_status") == "indeterminate", "undetermined")
        .when(error, "extraction_error").otherwise("constraint_model_error")
    )
    is_error = decided == "extraction_error"
    return F.struct(
        decided.alias("label"), F.when(is_error, F.array_join(F.transform(differ, part), "; ")).otherwise("").alias("evidence"),
        (is_error & F.forall(differ, lambda x: x["label"].contains("["))).alias("judge_invisible"),
    )


def _causes(bad: DataFrame) -> DataFrame:
    return bad.withColumn("c", _cause()).select(*PERIOD, "template_id", "c.label", "c.evidence", "residual", "truth_status", "c.judge_invisible")


def attribute(text: DataFrame, truth: DataFrame) -> DataFrame:
    """See :meth:`Reconciliation.attribute`."""
    return Reconciliation(_both(text, truth)).attribute()


def _both(text: DataFrame, truth: DataFrame) -> DataFrame:
    return text.withColumn("source", F.lit("text")).unionByName(truth.withColumn("source", F.lit("xbrl")))


def compare_facts(text: DataFrame, truth: DataFrame) -> DataFrame:
    """Consolidated dollar facts of the text, by concept, beside the first trusted fact of the same concept and period."""
    key = [*PERIOD, "concept"]
    first = truth.filter(is_consolidated()).groupBy(*key).agg(F.min_by(F.col("value").cast("double"), "ord").alias("truth_value"))
    mine = text.filter(is_consolidated() & (F.col("unit") == "USD")).select(*key, "ord", F.col("value").cast("double").alias("value"))
    return mine.join(first, key, "left").withColumn("agrees", agrees(F.col("value"), F.col("truth_value"))).orderBy("filing_id", "concept", "ord")


def segment_members(facts: DataFrame) -> DataFrame:
    """``filing_id, fiscal_year, segment, value``: the largest value of each revenue segment, of facts that nothing breaks down further."""
    axis = F.filter("dims", lambda d: d["axis"] == "segment")
    seg = facts.filter((F.col("concept") == "revenue.segment") & is_aggregable("segment") & (F.col("period_type") == "duration"))
    seg = seg.withColumn("segment", F.replace(F.element_at(F.transform(axis, lambda d: d["member"]), 1), F.lit("Member"), F.lit("")))
    return seg.groupBy("filing_id", "fiscal_year", "segment").agg(F.max(F.col("value").cast("double")).alias("value"))


def segments(facts: DataFrame) -> DataFrame:
    """Revenue by segment for display: members by size, the largest value per segment each, their sum, and whether it reconciles with the total."""
    total = facts.filter((F.col("concept") == "revenue.total") & is_consolidated()).groupBy("filing_id", "fiscal_year").agg(F.min_by(F.col("value").cast("double"), "ord").alias("total"))
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("k"), "segment", "value")))
    out = segment_members(facts).groupBy("filing_id", "fiscal_year").agg(F.sum("value").alias("segment_sum"), F.count("*").alias("n_segments"), by_size.alias("m"))
    out = out.withColumn("members", F.transform("m", lambda x: F.struct(x["segment"].alias("name"), x["value"].alias("value")))).drop("m")
    out = out.withColumn("largest", F.col("members")[0]["name"]).join(total, ["filing_id", "fiscal_year"], "left")
    return out.withColumn("reconciles", F.coalesce(F.abs(F.col("segment_sum") - F.col("total")) <= F.greatest(0.005 * F.abs("total"), F.lit(1_000_000.0)), F.lit(False)))


def series(facts: DataFrame, years: int = 3) -> DataFrame:
    """Values of consolidated concepts (the last fact of a year wins) in the last years that have revenue; at least two points."""
    last = facts.filter(is_consolidated()).groupBy("filing_id", "concept", "fiscal_year").agg(F.max_by(F.col("value").cast("double"), "ord").alias("value"))
    rank = F.dense_rank().over(Window.partitionBy("filing_id").orderBy(F.desc("fiscal_year")))
    kept = last.filter("concept = 'revenue.total'").select("filing_id", "fiscal_year", rank.alias("n")).filter(F.col("n") <= years).drop("n")
    out = last.join(kept, ["filing_id", "fiscal_year"])
    many = out.groupBy("filing_id", "concept").agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    return out.join(many, ["filing_id", "concept"]).select("filing_id", "concept", "fiscal_year", "value")


def year_over_year(facts: DataFrame) -> DataFrame:
    """Change on the year before; null without that year or where it was zero. A negative base keeps its sign."""
    last = facts.filter(is_consolidated()).groupBy("filing_id", "concept", "fiscal_year").agg(F.max_by(F.col("value").cast("double"), "ord").alias("value"))
    w = Window.partitionBy("filing_id", "concept").orderBy("fiscal_year")
    before = F.when(F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1, F.lag("value").over(w))
    return last.select("filing_id", "concept", "fiscal_year", "value", before.alias("previous")).withColumn("change", F.when(F.col("previous") != 0, (F.col("value") - F.col("previous")) / F.col("previous")))


def money_label(v: Column) -> Column:
    """$1.2B, $3.4M, $5,678 or n/a."""
    size = F.abs(v)
    return (
        F.when(v.isNull(), "n/a").when(size >= 1e9, F.concat(F.lit("$"), F.format_number(v / 1e9, 1), F.lit("B")))
        .when(size >= 1e6, F.concat(F.lit("$"), F.format_number(v / 1e6, 1), F.lit("M"))).otherwise(F.concat(F.lit("$"), F.format_number(v, 0)))
    )


def _yearly(facts: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """``filing_id, fiscal_year`` and a column for each concept (dots as underscores): its last consolidated value."""
    pick = lambda c: F.max_by(F.when(F.col("concept") == c, F.col("value").cast("double")), F.when(F.col("concept") == c, F.col("ord"))).alias(c.replace(".", "_"))
    return facts.filter(is_consolidated() & F.col("concept").isin(*concepts)).groupBy("filing_id", "fiscal_year").agg(*[pick(c) for c in concepts])


def notable(facts: DataFrame) -> DataFrame:
    """Sentences of notable figures per filing and year with revenue: growth, net income, operating margin, segments, discontinued operations, mezzanine equity.

    The last three are those of the whole filing, whatever the year.
    """
    rows = _yearly(facts, ("revenue.total", "net_income.parent", "operating_income.total"))
    w = Window.partitionBy("filing_id").orderBy("fiscal_year")
    before = lambda c: F.when(F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1, F.lag(c).over(w))
    change = lambda c: F.try_divide(F.col(c) - before(c), before(c))
    rows = rows.withColumn("ry", change("revenue_total")).withColumn("ni", change("net_income_parent")).withColumn("margin", F.try_divide("operating_income_total", "revenue_total"))
    segment = F.get(F.transform(F.filter("dims", lambda d: d["axis"] == "segment"), lambda d: d["member"]), 0)
    whole = facts.groupBy("filing_id").agg(
        # A figure without a segment counts as one of its own.
        F.count_distinct(F.when(F.col("concept") == "revenue.segment", F.coalesce(segment, F.lit("")))).alias("n_segments"),
        F.max((F.col("concept") == "income.discontinued") & is_consolidated()).alias("discontinued"), F.max((F.col("concept") == "equity.temporary") & is_consolidated()).alias("mezzanine"),
    )
    percent = lambda c, places: F.concat(F.format_number(100 * c, places), F.lit("%"))
    parts = F.array(
        F.when(F.col("ry").isNotNull(), F.concat(F.when(F.col("ry") >= 0, "Revenue grew ").otherwise("Revenue fell "), percent(F.abs("ry"), 0), F.lit(" year-over-year to "), money_label(F.col("revenue_total")))),
        F.when(F.col("ni").isNotNull(), F.concat(F.when(F.col("ni") >= 0, "Net income rose ").otherwise("Net income declined "), percent(F.abs("ni"), 0), F.lit(" YoY"))),
        F.when(F.col("margin").isNotNull(), F.concat(F.lit("Operating margin "), percent(F.col("margin"), 1))),
        F.when(F.col("n_segments") > 0, F.concat(F.col("n_segments").cast("string"), F.lit(" reportable segment(s)"))),
        F.when(F.col("discontinued"), F.lit("Reports discontinued operations (often a divestiture or spin-off)")),
        F.when(F.col("mezzanine"), F.lit("Carries redeemable / mezzanine equity on the balance sheet")),
    )
    out = rows.filter("revenue_total IS NOT NULL").join(whole, "filing_id")
    return out.select("filing_id", "fiscal_year", money_label(F.col("revenue_total")).alias("revenue"), F.array_join(parts, "; ").alias("notable"))


def margins(facts: DataFrame) -> DataFrame:
    """Gross (from its parts where untold), operating and net margin and tax rate per filing and year; null without a figure or over zero."""
    rows = _yearly(facts, ("revenue.total", "gross_profit.total", "cogs.total", "operating_income.total", "net_income.parent", "income_tax.total", "pretax_income.total"))
    gross = F.coalesce("gross_profit_total", F.col("revenue_total") - F.col("cogs_total"))
    return rows.select(
        "filing_id", "fiscal_year", F.try_divide(gross, "revenue_total").alias("gross"), F.try_divide("operating_income_total", "revenue_total").alias("operating"),
        F.try_divide("net_income_parent", "revenue_total").alias("net"), F.try_divide("income_tax_total", "pretax_income_total").alias("tax"),
    )


def latest_year(facts: DataFrame) -> DataFrame:
    """``filing_id, fiscal_year``: the last year that a filing has facts of."""
    return facts.groupBy("filing_id").agg(F.max("fiscal_year").alias("fiscal_year"))


def markdown(card: DataFrame, attributions: DataFrame, name: str = "Text") -> DataFrame:
    """A report per filing: a table row, the causes of its violations with a line each, and a closing line.

    ``attributions`` as :func:`attribute` gives them; the causes are counted in alphabetical order, their lines come by identity.
    """
    cells = ["n_facts", "n_agree", "n_disagree", "n_satisfied", "n_hard", "n_soft", "n_indeterminate"]
    row = F.concat(F.lit(f"| {name} | "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cells]), F.lit(" |"))
    bullet = F.concat(F.lit("- `"), "template_id", F.lit("` -> **"), "label", F.lit("** - "), "evidence")
    bullets = attributions.groupBy("filing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("template_id", "period_type", bullet.alias("b")))), lambda x: x["b"]), "\n").alias("bullets"))
    counts = F.array(*[F.when(F.col(f"n_{x}") > 0, F.concat(F.lit(f"{x}: "), F.col(f"n_{x}").cast("string"))) for x in sorted(LABELS)])
    causes = F.when(F.col("bullets").isNotNull(), F.concat(F.lit(f"\n\n**{name}** attribution - "), F.array_join(counts, ", "), F.lit("\n"), "bullets")).otherwise("")
    closing = (
        F.when((F.col("n_hard") == 0) & (F.col("n_disagree") == 0), F.concat(F.lit("\n\n*Verified: all "), F.col("n_agree").cast("string"), F.lit(" extracted figures reconcile against trusted data.*")))
        .when(F.col("n_judge_invisible") > 0, F.concat(F.lit("\n\n*Caught: "), F.col("n_judge_invisible").cast("string"), F.lit(" extraction error(s) though each figure looked correct.*"))).otherwise("")
    )
    return card.join(bullets, "filing_id", "left").select("filing_id", F.concat(row, causes, closing).alias("report"))
