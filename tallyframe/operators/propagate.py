"""Deriving missing figures by solving identities, and locating suspects.

Identities are tried in their order, and what one derives the next already sees, so the
order decides which identity a figure is derived by. That is a sequential fold with
state per row, over at most a few dozen slots; it runs on pivoted rows in Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.identities import AGG_SLOT, IDENTITIES, SLOT, Node, Ref, render
from ..plans.ontology import BY_ID
from .check import check_slots
from .facts import PERIOD, slots

MAX_PASSES = 12
DERIVED = "filing_id string, period_type string, fiscal_year int, fiscal_period string, concept string, value double, band double, unit string, template_id string, op string, input_ids array<string>, fact_id string, step int"
SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[c.split()[1]]) for c in DERIVED.split(", ")])
Interval = tuple[float, float]


def _plus(x: Interval, y: Interval) -> Interval:
    return x[0] + y[0], x[1] + y[1]


def _minus(x: Interval, y: Interval) -> Interval:
    return x[0] - y[1], x[1] - y[0]


def _times(x: Interval, y: Interval) -> Interval:
    corners = [a * b for a in x for b in y]
    return min(corners), max(corners)


def _over(x: Interval, y: Interval) -> Interval | None:
    if y[0] <= 0 <= y[1]:
        return None
    corners = [a / b for a in x for b in y]
    return min(corners), max(corners)


def _operands(expr) -> list[Ref] | None:
    """Leaves of an expression one level deep; None for deeper ones, which are never solved."""
    if isinstance(expr, Ref):
        return [expr]
    return list(expr.args) if all(isinstance(a, Ref) for a in expr.args) else None


def _forward(expr: Node | Ref, known: list[Interval]) -> Interval | None:
    out = known[0]
    for x in known[1:]:
        if out is None:
            return None
        out = {"+": _plus, "-": _minus, "/": _over}[expr.op](out, x)
    return out


def _inverse(expr, k: int, target: Interval, known: list[Interval | None]) -> Interval | None:
    """The ``k``-th operand from the target and the others."""
    if isinstance(expr, Ref):
        return target
    if expr.op == "+":
        out = target
        for j, x in enumerate(known):
            out = out if j == k else _minus(out, x)
        return out
    other = known[1 - k]
    if expr.op == "-":
        return _plus(target, other) if k == 0 else _minus(other, target)
    return _times(target, other) if k == 0 else _over(other, target)


def solve(known: dict[str, tuple[Interval, str]], sums: dict[tuple[str, str], tuple[Interval, list[str]]], period_type: str) -> list[dict]:
    """All derivations of one filing and period, in the order they were made; ``known`` gains them."""
    out: list[dict] = []

    def look(r: Ref) -> tuple[Interval | None, list[str]]:
        if r.over:
            got = sums.get((r.concept, r.over))
            return (got[0], got[1]) if got else (None, [])
        for c in (r.concept, *r.fallbacks):
            if c in known:
                return known[c][0], [known[c][1]]
        return ((0.0, 0.0), []) if r.optional else (None, [])

    for _ in range(MAX_PASSES):
        before = len(out)
        for t in IDENTITIES:
            operands = _operands(t.expr)
            if t.period_type != period_type or operands is None:
                continue
            leaves = [look(r) for r in (t.target, *operands)]
            unknown = [i for i, (x, _) in enumerate(leaves) if x is None]
            if len(unknown) != 1:
                continue
            k = unknown[0]
            ref = (t.target, *operands)[k]
            if ref.over or ref.concept in known:
                continue
            values = [x for x, _ in leaves[1:]]
            found = _forward(t.expr, values) if k == 0 else _inverse(t.expr, k - 1, leaves[0][0], values)
            if found is None:
                continue
            ids = [i for _, own in leaves for i in own]
            name = f"{t.id}:{ref.concept}"
            known[ref.concept] = (found, name)
            op = f"{ref.concept} from {render(t.target)} = {render(t.expr)}"
            out.append({"concept": ref.concept, "value": (found[0] + found[1]) / 2, "band": (found[1] - found[0]) / 2, "unit": BY_ID[ref.concept].unit, "template_id": t.id, "op": op, "input_ids": ids, "fact_id": name, "step": len(out)})
        if len(out) == before:
            break
    return out


def derive(rows: DataFrame) -> DataFrame:
    """Derived figures of every slot row, with provenance."""
    # SLOT and AGG_SLOT stay with the worker's module; rows travel without their values and provenance.
    names = {v: k for k, v in SLOT.items()}
    sums = {v: k for k, v in AGG_SLOT.items()}

    columns = [c.split()[0] for c in DERIVED.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                known = {c: ((row[s]["lo"], row[s]["hi"]), row[s]["fact_id"]) for s, c in names.items() if row[s] is not None}
                totals = {key: ((row[s]["lo"], row[s]["hi"]), row[s]["fact_ids"]) for s, key in sums.items() if row[s] is not None}
                period = {k: row[k] for k in PERIOD}
                out += [period | d for d in solve(known, totals, row["period_type"])]
            yield pa.RecordBatch.from_pylist(out, SCHEMA).select(columns)

    return rows.mapInArrow(run, DERIVED)


def augmented(facts: DataFrame, derived: DataFrame) -> DataFrame:
    """Facts and derived figures together; derived ones come last and never replace a fact."""
    like = derived.select(
        *PERIOD, "concept", F.col("value"), "unit", "fact_id", (F.col("value") - F.col("band")).alias("lo"), (F.col("value") + F.col("band")).alias("hi"),
        F.lit("derived").alias("source"), (F.lit(1 << 40) + F.col("step")).alias("ord"), F.array().cast("array<struct<axis:string,member:string>>").alias("dims"),
    )
    keep = [c for c in like.columns if c != "value"]
    return facts.select(*keep, F.col("value").cast("double").alias("value")).unionByName(like)


def propagate(facts: DataFrame, truth: bool = True) -> tuple[DataFrame, DataFrame]:
    """Derived figures, and the results over facts and derived figures."""
    derived = derive(slots(facts))
    return derived, check_slots(slots(augmented(facts, derived)), truth)


def localize(results: DataFrame) -> DataFrame:
    """Suspects behind every violation: a fact vouched for by n satisfied identities scores 1 / (1 + n).

    ``filing_id, fiscal_year, fiscal_period, template_id, fact_id, vouches, score, rank``.
    """
    vouches = results.filter("status = 'satisfied'").select("filing_id", F.explode(F.array_distinct("involved")).alias("fact_id"))
    vouches = vouches.groupBy("filing_id", "fact_id").agg(F.count("*").alias("vouches"))
    accused = results.filter("status = 'violated'").select(*PERIOD, "template_id", F.explode(F.array_distinct("involved")).alias("fact_id"))
    out = accused.join(vouches, ["filing_id", "fact_id"], "left").na.fill(0, ["vouches"])
    order = Window.partitionBy(*PERIOD, "template_id").orderBy("vouches", "fact_id")
    out = out.withColumn("score", F.bround(1 / (1 + F.col("vouches")), 3)).withColumn("rank", F.row_number().over(order))
    return out.select("filing_id", "fiscal_year", "fiscal_period", "template_id", "fact_id", "vouches", "score", "rank")


def inject_fault(facts: DataFrame, amount: float = 5e9) -> DataFrame:
    """The largest revenue segment of every filing and year raised by an amount; its unit, scale and band are reset to those of plain dollars, its decimals stay."""
    mine = F.when(F.col("concept") == "revenue.segment", F.struct("value", -F.col("ord")))
    worst = F.max_by(F.col("fact_id"), mine).over(Window.partitionBy("filing_id", "fiscal_year"))
    hit = (F.col("concept") == "revenue.segment") & (F.col("fact_id") == worst)
    value = F.col("value").cast("double") + F.when(hit, amount).otherwise(0.0)
    plain = F.when(F.col("decimals") <= 0, F.pow(F.lit(10.0), -F.col("decimals")) / 2).otherwise(0.5)
    half = F.when(hit, plain).otherwise((F.col("hi") - F.col("lo")) / 2)
    return facts.withColumn("_v", value).withColumn("_h", half).withColumn("value", F.col("_v")).withColumn("lo", F.col("_v") - F.col("_h")).withColumn("hi", F.col("_v") + F.col("_h")).drop("_v", "_h")
