"""Fact tables: identity, rounding bands, deduplication, slots.

``facts``: filing_id, ord, concept, value decimal, period_type, fiscal_year, fiscal_period, source, unit,
reported_scale, decimals, band, dims array<struct<axis, member>>. ``ord`` is the order of
extraction; every first-wins rule goes by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.identities import AGG_SLOT, SLOT

PERIOD = ["filing_id", "period_type", "fiscal_year", "fiscal_period"]
DIMS = "array<struct<axis:string,member:string>>"
#: Axes that break a segment down further; others only choose a view.
FINER = ("product", "geography")


def half_band(decimals: Column, unit: Column, scale: Column) -> Column:
    """Half the rounding step: by decimals if they are 0 or negative, else by the reported scale of dollars."""
    by_scale = F.when(scale.isin("thousands"), 500.0).when(scale == "millions", 500_000.0).otherwise(0.5)
    return F.when(decimals <= 0, F.pow(F.lit(10.0), -decimals) / 2).when(F.coalesce(unit, F.lit("")) != "USD", 0.0).otherwise(by_scale)


def json_string(c: str) -> str:
    """SQL of a JSON string as json.dumps writes it: quotes, backslashes and controls escaped, other than ASCII as escaped UTF-16 units; null stays JSON null."""
    plain = rf"regexp_replace(to_json(array({c})), r'^\[|\]$', '')"
    units = "lower(hex(encode(x, 'UTF-16BE')))"
    escaped = rf"concat(r'\u', substring({units}, 1, 4), CASE WHEN length({units}) > 4 THEN concat(r'\u', substring({units}, 5, 4)) ELSE '' END)"
    # to_json leaves characters beyond ASCII as they are.
    each = rf"transform(split({plain}, ''), x -> CASE WHEN x RLIKE r'^[\x00-\x7f]*$' THEN x ELSE {escaped} END)"
    return rf"CASE WHEN {c} IS NULL THEN 'null' WHEN {plain} RLIKE r'^[\x00-\x7e]*$' THEN {plain} ELSE array_join({each}, '') END"


def value_text(value: str) -> str:
    """SQL of a decimal as text without trailing zeros of its scale, so that the text does not depend on the column's type."""
    return rf"CASE WHEN CAST({value} AS string) LIKE '%.%' THEN regexp_replace(regexp_replace(CAST({value} AS string), '0+$', ''), r'\.$', '') ELSE CAST({value} AS string) END"


def fact_id() -> Column:
    """First 16 hex digits of SHA-256 over the fact's canonical JSON (sorted keys, as written by json.dumps)."""
    q = json_string
    pairs = f"array_join(transform(dims, d -> concat('[', {q('d.axis')}, ', ', {q('d.member')}, ']')), ', ')"
    parts = [
        "'{\"concept\": '", q("concept"), "', \"dims\": ['", pairs, "'], \"period\": ['", q("period_type"), "', '", "coalesce(CAST(fiscal_year AS string), 'null')", "', '", q("fiscal_period"),
        "'], \"source\": '", q("source"), "', \"unit\": '", q("unit"), "', \"value\": '", q(value_text("value")), "'}'",
    ]
    return F.expr(f"substring(sha2(concat({', '.join(parts)}), 256), 1, 16)")


def is_consolidated() -> Column:
    """No dimensions."""
    return F.size("dims") == 0


def is_aggregable(axis: str) -> Column:
    """Has the axis and no other axis that breaks it down further."""
    finer = [a for a in FINER if a != axis]
    return F.exists("dims", lambda d: d["axis"] == axis) & ~F.exists("dims", lambda d: d["axis"].isin(finer))


def prepare(facts: DataFrame, deduplicated: bool = True) -> DataFrame:
    """Canonical dims, content id, and the interval around the value (explicit band first); of facts with equal content in a filing the first only."""
    df = facts.withColumn("dims", F.array_sort(F.coalesce("dims", F.array().cast(DIMS)))).withColumn("fact_id", fact_id())
    half = F.coalesce(F.col("band").cast("double"), half_band(F.col("decimals"), F.col("unit"), F.col("reported_scale")))
    value = F.col("value").cast("double")
    df = df.withColumn("lo", value - half).withColumn("hi", value + half)
    return deduplicate(df) if deduplicated else df


def deduplicate(facts: DataFrame) -> DataFrame:
    """The first of facts with equal content in a filing."""
    rank = F.row_number().over(Window.partitionBy("filing_id", "fact_id").orderBy("ord"))
    return facts.withColumn("_n", rank).filter("_n = 1").drop("_n")


def query(facts: DataFrame, concept: str | None = None, fiscal_year: int | None = None, dims: list[tuple[str, str]] | None = None, source: str | None = None) -> DataFrame:
    """Facts by concept, year, exact dimensions (an empty list: consolidated; None: any) and source, in order."""
    for name, value in (("concept", concept), ("fiscal_year", fiscal_year), ("source", source)):
        facts = facts if value is None else facts.filter(F.col(name) == value)
    if dims is not None:
        want = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(m).alias("member")) for a, m in sorted(dims)]).cast(DIMS)
        facts = facts.filter(F.col("dims") == want)
    return facts.orderBy("filing_id", "ord")


def periods(facts: DataFrame) -> DataFrame:
    """Distinct periods of each filing, newest first."""
    return facts.select(*PERIOD).distinct().orderBy("filing_id", F.desc("fiscal_year"), "period_type")


def slots(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per filing and period (and ``by``): the first fact of each consolidated concept, and the sum over each aggregate.

    One shuffle on the period key with partial aggregation; each fact carries the name of the slot it goes to.
    """
    names = "map(" + ", ".join(f"'{c}', '{name}'" for c, name in SLOT.items()) + ")"
    slot = F.when(is_consolidated(), F.expr(f"try_element_at({names}, concept)"))
    for (concept, axis), name in AGG_SLOT.items():
        slot = F.when((F.col("concept") == concept) & is_aggregable(axis), name).otherwise(slot)
    rows = facts.select(*by, *PERIOD, "ord", "lo", "hi", "value", "fact_id", slot.alias("slot"), F.struct("lo", "hi", F.col("value").cast("double").alias("value"), "fact_id").alias("f"))
    columns = [F.expr(f"min_by(f, ord) FILTER (WHERE slot = '{name}') AS {name}") for name in SLOT.values()]
    for name in AGG_SLOT.values():
        mine = f"FILTER (WHERE slot = '{name}')"
        ids = f"transform(array_sort(collect_list(struct(ord, fact_id)) {mine}), x -> x.fact_id)"
        parts = f"named_struct('lo', sum(lo) {mine}, 'hi', sum(hi) {mine}, 'value', CAST(sum(value) {mine} AS DOUBLE), 'fact_ids', {ids})"
        columns.append(F.expr(f"CASE WHEN count(*) {mine} > 0 THEN {parts} END AS {name}"))
    return rows.groupBy(*by, *PERIOD).agg(*columns)
