"""Fact tables out of the star-schema test tables.

A filing is a nation and a year of its customers' orders, in whole dollars; ratios have four places. Rounding differs by filing
and concept. The text facts are the trusted ones with deliberate faults (a segment dropped or inflated, a total off by its scale,
cost of sales missing, facts repeated), each chosen by arithmetic on nation and year, so that every outcome of every identity
occurs. ``BASE`` says the same in SQL, for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import DIMS, prepare

BASE = """
base AS (
  SELECT c.c_nationkey AS n, year(o.o_orderdate) AS y, c.c_mktsegment AS seg, o.o_orderkey AS k, CAST(floor(o.o_totalprice) AS bigint) AS v
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice IS NOT NULL AND o.o_orderdate IS NOT NULL),
segs AS (SELECT n, y, seg, CAST(sum(v) AS bigint) AS sv FROM base GROUP BY n, y, seg),
bal AS (SELECT c_nationkey AS n, CAST(sum(CAST(floor(abs(c_acctbal)) AS bigint)) AS bigint) * 100 + 5000000 AS a FROM {customer} GROUP BY c_nationkey),
tot AS (SELECT n, y, CAST(sum(v) AS bigint) AS total, CAST(sum(CASE WHEN k % 3 <> 0 THEN v ELSE 0 END) AS bigint) AS cogs FROM base GROUP BY n, y),
inc AS (SELECT tot.*, a, CAST(floor(a * 0.6E0) AS bigint) AS li, total - cogs AS g, CASE WHEN (tot.n + y) % 9 = 4 THEN CAST(floor(total * 1.07E0) AS bigint) ELSE total END AS rev FROM tot JOIN bal ON tot.n = bal.n),
fig AS (SELECT *, CAST(floor(g * 0.5E0) AS bigint) AS op, CASE WHEN n % 12 = 11 THEN 0 ELSE CAST(floor(g * 0.45E0) AS bigint) END AS pre, CAST(floor(g * 0.1E0) AS bigint) AS tax,
  CAST(floor(g * 0.35E0) AS bigint) AS net, a - li + CASE WHEN (n + y) % 8 = 3 THEN 2500000 ELSE 0 END AS eq FROM inc),
one AS (
  SELECT n, y, 1 AS ord, 'revenue.total' AS concept, 'duration' AS kind, rev * 10000 AS v4 FROM fig
  UNION ALL SELECT n, y, 30, 'cogs.total', 'duration', cogs * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 31, 'gross_profit.total', 'duration', (rev - cogs + CASE WHEN (n + y) % 10 = 7 THEN 1000000 ELSE 0 END) * 10000::BIGINT FROM fig WHERE n % 4 <> 2
  UNION ALL SELECT n, y, 32, 'operating_income.total', 'duration', op * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 33, 'opex.total', 'duration', (rev - cogs - op + CASE WHEN (n + y) % 8 = 6 THEN 1500000 ELSE 0 END) * 10000::BIGINT FROM fig WHERE n % 5 <> 0
  UNION ALL SELECT n, y, 60, 'pretax_income.total', 'duration', pre * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 61, 'income_tax.total', 'duration', tax * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 62, 'net_income.parent', 'duration', (net + CASE WHEN n % 5 = 3 THEN 1500000 ELSE 0 END) * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 63, 'net_income.consolidated', 'duration', net * 10000::BIGINT FROM fig WHERE n % 2 = 0
  UNION ALL SELECT n, y, 64, 'net_income.nci', 'duration', CASE WHEN (n + y) % 3 = 0 THEN 250000 ELSE 0 END * 10000::BIGINT FROM fig WHERE n % 2 = 0
  UNION ALL SELECT n, y, 65, 'income.equity_method', 'duration', -200000 * 10000::BIGINT FROM fig WHERE n % 7 = 5
  UNION ALL SELECT n, y, 66, 'income.discontinued', 'duration', 400000 * 10000::BIGINT FROM fig WHERE n % 7 = 3
  UNION ALL SELECT n, y, 67, 'cfo.total', 'duration', op * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 70, 'assets.total', 'instant', a * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 71, 'liabilities.total', 'instant', li * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 72, CASE WHEN n % 2 = 0 THEN 'equity.total' ELSE 'equity.parent' END, 'instant', eq * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 73, 'equity.temporary', 'instant', 2500000 * 10000::BIGINT FROM fig WHERE n % 6 = 5
  UNION ALL SELECT n, y, 74, 'liabilities_and_equity.total', 'instant', (a + CASE WHEN (n + y) % 9 = 1 THEN 3000000 ELSE 0 END) * 10000::BIGINT FROM fig WHERE n % 4 <> 1
  UNION ALL SELECT n, y, 75, 'assets.current', 'instant', CAST(floor(a * 0.3E0) AS bigint) * 10000::BIGINT FROM fig
  UNION ALL SELECT n, y, 76, 'assets.noncurrent', 'instant', (a - CAST(floor(a * 0.3E0) AS bigint) + CASE WHEN (n + y) % 7 = 2 THEN 4000000 ELSE 0 END) * 10000::BIGINT FROM fig WHERE n % 3 <> 2
  UNION ALL SELECT n, y, 77, 'liabilities.current', 'instant', CAST(floor(li * 0.4E0) AS bigint) * 10000::BIGINT FROM fig WHERE n % 3 <> 1
  UNION ALL SELECT n, y, 78, 'liabilities.noncurrent', 'instant', (li - CAST(floor(li * 0.4E0) AS bigint) + CASE WHEN (n + y) % 5 = 4 THEN 2000000 ELSE 0 END) * 10000::BIGINT FROM fig WHERE n % 3 <> 1
  UNION ALL SELECT n, y, 79, 'equity.parent', 'instant', (eq - CAST(floor(a * 0.02E0) AS bigint)) * 10000::BIGINT FROM fig WHERE n % 4 = 0
  UNION ALL SELECT n, y, 80, 'equity.nci', 'instant', (CAST(floor(a * 0.02E0) AS bigint) + CASE WHEN (n + y) % 6 = 5 THEN 3000000 ELSE 0 END) * 10000::BIGINT FROM fig WHERE n % 4 = 0
  UNION ALL SELECT n, y, 90, 'gross_margin.ratio', 'duration', CAST(floor((rev - cogs) * 10000E0 / rev) AS bigint) + CASE WHEN (n + y) % 6 = 3 THEN 200 ELSE 0 END FROM fig WHERE n % 3 = 0
  UNION ALL SELECT n, y, 91, 'operating_margin.ratio', 'duration', CAST(floor(op * 10000E0 / rev) AS bigint) + CASE WHEN (n + y) % 7 = 5 THEN 150 ELSE 0 END FROM fig WHERE n % 3 = 0
  UNION ALL SELECT n, y, 92, 'net_margin.ratio', 'duration', CAST(floor((net + CASE WHEN n % 5 = 3 THEN 1500000 ELSE 0 END) * 10000E0 / rev) AS bigint) - CASE WHEN (n + y) % 5 = 0 THEN 200 ELSE 0 END FROM fig WHERE n % 4 = 1
  UNION ALL SELECT n, y, 93, 'effective_tax_rate.ratio', 'duration', CASE WHEN pre = 0 THEN 2222 ELSE CAST(floor(tax * 10000E0 / pre) AS bigint) END + CASE WHEN (n + y) % 6 = 2 THEN 300 ELSE 0 END FROM fig WHERE n % 4 = 3),
truth AS (
  SELECT n, y, ord, concept, kind, v4, CAST(NULL AS varchar(32)) AS seg, CAST(NULL AS varchar(32)) AS more FROM one
  UNION ALL SELECT n, y, 10 + CAST(ascii(seg) AS int) - 65, 'revenue.segment', 'duration', sv * 10000, seg, NULL FROM segs WHERE n % 10 <> 7
  UNION ALL SELECT n, y, 200 + CAST(ascii(seg) AS int) - 65, 'revenue.segment', 'duration', CAST(floor(sv * 0.5E0) AS bigint) * 10000, seg, 'product' FROM segs WHERE n % 8 = 1
  UNION ALL SELECT n, y, 300, 'revenue.segment', 'duration', 0, 'ELIMINATIONS', 'consolidation_item' FROM fig WHERE n % 8 = 2
  UNION ALL SELECT n, y, 40 + CAST(ascii(seg) AS int) - 65, 'operating_income.segment', 'duration', CAST(floor(sv * CASE WHEN y % 2 = 0 THEN 0.5E0 ELSE 0.15E0 END * (1 - CASE WHEN y % 2 = 0 THEN cogs * 1E0 / total ELSE 0E0 END)) AS bigint) * 10000, seg, NULL
    FROM segs JOIN (SELECT n AS fn, y AS fy, cogs, total FROM fig) ON fn = n AND fy = y WHERE n % 3 = 1),
told AS (
  SELECT n, y, ord, concept, kind, seg, more,
    CASE WHEN concept = 'revenue.segment' AND seg = 'MACHINERY' AND more IS NULL AND (n + y) % 5 = 2 THEN CAST(floor(v4 / 10000 * 1.2E0) AS bigint) * 10000
         WHEN concept = 'revenue.total' AND n % 11 = 5 THEN CAST(floor(v4 / 10000 / 1000E0) AS bigint) * 10000
         WHEN concept = 'assets.total' AND (n + y) % 6 = 1 THEN v4 * 2 ELSE v4 END AS v4
  FROM truth
  WHERE NOT (concept = 'revenue.segment' AND seg = 'BUILDING' AND (n + y) % 7 = 3) AND NOT (concept = 'cogs.total' AND n % 6 = 1)),
versions AS (
  SELECT *, 'xbrl' AS source FROM truth
  UNION ALL SELECT n, y, 1000 + ord, concept, kind, v4, seg, more, 'text' FROM told
  UNION ALL SELECT n, y, 1500 + ord, concept, kind, v4, seg, more, 'text' FROM told WHERE n % 9 = 2 AND concept = 'revenue.total' OR n % 9 = 4 AND concept = 'revenue.segment'
  UNION ALL SELECT n, y, 2000 + ord, concept, kind, v4 + 70000000000, seg, more, 'text' FROM told WHERE n % 9 = 3 AND concept = 'revenue.total'
  UNION ALL SELECT n, y, 3000 + ord, 'gross_profit.total', kind, v4, seg, more, 'text' FROM told WHERE n % 4 = 2 AND concept = 'cogs.total'),
stated AS (
  SELECT concat(CAST(n AS varchar(12)), '-', CAST(y AS varchar(12))) AS filing_id, CAST(ord AS bigint) AS ord, concept, v4, CAST(v4 AS DOUBLE) / 10000 AS v, kind AS period_type, CAST(y AS int) AS fiscal_year, source, seg, more,
    CASE WHEN concept LIKE '%.ratio' THEN 'ratio' WHEN concept = 'cfo.total' AND n % 2 = 0 THEN NULL ELSE 'USD' END AS unit,
    CASE WHEN source = 'text' THEN CASE n % 3 WHEN 0 THEN 'ones' WHEN 1 THEN 'thousands' ELSE 'millions' END ELSE 'ones' END AS reported_scale,
    CASE WHEN source = 'text' THEN NULL WHEN concept LIKE '%.ratio' THEN 4 WHEN n % 4 = 2 THEN -3 WHEN n % 4 = 3 THEN -5 ELSE 0 END AS decimals
  FROM versions),
every AS (
  SELECT *, CASE WHEN decimals <= 0 THEN pow(10.0, -decimals) / 2 WHEN coalesce(unit, '') <> 'USD' THEN 0.0 WHEN reported_scale = 'thousands' THEN 500.0 WHEN reported_scale = 'millions' THEN 500000.0 ELSE 0.5 END::DOUBLE AS half FROM stated),
facts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY filing_id, concept, period_type, source, v, seg, more, unit ORDER BY ord) = 1)"""


def with_facts(orders: str = "orders", customer: str = "customer") -> str:
    """``WITH`` clause whose last table is ``facts``, each once."""
    return "WITH " + BASE.format(orders=orders, customer=customer)


def _floor(c) -> Column:
    return F.floor(c).cast("long")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted facts ``n, y, ord, concept, kind, v4, seg, more`` (``v4``: ten thousandths): one aggregation, then every figure of a row at once."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL")
    o = o.select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("k"), _floor("o_totalprice").alias("v"))
    base = o.join(c.drop("c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    segs = base.groupBy("n", "y", "seg").agg(F.sum("v").alias("sv"), F.sum(F.when(F.col("k") % 3 != 0, F.col("v")).otherwise(0)).alias("cogs"))
    w = segs.groupBy("n", "y").agg(F.sum("sv").alias("total"), F.sum("cogs").alias("cogs"), F.collect_list(F.struct("seg", "sv")).alias("segs"))
    w = w.join(c.groupBy("n").agg((F.sum(_floor(F.abs("c_acctbal"))) * 100 + 5_000_000).alias("a")), "n")
    w = w.selectExpr("*", "CASE WHEN (n + y) % 9 = 4 THEN CAST(floor(total * 1.07D) AS bigint) ELSE total END AS rev", "total - cogs AS g", "CAST(floor(a * 0.6D) AS bigint) AS li")
    floor = lambda x: f"CAST(floor({x}) AS bigint)"
    plus = lambda rule, k: f"CASE WHEN {rule} THEN {k}L ELSE 0L END"
    w = w.selectExpr(
        "*", f"{floor('g * 0.5D')} AS op", f"CASE WHEN n % 12 = 11 THEN 0L ELSE {floor('g * 0.45D')} END AS pre", f"{floor('g * 0.1D')} AS tax", f"{floor('g * 0.35D')} AS net",
        f"a - li + {plus('(n + y) % 8 = 3', 2_500_000)} AS eq", f"{floor('a * 0.3D')} AS cur", f"{floor('li * 0.4D')} AS lcur", f"{floor('a * 0.02D')} AS nci",
    )
    parent = f"(net + {plus('n % 5 = 3', 1_500_000)})"
    share = lambda top, bottom: floor(f"try_divide({top} * 10000D, {bottom})")
    # Order, concept, period type, dollars (ratios: ten thousandths) and which nations and years have it.
    figures = [
        (1, "revenue.total", "duration", "rev", ""), (30, "cogs.total", "duration", "cogs", ""), (31, "gross_profit.total", "duration", f"rev - cogs + {plus('(n + y) % 10 = 7', 1_000_000)}", "n % 4 <> 2"),
        (32, "operating_income.total", "duration", "op", ""), (33, "opex.total", "duration", f"rev - cogs - op + {plus('(n + y) % 8 = 6', 1_500_000)}", "n % 5 <> 0"),
        (60, "pretax_income.total", "duration", "pre", ""), (61, "income_tax.total", "duration", "tax", ""), (62, "net_income.parent", "duration", parent, ""),
        (63, "net_income.consolidated", "duration", "net", "n % 2 = 0"), (64, "net_income.nci", "duration", plus("(n + y) % 3 = 0", 250_000), "n % 2 = 0"),
        (65, "income.equity_method", "duration", "-200000L", "n % 7 = 5"), (66, "income.discontinued", "duration", "400000L", "n % 7 = 3"), (67, "cfo.total", "duration", "op", ""),
        (70, "assets.total", "instant", "a", ""), (71, "liabilities.total", "instant", "li", ""), (72, "equity.total", "instant", "eq", "n % 2 = 0"), (72, "equity.parent", "instant", "eq", "n % 2 = 1"),
        (73, "equity.temporary", "instant", "2500000L", "n % 6 = 5"), (74, "liabilities_and_equity.total", "instant", f"a + {plus('(n + y) % 9 = 1', 3_000_000)}", "n % 4 <> 1"),
        (75, "assets.current", "instant", "cur", ""), (76, "assets.noncurrent", "instant", f"a - cur + {plus('(n + y) % 7 = 2', 4_000_000)}", "n % 3 <> 2"),
        (77, "liabilities.current", "instant", "lcur", "n % 3 <> 1"), (78, "liabilities.noncurrent", "instant", f"li - lcur + {plus('(n + y) % 5 = 4', 2_000_000)}", "n % 3 <> 1"),
        (79, "equity.parent", "instant", "eq - nci", "n % 4 = 0"), (80, "equity.nci", "instant", f"nci + {plus('(n + y) % 6 = 5', 3_000_000)}", "n % 4 = 0"),
        (90, "gross_margin.ratio", "duration", f"{share('(rev - cogs)', 'rev')} + {plus('(n + y) % 6 = 3', 200)}", "n % 3 = 0"),
        (91, "operating_margin.ratio", "duration", f"{share('op', 'rev')} + {plus('(n + y) % 7 = 5', 150)}", "n % 3 = 0"),
        (92, "net_margin.ratio", "duration", f"{share(parent, 'rev')} - {plus('(n + y) % 5 = 0', 200)}", "n % 4 = 1"),
        (93, "effective_tax_rate.ratio", "duration", f"coalesce({share('tax', 'pre')}, 2222L) + {plus('(n + y) % 6 = 2', 300)}", "n % 4 = 3"),
    ]

    def row(ord_, concept, kind, v4, seg="CAST(NULL AS string)", more="CAST(NULL AS string)"):
        return f"named_struct('ord', CAST({ord_} AS bigint), 'concept', '{concept}', 'kind', '{kind}', 'v4', CAST({v4} AS bigint), 'seg', {seg}, 'more', {more})"

    def by_segment(first, concept, rule, dollars, more="CAST(NULL AS string)"):
        each = f"transform(segs, s -> {row(f'{first} + ascii(s.seg) - 65', concept, 'duration', f'{dollars} * 10000', 's.seg', more)})"
        return f"CASE WHEN {rule} THEN {each} ELSE slice({each}, 1, 0) END"

    single = []
    for ord_, concept, kind, v, rule in figures:
        one = row(ord_, concept, kind, v if concept.endswith(".ratio") else f"({v}) * 10000")
        single.append(f"CASE WHEN {rule} THEN {one} END" if rule else one)
    single.append(f"CASE WHEN n % 8 = 2 THEN {row(300, 'revenue.segment', 'duration', 0, chr(39) + 'ELIMINATIONS' + chr(39), chr(39) + 'consolidation_item' + chr(39))} END")
    part = "s.sv * CASE WHEN y % 2 = 0 THEN 0.5D ELSE 0.15D END * (1 - CASE WHEN y % 2 = 0 THEN cogs * 1D / total ELSE 0D END)"
    every = [
        f"array_compact(array({', '.join(single)}))", by_segment(10, "revenue.segment", "n % 10 <> 7", "s.sv"), by_segment(200, "revenue.segment", "n % 8 = 1", floor("s.sv * 0.5D"), "'product'"),
        by_segment(40, "operating_income.segment", "n % 3 = 1", floor(part)),
    ]
    return w.selectExpr("n", "y", f"inline(concat({', '.join(every)}))")


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts as an extractor delivers them, copies included."""
    n, y, v4, concept, seg = (F.col(c) for c in ("n", "y", "v4", "concept", "seg"))
    whole = v4 / 10_000
    told = (
        F.when((concept == "revenue.segment") & (seg == "MACHINERY") & F.col("more").isNull() & ((n + y) % 5 == 2), _floor(whole * 1.2) * 10_000)
        .when((concept == "revenue.total") & (n % 11 == 5), _floor(whole / 1000) * 10_000).when((concept == "assets.total") & ((n + y) % 6 == 1), v4 * 2).otherwise(v4)
    )
    kept = ~F.coalesce((concept == "revenue.segment") & (seg == "BUILDING") & ((n + y) % 7 == 3), F.lit(False)) & ~((concept == "cogs.total") & (n % 6 == 1))
    version = lambda source, shift, value, name=concept: F.struct(F.lit(source).alias("source"), (F.col("ord") + shift).alias("ord"), value.alias("v4"), name.alias("concept"))
    again = (n % 9 == 2) & (concept == "revenue.total") | (n % 9 == 4) & (concept == "revenue.segment")
    versions = F.array(
        version("xbrl", 0, v4), F.when(kept, version("text", 1000, F.col("told"))), F.when(kept & again, version("text", 1500, F.col("told"))),
        F.when((n % 9 == 3) & (concept == "revenue.total"), version("text", 2000, F.col("told") + 70_000_000_000)),
        F.when(kept & (n % 4 == 2) & (concept == "cogs.total"), version("text", 3000, F.col("told"), F.lit("gross_profit.total"))),
    )
    df = _truth(spark, sf_dir).withColumn("told", told).withColumn("versions", F.array_compact(versions)).drop("ord", "v4", "concept")
    df = df.select("n", "y", "kind", "seg", "more", F.inline("versions"))
    axis = lambda name, member: F.struct(F.lit(name).alias("axis") if isinstance(name, str) else name.alias("axis"), member.alias("member"))
    none = F.array().cast(DIMS)
    dims = F.concat(F.when(seg.isNotNull(), F.array(axis("segment", seg))).otherwise(none), F.when(F.col("more").isNotNull(), F.array(axis(F.col("more"), F.lit("P")))).otherwise(none))
    text, ratio = F.col("source") == "text", concept.endswith(".ratio")
    scale = F.when(~text, "ones").when(n % 3 == 0, "ones").when(n % 3 == 1, "thousands").otherwise("millions")
    decimals = F.when(text, F.lit(None)).when(ratio, 4).when(n % 4 == 2, -3).when(n % 4 == 3, -5).otherwise(0)
    unit = F.when(ratio, "ratio").when((concept == "cfo.total") & (n % 2 == 0), F.lit(None)).otherwise("USD")
    return df.select(
        F.concat(n.cast("string"), F.lit("-"), y.cast("string")).alias("filing_id"), "ord", "concept", (v4.cast("decimal(24,4)") / 10_000).cast("decimal(24,4)").alias("value"),
        F.col("kind").alias("period_type"), y.alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), "source", unit.alias("unit"), scale.alias("reported_scale"), decimals.cast("int").alias("decimals"),
        F.lit(None).cast("double").alias("band"), dims.alias("dims"),
    )


def facts(spark: SparkSession, sf_dir: str, source: str | None = None) -> DataFrame:
    """Prepared facts, of one source if given."""
    df = raw_facts(spark, sf_dir)
    return prepare(df if source is None else df.filter(F.col("source") == source))
