"""Engine operators against cases computed by hand."""

import hashlib
import json
import time
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.operators import check as ck
from tallyframe.operators import facts as fx
from tallyframe.operators import propagate as pg
from tallyframe.operators import qa, report
from tallyframe.sources import filings, store
from tallyframe.streaming import admission

FACTS = "filing_id string, ord long, concept string, value decimal(38,6), period_type string, fiscal_year int, fiscal_period string, source string, unit string, reported_scale string, decimals int, band double, dims array<struct<axis:string,member:string>>"
M = 1_000_000


def rows(spark, *given, filing="f", source="xbrl", scale="millions", decimals=None):
    """Facts of one year: (concept, value) or (concept, value, dims); balances are instants."""
    instant = ("assets", "liabilities", "equity")
    out = []
    for k, (concept, value, *dims) in enumerate(given):
        pairs = sorted((dims[0] if dims else {}).items())
        out.append((filing, k, concept, Decimal(value), "instant" if concept.startswith(instant) else "duration", 2023, "FY", source, "USD", scale, decimals, None, pairs))
    return spark.createDataFrame(out, FACTS)


def status(results):
    return {r.template_id: r.status for r in results.collect()}


def seg(name, **more):
    return {"segment": name, **more}


def test_clean_and_broken_sums(spark):
    clean = [("revenue.total", 100 * M), ("revenue.segment", 60 * M, seg("A")), ("revenue.segment", 40 * M, seg("B")), ("assets.total", 100 * M), ("liabilities.total", 60 * M), ("equity.total", 40 * M), ("cogs.total", 60 * M), ("gross_profit.total", 40 * M)]
    got = status(ck.check(fx.prepare(rows(spark, *clean)), "xbrl"))
    assert got["bs.balance"] == got["rev.segments_sum"] == got["is.gross_profit"] == "satisfied" and got["bs.lse_crosscheck"] == "indeterminate"
    # A repeated fact is one fact; another value of the same segment is not.
    again = [*clean, ("revenue.segment", 40 * M, seg("B"))]
    assert status(ck.check(fx.prepare(rows(spark, *again)), "xbrl"))["rev.segments_sum"] == "satisfied"
    other = [*clean, ("revenue.segment", 30 * M, seg("B"))]
    found = {r.template_id: r for r in ck.check(fx.prepare(rows(spark, *other)), "xbrl").collect()}["rev.segments_sum"]
    assert (found.status, found.residual) == ("violated", -30.0 * M) and len(found.involved) == 4
    drift = [("revenue.total", 100 * M), ("revenue.segment", 60 * M, seg("A")), ("revenue.segment", 39 * M, seg("B"))]
    found = {r.template_id: r for r in ck.check(fx.prepare(rows(spark, *drift)), "xbrl").collect()}["rev.segments_sum"]
    assert (found.status, found.residual, found.band) == ("satisfied", 1.0 * M, 1.5 * M)
    finer = [*clean, ("revenue.segment", 7 * M, seg("A", product="P")), ("revenue.segment", 0, seg("C", consolidation_item="X"))]
    assert status(ck.check(fx.prepare(rows(spark, *finer)), "xbrl"))["rev.segments_sum"] == "satisfied"


def test_fact_id_is_the_digest_of_json(spark):
    given = [("a", "USD", '1', []), ("a", None, "1", []), ("b", None, "1", []), ('q"uo\\te\n', "USD", "-2.5", [("segment", "M\u00fcller \U0001f600")]), ("a", "USD", "1.000000", [])]
    df = spark.createDataFrame([("f", k, c, Decimal(v), "duration", 2023, "FY", "xbrl", u, "ones", 0, None, d) for k, (c, u, v, d) in enumerate(given)], FACTS)
    got = {r.ord: r.fact_id for r in df.withColumn("fact_id", fx.fact_id()).collect()}
    for k, (c, u, v, d) in enumerate(given):
        value = format(Decimal(v).normalize(), "f")
        blob = json.dumps({"concept": c, "value": value, "period": ["duration", 2023, "FY"], "dims": [list(x) for x in d], "source": "xbrl", "unit": u}, sort_keys=True)
        assert got[k] == hashlib.sha256(blob.encode()).hexdigest()[:16]
    assert [r.ord for r in fx.prepare(df).orderBy("ord").collect()] == [0, 1, 2, 3]


def test_cascade_and_order(spark):
    facts = fx.prepare(rows(spark, ("revenue.total", 100 * M), ("cogs.total", 60 * M), ("operating_income.total", 25 * M), scale="ones", decimals=-6))
    derived, results = pg.propagate(facts)
    got = {r.concept: r for r in derived.collect()}
    assert (got["gross_profit.total"].value, got["gross_profit.total"].band) == (40.0 * M, 1.0 * M)
    assert (got["opex.total"].value, got["opex.total"].band, got["opex.total"].template_id) == (15.0 * M, 1.5 * M, "is.operating_income")
    ratio = got["gross_margin.ratio"]
    assert abs(ratio.value - 0.4) < 1e-3 and ratio.template_id == "margin.gross" and len(ratio.input_ids) == 2 and ratio.unit == "ratio"
    assert status(results)["is.operating_income"] == "satisfied"


def test_every_shape_is_inverted(spark):
    lone = fx.prepare(rows(spark, ("liabilities_and_equity.total", 50 * M), ("assets.current", 20 * M), ("liabilities.total", 30 * M), ("equity.parent", 18 * M), ("equity.nci", 2 * M), scale="ones"))
    got = {r.concept: r.value for r in pg.propagate(lone)[0].collect()}
    # The balance comes first, and there the parent stands in for the total.
    assert (got["assets.total"], got["assets.noncurrent"], got["equity.total"]) == (48.0 * M, 28.0 * M, 20.0 * M)
    flow = fx.prepare(rows(spark, ("revenue.total", 100 * M), ("net_income.parent", 10 * M), ("net_income.consolidated", 12 * M), ("income_tax.total", 3 * M), scale="ones"))
    got = {r.concept: r.value for r in pg.propagate(flow)[0].collect()}
    assert got["net_income.nci"] == 2.0 * M and abs(got["net_margin.ratio"] - 0.1) < 1e-6 and "pretax_income.total" not in got
    zero = fx.prepare(rows(spark, ("pretax_income.total", 0), ("income_tax.total", 3 * M), scale="ones"))
    assert pg.propagate(zero)[0].collect() == []


def test_suspects_lead_back_to_facts(spark):
    facts = fx.prepare(rows(spark, ("revenue.total", 100 * M), ("revenue.segment", 60 * M, seg("A")), ("revenue.segment", 30 * M, seg("B")), ("cogs.total", 60 * M), ("gross_profit.total", 40 * M), scale="ones", decimals=-6))
    suspects = pg.localize(pg.propagate(facts)[1]).filter("template_id = 'rev.segments_sum'").join(facts.select("fact_id", "concept"), "fact_id").orderBy("rank").collect()
    assert [s.concept for s in suspects] == ["revenue.segment", "revenue.segment", "revenue.total"] and suspects[0].score > suspects[2].score


def test_attribution(spark):
    good = [("revenue.total", 100 * M), ("revenue.segment", 60 * M, seg("A")), ("revenue.segment", 40 * M, seg("B"))]
    part = lambda given, name, source: fx.prepare(rows(spark, *given, filing=name, source=source, scale="ones", decimals=-6))
    dollars = lambda total, name, source: fx.prepare(rows(spark, ("revenue.total", total), ("revenue.segment", 100_000, seg("A")), filing=name, source=source, scale="ones"))
    text = part(good[:2], "extraction", "text").union(part([good[0], good[1], ("revenue.segment", 30 * M, seg("B"))], "filing", "text")).union(part(good[:2], "unknown", "text")).union(dollars(90_000, "model", "text"))
    truth = part(good, "extraction", "xbrl").union(part([good[0], good[1], ("revenue.segment", 30 * M, seg("B"))], "filing", "xbrl")).union(part(good[:1], "unknown", "xbrl")).union(dollars(100_000, "model", "xbrl"))
    got = {r.filing_id: r for r in report.attribute(text, truth).collect()}
    assert {k: r.label for k, r in got.items()} == {"extraction": "extraction_error", "filing": "filing_inconsistency", "unknown": "undetermined", "model": "constraint_model_error"}
    assert got["extraction"].evidence == "revenue.segment[segment]: text=60,000,000 vs xbrl=100,000,000 (delta -40,000,000)" and got["extraction"].judge_invisible


def test_verify_answers_by_hand(spark):
    truth = spark.createDataFrame([("f", "revenue.total", 2023, 100.0 * M), ("f", "net_margin.ratio", 2023, 0.1)], "filing_id string, concept string, fiscal_year int, truth double")
    cite = "array<struct<label:string,concept:string,fiscal_year:int,value:double>>"
    given = [
        ("null value", [("r", "revenue.total", 2023, None)], (1, 1, 0, False, False)),
        ("year of the answer", [("r", "revenue.total", None, 100.5 * M)], (1, 1, 1, True, True)),
        ("no concept", [("r", None, 2023, 1.0)], (1, 0, 0, False, False)),
        ("ratio in the money band", [("r", "net_margin.ratio", 2023, 0.9)], (1, 1, 1, True, True)),
        ("off", [("r", "revenue.total", 2023, 103.0 * M)], (1, 1, 0, False, False)),
    ]
    answers = spark.createDataFrame([(n, "f", 2023, None, c) for n, c, _ in given], f"answer_id string, filing_id string, fiscal_year int, value double, numbers_used {cite}")
    got = {r.answer_id: (r.n_cited, r.n_graded, r.n_ok, r.retrieval_ok, r.trusted) for r in qa.verify(answers, truth).collect()}
    assert got == {n: w for n, _, w in given}


def plain_window(text, before=3000, size=170_000):
    upper = text.upper()
    hits = sorted(i for a in tx.ANCHORS for i in range(len(upper)) if upper.startswith(a, i))
    if not hits:
        return text[:size]
    start = max(0, next((h for h in hits if h >= 0.2 * len(text)), hits[0]) - before)
    return text[start : start + size]


def test_financial_window(spark):
    pad = lambda n: "x" * n
    head = "Consolidated Statements of Cash Flows"
    texts = ["", "no heading", head, head + pad(9000), pad(100) + head + pad(9000) + "consolidated balance sheets" + pad(3000), pad(4000) + head + pad(16_000 - len(head)), pad(3999) + head + pad(16_001 - len(head)), pad(200_000) + "CONSOLIDATED STATEMENT OF EARNINGS" + pad(200_000), None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.w for r in df.select("k", tx.financial_window(F.col("t")).alias("w")).collect()}
    assert got == {k: None if t is None else plain_window(t) for k, t in enumerate(texts)}


def test_html_to_text(spark):
    pages = ["<head><title>t</title></head><p>a &amp; b<script>x</script><p>c\u00a0 d</style>e", "<p>open<head>gone", "", None, "one &eacute;<br/>two"]
    got = [r.t for r in spark.createDataFrame([(p,) for p in pages], "h string").select(tx.html_to_text("h").alias("t")).collect()]
    assert got == ["a & b c d e", "open", "", None, "one \u00e9 two"]


def test_reply_keeps_dimensions(spark):
    reply = json.dumps([{"concept": "revenue.segment", "value": "5", "scale": "millions", "fiscal_year": 2023, "period_type": "odd", "dimensions": {"segment": "B", "product": "P"}}, {"concept": "revenue.total", "value": "9", "fiscal_year": 2023}])
    from tallyframe.plans.ontology import concepts

    got = {r.concept: r for r in tx.reply_facts(spark.createDataFrame([("k", reply)], "request_key string, response string"), concepts(spark)).collect()}
    assert [tuple(d) for d in got["revenue.segment"].dims] == [("product", "P"), ("segment", "B")] and got["revenue.total"].dims == [] and got["revenue.segment"].period_type == "duration"


def test_request_key_depends_on_everything(spark):
    one = lambda *a, **k: spark.range(1).select(tx.request_key(*[F.lit(x) for x in a], **k)).first()[0]
    base = one("m", "p1", "a1", "text")
    want = json.dumps({"adapter_version": "a1", "model_id": "m", "params": {"max_tokens": 8192, "seed": 0, "temperature": 0.0, "top_p": 1.0}, "prompt_version": "p1", "rendered_prompt": "text"}, separators=(",", ":"))
    assert base == hashlib.sha256(want.encode()).hexdigest()
    assert len({base, one("n", "p1", "a1", "text"), one("m", "p2", "a1", "text"), one("m", "p1", "a2", "text"), one("m", "p1", "a1", "other"), one("m", "p1", "a1", "text", params={"temperature": 0.7})}) == 6
    assert "- revenue.segment\n" in tx.render_prompt() and "ratio" not in tx.render_prompt().split("\n", 1)[1]


def test_stores(spark, tmp_path):
    path = f"{tmp_path}/responses"
    first = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "request_key string, response string")
    assert sorted(map(tuple, store.append_responses(first, path).collect())) == [("a", "1"), ("b", "3")]
    more = spark.createDataFrame([("b", "new"), ("c", "4")], "request_key string, response string")
    assert sorted(map(tuple, store.append_responses(more, path).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    parts = {"facts": spark.createDataFrame([("f", "x", 1), ("f", "y", 2)], "filing_id string, c string, v int"), "notes": spark.createDataFrame([("g", "n")], "filing_id string, t string")}
    made = store.analysis_json(parts)
    assert {r.filing_id: json.loads(r.analysis) for r in made.collect()} == {"f": {"filing_id": "f", "facts": [{"c": "x", "v": 1}, {"c": "y", "v": 2}], "notes": []}, "g": {"filing_id": "g", "facts": [], "notes": [{"t": "n"}]}}
    wanted = spark.createDataFrame([("f",), ("h",)], "filing_id string")
    held, todo = store.cached_analyses(wanted, made)
    assert [r.filing_id for r in held.collect()] == ["f"] and [r.filing_id for r in todo.collect()] == ["h"]
    assert sorted(r.filing_id for r in store.cached_analyses(wanted, made, force=True)[1].collect()) == ["f", "h"]
    store.write_leaderboard(spark.createDataFrame([("z", 1.0), ("a", 0.5)], "model string, final double"), f"{tmp_path}/board")
    assert [r.model for r in spark.read.json(f"{tmp_path}/board").collect()] == ["a", "z"]
    turns = spark.createDataFrame([("q", 2, "b", 2023, None), ("q", 1, "a", 2023, 1.0), ("r", 1, None, None, None)], "answer_id string, turn int, concept string, fiscal_year int, value double")
    assert [(r.answer_id, [tuple(c) for c in r.tool_calls]) for r in store.transcript_calls(turns).collect()] == [("q", [("a", 2023, 1.0), ("b", 2023, None)])]


def test_sources_from_files(spark, tmp_path):
    (tmp_path / "tickers.json").write_text(json.dumps({"0": {"cik_str": 12, "ticker": "ab", "title": "A B"}, "1": {"cik_str": 345, "ticker": "cd", "title": "C D"}}))
    assert sorted(map(tuple, filings.read_companies(spark, f"{tmp_path}/tickers.json").collect())) == [(0, "AB", "0000000012", "A B"), (1, "CD", "0000000345", "C D")]
    gold = {"questions": [{"question_id": "q1", "prompt": "p", "gold_answer": {"value": 1.5}, "verified": True}, {"question_id": "q2", "draft_confidence": "low", "gold_answer": {"value": "x"}}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    got = filings.gold_questions(filings.read_json_texts(spark, f"{tmp_path}/gold.json"))
    assert [(r.question_id, r.value and float(r.value), r.fiscal_period, r.verified) for r in got.orderBy("ord").collect()] == [("q1", 1.5, "FY", True), ("q2", None, "FY", False)]
    assert [r.question_id for r in qa.triage(got).collect()] == ["q2"]


def test_admission_boundary(spark, tmp_path):
    hour = admission.HOUR_US
    calls = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, hour), (1, 4, hour + 1), (1, 5, hour + 2), (2, 6, 5), (None, 7, 5)], "key long, call_id long, at_us long")
    got = {r.call_id: r.admitted for r in admission.admit(calls, limit=2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}
    calls.filter("key IS NOT NULL").coalesce(1).write.parquet(f"{tmp_path}/calls")
    stream = admission.admit_stream(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/calls"), limit=2)
    query = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/state").start()
    for _ in range(90):  # state with timeouts always has another batch to run, so the stream is stopped once all calls are through
        if spark.table("admitted").count() == 6:
            break
        time.sleep(1)
    query.stop()
    assert {r.call_id: r.admitted for r in spark.table("admitted").collect()} == got
