"""DuckDB SQL of the registered queries.

Nothing here is taken from the engine's own identities: they are written down once more, in a notation of their own, and compiled to SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from .ontology import CONCEPTS
from .projection import with_facts

# The sixteen identities in order; | is a fallback, ? counts as zero where absent.
SPEC = """
bs.balance                | hard | money | instant  | assets.total = liabilities.total + equity.total|equity.parent + equity.temporary?
bs.lse_crosscheck         | hard | money | instant  | liabilities_and_equity.total = assets.total
bs.lse_decomp             | hard | money | instant  | liabilities_and_equity.total = liabilities.total + equity.total|equity.parent + equity.temporary?
bs.assets_split           | hard | money | instant  | assets.total = assets.current + assets.noncurrent
bs.liabilities_split      | hard | money | instant  | liabilities.total = liabilities.current + liabilities.noncurrent
bs.equity_attribution     | hard | money | instant  | equity.total = equity.parent + equity.nci
is.gross_profit           | hard | money | duration | gross_profit.total = revenue.total - cogs.total
is.operating_income       | hard | money | duration | operating_income.total = gross_profit.total - opex.total
is.pretax_to_net          | soft | money | duration | net_income.consolidated|net_income.parent = pretax_income.total - income_tax.total + income.equity_method? + income.discontinued?
is.net_income_attribution | hard | money | duration | net_income.consolidated = net_income.parent + net_income.nci
rev.segments_sum          | hard | money | duration | revenue.total = sum revenue.segment[segment]
opinc.segments_sum        | hard | money | duration | operating_income.total = sum operating_income.segment[segment]
margin.gross              | hard | ratio | duration | gross_margin.ratio = gross_profit.total / revenue.total
margin.operating          | hard | ratio | duration | operating_margin.ratio = operating_income.total / revenue.total
margin.net                | hard | ratio | duration | net_margin.ratio = net_income.parent / revenue.total
tax.effective_rate        | hard | ratio | duration | effective_tax_rate.ratio = income_tax.total / pretax_income.total
"""
# Absolute, relative, and relative tolerance against trusted data.
TOLERANCES = {"money": (1.0, 0.005, 0.0), "ratio": (0.0005, 0.01, 0.0005)}
# What each identity says in words.
WORDS = {
    "bs.balance": "assets equal liabilities and equity", "bs.lse_crosscheck": "both sides of the balance sheet agree", "bs.lse_decomp": "the right side decomposes",
    "bs.assets_split": "assets by term", "bs.liabilities_split": "liabilities by term", "bs.equity_attribution": "equity by owner", "is.gross_profit": "revenue less cost of sales",
    "is.operating_income": "gross profit less operating expenses", "is.pretax_to_net": "pretax income to net income", "is.net_income_attribution": "net income by owner",
    "rev.segments_sum": "revenue by segment", "opinc.segments_sum": "operating income by segment", "margin.gross": "gross margin", "margin.operating": "operating margin",
    "margin.net": "net margin", "tax.effective_rate": "effective tax rate",
}


@dataclass(frozen=True)
class Leaf:
    """A term: concept and fallbacks, whether it may be absent, whether it is a sum over segments."""

    names: tuple[str, ...]
    optional: bool
    summed: bool

    @property
    def label(self) -> str:
        return self.names[0]


@dataclass(frozen=True)
class Rule:
    """An identity: signs or slashes between the terms of its right side."""

    id: str
    severity: str
    tolerance: str
    kind: str
    target: Leaf
    terms: tuple[Leaf, ...]
    ops: tuple[str, ...]
    text: str


def _leaf(word: str) -> Leaf:
    return Leaf(tuple(word.rstrip("?").split("|")), word.endswith("?"), "[" in word)


def _rules() -> list[Rule]:
    out = []
    for line in SPEC.strip().splitlines():
        name, severity, tolerance, kind, text = (x.strip() for x in line.split(" | "))
        left, right = text.split(" = ")
        words = right.removeprefix("sum ").split(" ")
        shown = f"sum({words[0]})" if right.startswith("sum ") else " ".join(w.split("|")[0].rstrip("?") for w in words)
        out.append(Rule(name, severity, tolerance, kind, _leaf(left), tuple(map(_leaf, words[::2])), tuple(words[1::2]), f"{left.split('|')[0]} = {shown}"))
    return out


RULES = _rules()
#: Columns of the slot tables: a name for each concept that a rule speaks of.
NAMES = {c: c.split("[")[0].replace(".", "_") for r in RULES for leaf in (r.target, *r.terms) for c in leaf.names}
_WITH = with_facts()


def _slots(source: str, name: str, facts: str = "facts") -> str:
    """A CTE with a row per filing and period: ends, value and order of the first fact of each concept, and sums over segments."""
    cols = []
    for c, x in NAMES.items():
        if "[" in c:
            rule = f"FILTER (WHERE concept = '{c.split('[')[0]}' AND seg IS NOT NULL AND coalesce(more, '') <> 'product')"
            cols += [f"sum(v - half) {rule} AS {x}_lo", f"sum(v + half) {rule} AS {x}_hi", f"sum(v) {rule} AS {x}_v", f"list(ord ORDER BY ord) {rule} AS {x}_ids"]
        else:
            rule = f"FILTER (WHERE concept = '{c}' AND seg IS NULL)"
            cols += [f"arg_min({v}, ord) {rule} AS {x}_{end}" for end, v in (("lo", "v - half"), ("hi", "v + half"), ("v", "v"), ("id", "ord"))]
    return f"{name} AS (SELECT filing_id, period_type, fiscal_year, {', '.join(cols)} FROM {facts} WHERE source = '{source}' GROUP BY ALL)"


def _end(leaf: Leaf, end: str) -> str:
    """SQL of an end, or the plain value, of a term."""
    found = "coalesce(" + ", ".join(f"{NAMES[c]}_{end}" for c in leaf.names) + ")"
    return f"coalesce({found}, 0.0)" if leaf.optional and end != "v" else found


def _right(r: Rule) -> tuple[str, str]:
    """SQL of both ends of the right side."""
    lo, hi = _end(r.terms[0], "lo"), _end(r.terms[0], "hi")
    for op, leaf in zip(r.ops, r.terms[1:], strict=True):
        a, b = _end(leaf, "lo"), _end(leaf, "hi")
        if op == "+":
            lo, hi = f"({lo} + {a})", f"({hi} + {b})"
        elif op == "-":
            lo, hi = f"({lo} - {b})", f"({hi} - {a})"
        else:
            corners = ", ".join(f"{x} / {y}" for x in (lo, hi) for y in (a, b))
            null = f"({lo} IS NULL OR {a} IS NULL OR ({a} <= 0 AND {b} >= 0))"
            lo, hi = f"CASE WHEN {null} THEN NULL ELSE least({corners}) END", f"CASE WHEN {null} THEN NULL ELSE greatest({corners}) END"
    return lo, hi


def _result(r: Rule, truth: bool, table: str, gate: bool = True) -> str:
    lo, hi = _right(r)
    absolute, text_rel, truth_rel = TOLERANCES[r.tolerance]
    where = f" WHERE period_type = '{r.kind}'" if gate else ""
    return (
        f"SELECT *, CASE WHEN residual IS NULL THEN 'indeterminate' WHEN abs(residual) <= band THEN 'satisfied' ELSE 'violated' END AS status FROM ("
        f"SELECT filing_id, period_type, fiscal_year, '{r.id}' AS template_id, '{r.severity}' AS severity, (tl + th) / 2 - (el + eh) / 2 AS residual, "
        f"CASE WHEN tl IS NULL OR el IS NULL THEN NULL ELSE greatest({absolute}, {truth_rel if truth else text_rel} * abs((el + eh) / 2), ((th - tl) + eh - el) / 2) END AS band "
        f"FROM (SELECT filing_id, period_type, fiscal_year, {_end(r.target, 'lo')} AS tl, {_end(r.target, 'hi')} AS th, {lo} AS el, {hi} AS eh FROM {table}{where}))"
    )


def _results(name: str, table: str, truth: bool, only=None, gate: bool = True) -> str:
    return f"{name} AS (" + "\nUNION ALL ".join(_result(r, truth, table, gate) for r in RULES if only is None or r.id in only) + ")"


_SHOWN = "SELECT filing_id, template_id, status, round(residual, 4) + 0.0 AS residual, round(band, 4) AS band FROM r"


def _check(source: str, truth: bool, only=None) -> str:
    return f"{_WITH}, {_slots(source, 'slots')}, {_results('r', 'slots', truth, only)}\n{_SHOWN}"


def _absent(leaf: Leaf) -> str:
    return "false" if leaf.optional else " AND ".join(f"{NAMES[c]}_lo IS NULL" for c in leaf.names)


def _missing(r: Rule) -> str:
    """SQL list of missing inputs: the target, and of the right side all, but of a sum's terms only the first."""
    one = lambda leaf: f"CASE WHEN {_absent(leaf)} THEN ['{leaf.label}'] ELSE [] END"
    head = [r.terms[0]]
    for op, leaf in zip(r.ops, r.terms[1:], strict=True):
        if op != "+":
            head.append(leaf)
    tail = [leaf for op, leaf in zip(r.ops, r.terms[1:], strict=True) if op == "+"]
    first = "list_concat(" + ", ".join(map(one, head)) + ")" if len(head) > 1 else one(head[0])
    nothing = " AND ".join(f"NOT ({_absent(leaf)})" for leaf in head)
    for k, leaf in enumerate(tail):
        clear = " AND ".join([nothing, *[f"NOT ({_absent(x)})" for x in tail[:k]]])
        first = f"list_concat({first}, CASE WHEN {clear} THEN {one(leaf)} ELSE [] END)"
    return f"list_concat({one(r.target)}, {first})"


def _ids(leaf: Leaf) -> str:
    if leaf.summed:
        return f"coalesce({NAMES[leaf.names[0]]}_ids, [])"
    return f"list_filter([{_end(Leaf(leaf.names, False, False), 'id')}], lambda i: i IS NOT NULL)"


def _involved(r: Rule) -> str:
    """SQL list of the orders of the facts involved."""
    out = _ids(r.target)
    for leaf in r.terms:
        out = f"list_concat({out}, {_ids(leaf)})"
    return out


def _involved_rows(table: str = "slots") -> str:
    return "\nUNION ALL ".join(f"SELECT filing_id, '{r.id}' AS template_id, {_involved(r)} AS inv, {_missing(r)} AS mis FROM {table} WHERE period_type = '{r.kind}'" for r in RULES)


# ---- derivation: every identity in turn, on a table that each step replaces


def _solved(r: Rule) -> list[tuple[str, str, str, Leaf]]:
    """For each place that may be the unknown one: its condition, and both ends from the others."""
    if r.id == "is.pretax_to_net":  # deeper than one level
        return []
    leaves = (r.target, *r.terms)
    gone = [_absent(x) for x in leaves]
    known = lambda k: " AND ".join(f"NOT ({g})" if j != k else f"({g})" for j, g in enumerate(gone))
    out = [(known(0), *_right(r), r.target)]
    tl, th = _end(r.target, "lo"), _end(r.target, "hi")
    for k, leaf in enumerate(r.terms):
        if leaf.summed or leaf.optional:
            continue
        lo, hi = tl, th
        others = [(_end(x, "lo"), _end(x, "hi")) for j, x in enumerate(r.terms) if j != k]
        op = r.ops[0] if r.ops else ""
        if op == "+":
            for a, b in others:
                lo, hi = f"({lo} - {b})", f"({hi} - {a})"
        elif op == "-":
            a, b = others[0]
            lo, hi = (f"({tl} + {a})", f"({th} + {b})") if k == 0 else (f"({a} - {th})", f"({b} - {tl})")
        elif op == "/":
            a, b = others[0]
            over = "*" if k == 0 else "/"
            x, y = ((tl, th), (a, b)) if k == 0 else ((a, b), (tl, th))
            corners = ", ".join(f"{i} {over} {j}" for i in x for j in y)
            lo, hi = f"least({corners})", f"greatest({corners})"
            if k == 1:
                spans = f"({tl} <= 0 AND {th} >= 0)"
                lo, hi = f"CASE WHEN NOT {spans} THEN {lo} END", f"CASE WHEN NOT {spans} THEN {hi} END"
        out.append((known(k + 1), lo, hi, leaf))
    return out


_FOUND = sorted({leaf.names[0] for r in RULES for *_, leaf in _solved(r)})


def _propagated(source_table: str, name: str, passes: int = 3) -> str:
    """CTEs that end in ``name``: the slots with everything derived, ``<concept>_by``, ``_step`` and ``_in`` telling how, and values as fact tables hold them."""
    extra = ", ".join(f"CAST(NULL AS VARCHAR) AS {NAMES[c]}_by, CAST(NULL AS BIGINT) AS {NAMES[c]}_step, CAST(NULL AS BIGINT) AS {NAMES[c]}_in" for c in _FOUND)
    ctes, last, k = [f"{name}_0 AS (SELECT *, {extra}, 0::BIGINT AS made FROM {source_table})"], f"{name}_0", 0
    for _ in range(passes):
        for r in RULES:
            cases = _solved(r)
            if not cases:
                continue
            k += 1
            inputs = f"len({_involved(r)})"
            step = f"SELECT *, CASE WHEN period_type <> '{r.kind}' THEN 0 " + " ".join(f"WHEN {cond} AND ({lo}) IS NOT NULL AND {NAMES[leaf.names[0]]}_lo IS NULL THEN {i + 1}" for i, (cond, lo, hi, leaf) in enumerate(cases)) + f" ELSE 0 END AS pick FROM {last}"
            changed = []
            for c in dict.fromkeys(leaf.names[0] for *_, leaf in cases):
                x = NAMES[c]
                when = lambda value, old, c=c: "CASE " + " ".join(f"WHEN pick = {i + 1} THEN {value(lo, hi)}" for i, (_, lo, hi, leaf) in enumerate(cases) if leaf.names[0] == c) + f" ELSE {old} END"
                changed += [
                    f"{when(lambda lo, hi: lo, f'{x}_lo')} AS {x}_lo", f"{when(lambda lo, hi: hi, f'{x}_hi')} AS {x}_hi", f"{when(lambda lo, hi: f'-{_FOUND.index(c) + 1}', f'{x}_id')} AS {x}_id",
                    f"{when(lambda lo, hi: f'{chr(39)}{r.id}{chr(39)}', f'{x}_by')} AS {x}_by", f"{when(lambda lo, hi: 'made', f'{x}_step')} AS {x}_step", f"{when(lambda lo, hi: inputs, f'{x}_in')} AS {x}_in",
                ]
            ctes.append(f"{name}_{k} AS MATERIALIZED (SELECT * EXCLUDE (pick) REPLACE ({', '.join(changed)}, made + (pick > 0)::BIGINT AS made) FROM ({step}))")
            last = f"{name}_{k}"
    stored = ", ".join(
        f"CASE WHEN {x}_by IS NULL THEN {x}_lo ELSE ({x}_lo + {x}_hi) / 2 - ({x}_hi - {x}_lo) / 2 END AS {x}_lo, CASE WHEN {x}_by IS NULL THEN {x}_hi ELSE ({x}_lo + {x}_hi) / 2 + ({x}_hi - {x}_lo) / 2 END AS {x}_hi"
        for x in (NAMES[c] for c in _FOUND)
    )
    ctes.append(f"{name} AS MATERIALIZED (SELECT * REPLACE ({stored}) FROM {last})")
    derived = " UNION ALL ".join(f"SELECT filing_id, '{c}' AS concept, ({x}_lo + {x}_hi) / 2 AS value, ({x}_hi - {x}_lo) / 2 AS band, {x}_by AS template_id, {x}_in AS n_inputs, {x}_step AS step FROM {last} WHERE {x}_by IS NOT NULL" for c, x in ((c, NAMES[c]) for c in _FOUND))
    ctes.append(f"{name}_derived AS ({derived})")
    return ", ".join(ctes)


def _localized(results: str, table: str) -> str:
    """CTEs ``ri`` (involved facts of every result) and ``vouch``."""
    return f"""i AS ({_involved_rows(table)}), ri AS (SELECT DISTINCT r.filing_id, r.template_id, r.status, unnest(i.inv) AS id FROM {results} r JOIN i USING (filing_id, template_id)),
vouch AS (SELECT filing_id, id, count(*) AS n FROM ri WHERE status = 'satisfied' GROUP BY ALL)"""


def _agree(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= greatest(0.002 * abs({b}), 1000000.0)"


def _ref_rows(table: str) -> str:
    """The value behind every term of every hard identity."""
    return "\nUNION ALL ".join(
        f"SELECT filing_id, period_type, '{r.id}' AS template_id, {k} AS pos, '{leaf.label}' AS label, {_end(leaf, 'v')} AS v FROM {table}"
        for r in RULES if r.severity == "hard" for k, leaf in enumerate((r.target, *r.terms))
    )


_ATTRIBUTE = f"""{_WITH}, {_slots('text', 'ts')}, {_slots('xbrl', 'xs')},
{_results('tr', 'ts', False, None, False)}, {_results('xr', 'xs', True, None, False)},
lt AS ({_ref_rows('ts')}), lx AS ({_ref_rows('xs')}),
diff AS (SELECT lt.filing_id, lt.period_type, lt.template_id, count(*) AS n, bool_and(contains(lt.label, '[')) AS agg,
  string_agg(lt.label || ': text=' || format('{{:,.0f}}', lt.v) || ' vs xbrl=' || format('{{:,.0f}}', lx.v) || ' (delta ' || format('{{:,.0f}}', lt.v - lx.v) || ')', '; ' ORDER BY pos) AS evidence FROM lt JOIN lx USING (filing_id, period_type, template_id, pos)
  WHERE NOT ({_agree('lt.v', 'lx.v')}) GROUP BY ALL),
cause AS (SELECT tr.filing_id, tr.period_type, tr.template_id,
  CASE WHEN xr.status = 'violated' THEN 'filing_inconsistency' WHEN coalesce(xr.status, 'indeterminate') = 'indeterminate' THEN 'undetermined'
       WHEN diff.n > 0 THEN 'extraction_error' ELSE 'constraint_model_error' END AS label, diff.agg, diff.evidence
  FROM tr LEFT JOIN xr USING (filing_id, period_type, template_id) LEFT JOIN diff USING (filing_id, period_type, template_id)
  WHERE tr.status = 'violated' AND tr.severity = 'hard')"""
_TRUTH = "truthv AS (SELECT filing_id, period_type, fiscal_year, concept, arg_min(v, ord) AS tv FROM facts WHERE source = 'xbrl' AND seg IS NULL GROUP BY ALL)"
_COMPARE = f"cmp AS (SELECT f.filing_id, f.concept, f.ord, f.v AS value, tv AS truth_value, {_agree('f.v', 'tv')} AS agrees FROM facts f LEFT JOIN truthv USING (filing_id, period_type, fiscal_year, concept) WHERE f.source = 'text' AND f.seg IS NULL AND f.unit = 'USD')"
_NATION = "split_part(filing_id, '-', 1)"
_LAST = f"lastv AS (SELECT {_NATION} AS filing_id, concept, fiscal_year, arg_max(v, ord) AS value FROM facts WHERE source = 'xbrl' AND seg IS NULL GROUP BY ALL)"
_ANSWERS = f"""{_WITH}, {_slots('text', 'slots')},
ans AS (SELECT filing_id, fiscal_year, revenue_total_v AS rev, cogs_total_v AS cogs, CAST({_NATION} AS INT) + fiscal_year AS k FROM slots WHERE period_type = 'duration' AND revenue_total_v IS NOT NULL),
val AS (SELECT *, CASE k % 4 WHEN 0 THEN rev - cogs WHEN 1 THEN cogs / rev WHEN 2 THEN rev * 3 END AS value FROM ans),
{_TRUTH}, tv AS (SELECT filing_id, max(tv) FILTER (WHERE concept = 'revenue.total') AS trev, max(tv) FILTER (WHERE concept = 'cogs.total') AS tcogs FROM truthv GROUP BY 1),
j AS (SELECT val.*, trev, tcogs FROM val LEFT JOIN tv USING (filing_id))"""


_CARD = f"""{_ATTRIBUTE}, {_TRUTH}, {_COMPARE}, tp AS (SELECT xs.filing_id, xs.period_type, xs.fiscal_year, ts.* EXCLUDE (filing_id, period_type, fiscal_year) FROM xs LEFT JOIN ts USING (filing_id, period_type, fiscal_year)), {_results('g', 'tp', False)},
a AS (SELECT filing_id, count(*) FILTER (WHERE status = 'satisfied') AS n_satisfied, count(*) FILTER (WHERE status = 'violated' AND severity = 'hard') AS n_hard, count(*) FILTER (WHERE status = 'violated' AND severity = 'soft') AS n_soft, count(*) FILTER (WHERE status = 'indeterminate') AS n_indeterminate FROM g GROUP BY 1),
b AS (SELECT filing_id, count(*) AS n_facts, count(*) FILTER (WHERE agrees) AS n_agree, count(*) FILTER (WHERE NOT agrees) AS n_disagree FROM cmp GROUP BY 1),
c AS (SELECT filing_id, {', '.join(f"count(*) FILTER (WHERE label = '{x}') AS n_{x}" for x in ('extraction_error', 'filing_inconsistency', 'constraint_model_error', 'undetermined'))}, count(*) FILTER (WHERE label = 'extraction_error' AND agg) AS n_judge_invisible FROM cause GROUP BY 1),
card AS (SELECT a.*, n_facts, n_agree, n_disagree, coalesce(n_extraction_error, 0) AS n_extraction_error, coalesce(n_filing_inconsistency, 0) AS n_filing_inconsistency, coalesce(n_constraint_model_error, 0) AS n_constraint_model_error, coalesce(n_undetermined, 0) AS n_undetermined, coalesce(n_judge_invisible, 0) AS n_judge_invisible FROM a LEFT JOIN b USING (filing_id) LEFT JOIN c USING (filing_id))"""


def _money(a, b):
    return f"coalesce(abs({a} - {b}) <= greatest(0.01 * abs({b}), 1000000.0), false)"


def _small(c):
    pair = lambda a, b: f"({b} <> 0 AND {a} <> 0 AND (abs({c} - {a} / {b}) <= 0.005 OR abs({c} - ({a} - {b}) / {a}) <= 0.005 OR abs({c} - ({a} - {b}) / {b}) <= 0.005))"
    big = " OR ".join(_money(c, x) for x in ("(rev - cogs)", "(cogs - rev)", "(rev + cogs)"))
    return f"(CASE WHEN abs({c}) < 1.5 THEN {pair('rev', 'cogs')} OR {pair('cogs', 'rev')} ELSE {big} END)"


_VERIFY = f"""{_ANSWERS}, w AS (SELECT filing_id AS answer_id, CAST(1 + (cogs IS NOT NULL)::INT AS BIGINT) AS n_cited,
  CAST((trev IS NOT NULL)::INT + (cogs IS NOT NULL AND tcogs IS NOT NULL)::INT AS BIGINT) AS n_graded,
  CAST(({_money('rev', 'trev')})::INT + (cogs IS NOT NULL AND {_money('cogs', 'tcogs')})::INT AS BIGINT) AS n_ok,
  CASE WHEN value IS NULL OR cogs IS NULL THEN NULL ELSE {_small('value')} OR (abs(value) > 1.5 AND {_small('(value / 100)')}) END AS calc_ok FROM j)
SELECT *, n_graded > 0 AND n_ok = n_graded AS retrieval_ok, n_graded > 0 AND n_ok = n_graded AND coalesce(calc_ok, true) AS trusted FROM w"""
_GRADE = f"""{_ANSWERS}, g AS (SELECT 'model-' || (k % 3) AS model, filing_id AS question_id, {_money('value', '(trev - tcogs)')} AS final_ok, k % 2 = 0 AS judge_yes,
  cogs IS NOT NULL AS cited_all FROM j),
grades AS (SELECT model, question_id, final_ok, judge_yes, (1.0 + cited_all::INT * 1.0 + final_ok::INT * 2.0)::DOUBLE / 4 AS rubric FROM g)"""


def _rows(values: list[tuple], names: str) -> str:
    lit = lambda x: "'" + x + "'" if isinstance(x, str) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, v)) + ")" for v in values) + f") t({names})"


_FILINGS = """WITH s AS (SELECT *, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accession,
'd' || o_orderkey || '.htm' AS primary_doc, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date, CAST(year(o_orderdate) AS INT) AS fiscal_year FROM orders WHERE o_orderkey % 3 = 0)"""
_SEG = """seg AS (SELECT filing_id, fiscal_year, seg AS segment, max(v) AS value FROM facts WHERE source = '{s}' AND concept = 'revenue.segment' AND coalesce(more, '') <> 'product' GROUP BY ALL)"""
SQL = {
    "concept_dimension": _rows([(c.id, c.period_type, c.unit, ";".join(c.tags), ";".join(c.aliases)) for c in CONCEPTS], "concept, period_type, unit, tags, aliases"),
    "identity_registry": "SELECT * REPLACE (tol_abs::DOUBLE AS tol_abs, tol_rel::DOUBLE AS tol_rel, tol_rel_truth::DOUBLE AS tol_rel_truth) FROM ("
    + _rows([(i, r.id, "ratio_def" if r.tolerance == "ratio" else "sum" if r.terms[0].summed else "equality", WORDS[r.id], r.severity, r.text, r.kind, *map(str, TOLERANCES[r.tolerance])) for i, r in enumerate(RULES)],
            "position, template_id, kind, description, severity, formula, period_type, tol_abs, tol_rel, tol_rel_truth") + ")",
    "facts_dedup_first_wins": f"{_WITH} SELECT filing_id, concept, count(*) AS n, arg_min(v, ord) AS first_value, arg_max(v, ord) AS last_value FROM facts WHERE source = 'text' AND seg IS NULL GROUP BY ALL",
    "fact_ids": _WITH + """ SELECT filing_id, ord, concept, seg, left(sha256('{"concept": "' || concept || '", "dims": [' || CASE WHEN seg IS NULL THEN '' ELSE CASE WHEN more IS NULL THEN '' ELSE '["' || more || '", "P"], ' END || '["segment", "' || seg || '"]' END
|| '], "period": ["' || period_type || '", ' || fiscal_year || ', "FY"], "source": "' || source || '", "unit": ' || CASE WHEN unit IS NULL THEN 'null' ELSE '"' || unit || '"' END
|| ', "value": "' || CASE WHEN unit = 'ratio' THEN rtrim('0.' || lpad(CAST(v4 AS VARCHAR), 4, '0'), '0') ELSE CAST(v4 // 10000 AS VARCHAR) END || '"}'), 16) AS fact_id FROM facts WHERE source = 'xbrl'""",
    "fact_rounding_band": """SELECT k, CAST(CASE WHEN d = 0 THEN 500000 WHEN d = 1 THEN 500 WHEN d = 2 THEN 0.5 WHEN k % 7 = 0 THEN 0 WHEN k % 3 = 1 THEN 500 WHEN k % 3 = 2 THEN 500000 ELSE 0.5 END AS DOUBLE) AS half_band FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS d FROM orders)""",
    "fact_query": f"{_WITH} SELECT filing_id, ord, v AS value FROM facts WHERE source = 'xbrl' AND concept = 'revenue.segment' AND seg = 'MACHINERY' AND more IS NULL",
    "fact_periods": f"{_WITH} SELECT DISTINCT filing_id, period_type, fiscal_year, 'FY' AS fiscal_period FROM facts WHERE source = 'xbrl'",
    "check_segments_sum": _check("xbrl", True, ("rev.segments_sum",)),
    "check_balance": _check("xbrl", True, ("bs.balance", "bs.lse_crosscheck", "bs.lse_decomp")),
    "check_all_identities": _check("xbrl", True),
    "check_text_tolerance": _check("text", False),
    "check_involved": f"{_WITH}, {_slots('xbrl', 'slots')}, r AS ({_involved_rows()}) SELECT filing_id, template_id, CAST(len(inv) AS INT) AS n_involved, coalesce(array_to_string(mis, ','), '') AS missing FROM r",
    "aggregable_axes": "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS total, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1",
    "propagate_derived": f"{_WITH}, {_slots('xbrl', 's')}, {_propagated('s', 'p')} SELECT * REPLACE (round(value, 9) + 0.0 AS value, round(band, 9) AS band, n_inputs::INT AS n_inputs, step::INT AS step) FROM p_derived",
    "propagate_gross_profit": f"{_WITH}, {_slots('xbrl', 's')} SELECT filing_id, revenue_total_v - cogs_total_v AS value, (revenue_total_hi - revenue_total_lo + cogs_total_hi - cogs_total_lo) / 2 AS band, 'is.gross_profit' AS template_id FROM s WHERE period_type = 'duration' AND gross_profit_total_lo IS NULL AND revenue_total_lo IS NOT NULL AND cogs_total_lo IS NOT NULL",
    "propagate_inverse_opex": f"""{_WITH}, {_slots('xbrl', 's')}, h AS (SELECT *, revenue_total_hi - revenue_total_lo AS rw, cogs_total_hi - cogs_total_lo AS cw, operating_income_total_hi - operating_income_total_lo AS ow, gross_profit_total_hi - gross_profit_total_lo AS gw FROM s)
SELECT filing_id, coalesce(gross_profit_total_v, revenue_total_v - cogs_total_v) - operating_income_total_v AS value, (coalesce(gw, rw + cw) + ow) / 2 AS band, 'is.operating_income' AS template_id FROM h WHERE period_type = 'duration' AND opex_total_lo IS NULL""",
    "propagate_recheck": f"{_WITH}, {_slots('xbrl', 's')}, {_propagated('s', 'p')}, {_results('r', 'p', True)} {_SHOWN}",
    "localize_vouches": f"""{_WITH}, {_slots('xbrl', 'slots')}, {_results('r', 'slots', True)}, {_localized('r', 'slots')}
SELECT filing_id, template_id, count(*) AS n_suspects, max(round_even(1.0 / (1 + coalesce(n, 0)), 3))::DOUBLE AS top_score, CAST(sum(coalesce(n, 0)) AS BIGINT) AS vouches FROM ri LEFT JOIN vouch USING (filing_id, id) WHERE status = 'violated' GROUP BY ALL""",
    "localize_fault_injection": f"""{_WITH}, worst AS (SELECT filing_id, ord FROM facts WHERE source = 'xbrl' AND concept = 'revenue.segment' QUALIFY row_number() OVER (PARTITION BY filing_id, fiscal_year ORDER BY v DESC, ord) = 1),
raised AS (SELECT * EXCLUDE (hit) REPLACE (v + CASE WHEN hit THEN 5e9 ELSE 0 END AS v, CASE WHEN hit AND coalesce(decimals, 1) > 0 THEN 0.5 ELSE half END AS half) FROM (SELECT facts.*, worst.ord IS NOT NULL AS hit FROM facts LEFT JOIN worst ON facts.filing_id = worst.filing_id AND facts.ord = worst.ord WHERE source = 'xbrl')),
{_slots('xbrl', 's', 'raised')}, {_propagated('s', 'p')}, {_results('r', 'p', True)}, {_localized('r', 'p')}
SELECT filing_id, CAST(row_number() OVER (PARTITION BY filing_id ORDER BY coalesce(n, 0)) AS INT) AS rank, coalesce(n, 0) AS vouches, round_even(1.0 / (1 + coalesce(n, 0)), 3)::DOUBLE AS score FROM ri LEFT JOIN vouch USING (filing_id, id) WHERE status = 'violated' AND template_id = 'rev.segments_sum'""",
    "attribute_evidence": f"{_ATTRIBUTE} SELECT filing_id, template_id, evidence FROM cause WHERE label = 'extraction_error'",
    "attribute_labels": f"{_ATTRIBUTE} SELECT filing_id, period_type, template_id, label, label = 'extraction_error' AND coalesce(agg, false) AS judge_invisible FROM cause",
    "attribute_counts": f"{_ATTRIBUTE} SELECT label, count(*) AS n FROM cause GROUP BY 1",
    "fact_comparison": f"{_WITH}, {_TRUTH}, {_COMPARE} SELECT * FROM cmp",
    "constraint_compare": f"""{_WITH}, {_slots('text', 'ts')}, {_slots('xbrl', 'xs')}, {_results('tr', 'ts', False)}, {_results('xr', 'xs', True)}
SELECT f.filing_id, t.template_id, coalesce(xr.status, 'n/a') AS truth_status, coalesce(tr.status, 'n/a') AS text_status FROM (SELECT DISTINCT filing_id FROM facts WHERE source = 'xbrl') f
CROSS JOIN ({_rows([(r.id,) for r in RULES], 'template_id')}) t LEFT JOIN xr USING (filing_id, template_id) LEFT JOIN tr USING (filing_id, template_id)""",
    "scorecard": f"{_CARD} SELECT * FROM card",
    "report_lines": f"""{_CARD}, lines AS (SELECT filing_id, string_agg('- `' || template_id || '` -> **' || label || '** - ' || CASE WHEN label = 'extraction_error' THEN evidence ELSE '' END, chr(10) ORDER BY template_id, period_type) AS bullets FROM cause GROUP BY 1)
SELECT filing_id, '| Text | ' || concat_ws(' | ', n_facts, n_agree, n_disagree, n_satisfied, n_hard, n_soft, n_indeterminate) || ' |'
|| CASE WHEN bullets IS NULL THEN '' ELSE chr(10) || chr(10) || '**Text** attribution - ' || concat_ws(', ', {', '.join(f"CASE WHEN n_{x} > 0 THEN '{x}: ' || n_{x} END" for x in ('constraint_model_error', 'extraction_error', 'filing_inconsistency', 'undetermined'))}) || chr(10) || bullets END
|| CASE WHEN n_hard = 0 AND n_disagree = 0 THEN chr(10) || chr(10) || '*Verified: all ' || n_agree || ' extracted figures reconcile against trusted data.*'
WHEN n_judge_invisible > 0 THEN chr(10) || chr(10) || '*Caught: ' || n_judge_invisible || ' extraction error(s) though each figure looked correct.*' ELSE '' END AS report FROM card LEFT JOIN lines USING (filing_id)""",
    "segments_rollup_max": f"""{_WITH}, {_SEG.format(s='text')}, tot2 AS (SELECT filing_id, fiscal_year, arg_min(v, ord) AS total FROM facts WHERE source = 'text' AND concept = 'revenue.total' GROUP BY ALL),
s2 AS (SELECT filing_id, fiscal_year, sum(value) AS segment_sum, count(*) AS n_segments, arg_max(segment, value) AS largest, string_agg(segment || '=' || format('{{:.0f}}', value), ';' ORDER BY value DESC, segment) AS members FROM seg GROUP BY ALL)
SELECT *, coalesce(abs(segment_sum - total) <= greatest(0.005 * abs(total), 1000000.0), false) AS reconciles FROM s2 LEFT JOIN tot2 USING (filing_id, fiscal_year)""",
    "notable_facts": f"""{_WITH}, {_LAST}, f2 AS (SELECT {_NATION} AS filing_id, * EXCLUDE (filing_id) FROM facts WHERE source = 'xbrl'),
y AS (SELECT filing_id, fiscal_year, max(value) FILTER (WHERE concept = 'revenue.total') AS rev, max(value) FILTER (WHERE concept = 'net_income.parent') AS net, max(value) FILTER (WHERE concept = 'operating_income.total') AS op FROM lastv GROUP BY ALL),
d AS (SELECT y.*, CASE WHEN p.rev <> 0 THEN (y.rev - p.rev) / p.rev END AS ry, CASE WHEN p.net <> 0 THEN (y.net - p.net) / p.net END AS ni, CASE WHEN y.rev <> 0 THEN y.op / y.rev END AS margin FROM y LEFT JOIN y p ON p.filing_id = y.filing_id AND p.fiscal_year = y.fiscal_year - 1 WHERE y.rev IS NOT NULL),
w AS (SELECT filing_id, count(DISTINCT seg) FILTER (WHERE concept = 'revenue.segment') AS n, bool_or(concept = 'income.discontinued') AS dis, bool_or(concept = 'equity.temporary') AS mez FROM f2 GROUP BY 1),
m AS (SELECT d.*, n, dis, mez, CASE WHEN abs(rev) >= 1e9 THEN '$' || format('{{:,.1f}}', rev / 1e9) || 'B' WHEN abs(rev) >= 1e6 THEN '$' || format('{{:,.1f}}', rev / 1e6) || 'M' ELSE '$' || format('{{:,.0f}}', rev) END AS revenue FROM d JOIN w USING (filing_id))
SELECT filing_id, fiscal_year, revenue, concat_ws('; ', CASE WHEN ry IS NOT NULL THEN CASE WHEN ry >= 0 THEN 'Revenue grew ' ELSE 'Revenue fell ' END || format('{{:,.0f}}', 100 * abs(ry)) || '% year-over-year to ' || revenue END,
CASE WHEN ni IS NOT NULL THEN CASE WHEN ni >= 0 THEN 'Net income rose ' ELSE 'Net income declined ' END || format('{{:,.0f}}', 100 * abs(ni)) || '% YoY' END, CASE WHEN margin IS NOT NULL THEN 'Operating margin ' || format('{{:,.1f}}', 100 * margin) || '%' END,
CASE WHEN n > 0 THEN n || ' reportable segment(s)' END, CASE WHEN dis THEN 'Reports discontinued operations (often a divestiture or spin-off)' END, CASE WHEN mez THEN 'Carries redeemable / mezzanine equity on the balance sheet' END) AS notable FROM m""",
    "snapshot_series": f"{_WITH}, {_LAST}, yrs AS (SELECT filing_id, fiscal_year FROM lastv WHERE concept = 'revenue.total' QUALIFY dense_rank() OVER (PARTITION BY filing_id ORDER BY fiscal_year DESC) <= 3) SELECT filing_id, concept, fiscal_year, value FROM lastv JOIN yrs USING (filing_id, fiscal_year) QUALIFY count(*) OVER (PARTITION BY filing_id, concept) >= 2",
    "snapshot_yoy": f"{_WITH}, {_LAST} SELECT a.filing_id, a.concept, a.fiscal_year, b.value AS previous, round(CASE WHEN b.value <> 0 THEN (a.value - b.value) / b.value END, 9) + 0.0 AS change FROM lastv a LEFT JOIN lastv b ON a.filing_id = b.filing_id AND a.concept = b.concept AND a.fiscal_year = b.fiscal_year + 1",
    "verify_answers": _VERIFY,
    "grade_rubric": f"{_GRADE} SELECT * FROM grades",
    "leaderboard": f"{_GRADE} SELECT model, count(*) AS n, round(avg(rubric), 3) AS rubric, round(avg(final_ok::INT), 3) AS final, round(avg(judge_yes::INT), 3) AS judge, count(*) FILTER (WHERE judge_yes AND NOT final_ok) AS judge_misses, round(round(avg(rubric), 3) - round(avg(final_ok::INT), 3), 3) AS gap FROM grades GROUP BY 1",
    "search_typeahead": "SELECT CAST(c_custkey AS VARCHAR) AS ticker, c_name AS name, CAST(CASE WHEN CAST(c_custkey AS VARCHAR) = '12' THEN 1000 WHEN starts_with(CAST(c_custkey AS VARCHAR), '12') THEN 720 WHEN starts_with(lower(c_name), '12') THEN 600 WHEN contains(lower(c_name), ' 12') THEN 380 WHEN contains(lower(c_name), '12') THEN 220 WHEN contains(CAST(c_custkey AS VARCHAR), '12') THEN 150 ELSE 0 END AS INT) AS score FROM customer ORDER BY score DESC, c_custkey LIMIT 8",
    "gold_triage": "SELECT p_partkey AS ord, CAST(CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS INT) AS priority FROM part WHERE p_size % 2 <> 0",
    "judge_replies": "SELECT conv_id, turn, coalesce(starts_with(lower(trim(text)), 'y') OR starts_with(lower(trim(text)), '**y') OR contains(left(lower(trim(text)), 6), 'yes'), false) AS yes FROM conversations",
    "scale_detect": "SELECT doc_id, CASE WHEN contains(h, 'in millions') THEN 'millions' WHEN contains(h, 'in thousands') THEN 'thousands' ELSE 'ones' END AS scale FROM (SELECT doc_id, lower(left(CASE doc_id % 3 WHEN 0 THEN '(in Millions) ' WHEN 1 THEN 'in thousands ' ELSE '' END || coalesce(text, ''), 5000)) AS h FROM documents)",
    "regex_baseline": "SELECT o_orderkey AS doc_id, 'revenue.total' AS concept, floor(o_totalprice) * 1000.0 AS value, 'thousands' AS scale FROM orders UNION ALL SELECT o_orderkey, 'gross_profit.total', floor(o_totalprice / 3) * 1000.0, 'thousands' FROM orders",
    "json_reply_salvage": "SELECT CAST(o_orderkey AS VARCHAR) AS request_key, 'revenue.total' AS concept, floor(o_totalprice) * 1000.0 AS value, 'thousands' AS reported_scale, 2020 AS fiscal_year, false AS quarantined FROM orders WHERE o_orderkey % 4 <> 3",
    "request_key_cache": "SELECT conv_id, turn, text IN (SELECT text FROM conversations WHERE turn = 0) AS hit FROM conversations",
    "order_line_tieout": "WITH l AS (SELECT l_orderkey, sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS c, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS n_lines, CASE WHEN c IS NULL THEN 'indeterminate' WHEN abs(CAST(floor(o_totalprice * 100) AS BIGINT) - c) <= greatest(100.0, 0.005 * abs(c)) THEN 'satisfied' ELSE 'violated' END AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey",
    "latest_filing": f"{_FILINGS} SELECT cik, accession, primary_doc, filing_date, fiscal_year, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(accession, '-', '') || '/' || primary_doc AS url FROM s QUALIFY row_number() OVER (PARTITION BY cik ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "filing_of_year": f"{_FILINGS} SELECT cik, accession, fiscal_year FROM s WHERE fiscal_year = 1997 QUALIFY row_number() OVER (PARTITION BY cik ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "company_index": "SELECT CAST(c_custkey AS INT) AS rank, 'T' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS name FROM customer",
    "tagged_facts": """WITH o AS (SELECT o_orderkey AS k, 'f' || (o_orderkey % 50) AS filing_id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS p FROM orders),
off AS (SELECT filing_id, arg_min(k % 3 - 1, k) AS off FROM o WHERE k % 29 = 0 AND k % 50 < 40 GROUP BY 1),
r AS (SELECT *, ['assets.total', 'revenue.total', 'revenue.total', 'operating_income.total', 'net_income.parent', 'gross_profit.total', NULL][k % 7 + 1] AS c,
  CASE WHEN k % 23 = 0 OR k % 8 = 0 THEN NULL ELSE [NULL, 'segment', 'segment', 'geography', 'product', 'consolidation_item', 'customview', 'legalentity'][k % 8 + 1] END AS axis FROM o)
SELECT filing_id, k AS ord, CASE WHEN axis = 'segment' AND c IN ('revenue.total', 'operating_income.total') THEN replace(c, '.total', '.segment') ELSE c END AS concept, floor(p)::DOUBLE AS value,
  CASE WHEN k % 7 = 0 THEN 'instant' ELSE 'duration' END AS period_type, CAST(year(d) + coalesce(off, 0) AS INT) AS fiscal_year, ['USD', 'USD', 'shares', 'pure', 'AUSD'][k % 5 + 1] AS unit, CAST([-6, NULL, 2, NULL][k % 4 + 1] AS INT) AS decimals,
  CASE WHEN axis IS NULL THEN '' ELSE axis || '=m' || (k % 3) END AS dims FROM r LEFT JOIN off USING (filing_id) WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND c IS NOT NULL""",
    "gold_loaded": "SELECT CAST(p_partkey AS VARCHAR) AS question_id, p_name AS prompt, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 10.0 END::DOUBLE AS value, CASE WHEN p_partkey % 3 = 0 THEN 'Q1' ELSE 'FY' END AS fiscal_period, p_size % 2 = 0 AS verified, '' AS draft_confidence FROM part",
    "benchmark_loaded": "SELECT CAST(p_partkey AS VARCHAR) AS question_id, p_brand AS ticker, p_size AS fiscal_year, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS gold, p_partkey % 5 <> 0 AS answerable, 0 AS n_required, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_rubric, CASE WHEN p_size % 2 = 0 THEN 2.0 END::DOUBLE AS weight FROM part",
    "final_answer_parse": """SELECT o_orderkey AS answer_id, CASE WHEN bad THEN 'I can not tell' ELSE 'a' END AS answer, CASE WHEN NOT bad THEN floor(o_totalprice) END AS value, CASE WHEN NOT bad THEN 'USD' END AS unit, CAST(year(o_orderdate) AS INT) AS fiscal_year,
CASE WHEN NOT bad THEN 'revenue.total' END AS cited, CASE WHEN NOT bad THEN CAST(year(o_orderdate) AS INT) END AS cited_year, CASE WHEN bad THEN 'could not parse final JSON' END AS error FROM (SELECT *, o_orderkey % 3 = 2 AS bad FROM orders)""",
    "margins_by_year": f"""{_WITH}, {_slots('xbrl', 's')}, m AS (SELECT filing_id, revenue_total_v AS r, coalesce(gross_profit_total_v, revenue_total_v - cogs_total_v) AS g, operating_income_total_v AS o, net_income_parent_v AS n, income_tax_total_v AS t, pretax_income_total_v AS p FROM s WHERE period_type = 'duration')
SELECT filing_id, {", ".join(f"round(CASE WHEN {b} <> 0 THEN {a} / {b} END, 9) + 0.0 AS {c}" for c, a, b in (("gross", "g", "r"), ("operating", "o", "r"), ("net", "n", "r"), ("tax", "t", "p")))} FROM m""",
    "latest_years": f"{_WITH} SELECT {_NATION} AS filing_id, max(fiscal_year) AS fiscal_year FROM facts WHERE source = 'xbrl' GROUP BY 1",
    "model_labels": "SELECT p_partkey, upper(left(b, 1)) || substr(b, 2) || ' ' || (p_size % 9) || '.' || (p_partkey % 7) AS label FROM (SELECT *, array_to_string(list_transform(string_split(lower(replace(p_brand, '#', '-')), '-'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS b FROM part)",
    "interval_arithmetic": """WITH r AS (SELECT o_orderkey, o_orderkey % 7 - 3 - (o_orderkey % 3) / 2.0::DOUBLE AS a, o_orderkey % 7 - 3 + (o_orderkey % 3) / 2.0::DOUBLE AS b, least(o_orderkey % 5 - 2, o_orderkey % 4 - 1)::DOUBLE AS c, greatest(o_orderkey % 5 - 2, o_orderkey % 4 - 1)::DOUBLE AS d FROM orders)
SELECT o_orderkey, (a + b) / 2 AS midpoint, d - c AS width, a <= 1 AND b >= 1 AS has_one, a <= d AND c <= b AS overlaps, a + c AS sum_lo, b + d AS sum_hi, a - d AS difference_lo, b - c AS difference_hi, least(-2 * a, -2 * b) + 0.0 AS scaled_lo, greatest(-2 * a, -2 * b) + 0.0 AS scaled_hi,
least(a * c, a * d, b * c, b * d) + 0.0 AS product_lo, greatest(a * c, a * d, b * c, b * d) + 0.0 AS product_hi,
CASE WHEN c > 0 OR d < 0 THEN round(least(a / c, a / d, b / c, b / d), 9) + 0.0 END AS quotient_lo, CASE WHEN c > 0 OR d < 0 THEN round(greatest(a / c, a / d, b / c, b / d), 9) + 0.0 END AS quotient_hi FROM r""",
    # At most two calls in the hour before: the last two admitted ones are all the state there is.
    "rate_limit_admission": """WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS call_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT key, call_id, at_us, k, true AS admitted, CAST(NULL AS BIGINT) AS a, at_us AS b FROM c WHERE k = 1
UNION ALL SELECT c.key, c.call_id, c.at_us, c.k, f.a IS NULL OR c.at_us - f.a > 3600000000, CASE WHEN f.a IS NULL OR c.at_us - f.a > 3600000000 THEN f.b ELSE f.a END, CASE WHEN f.a IS NULL OR c.at_us - f.a > 3600000000 THEN c.at_us ELSE f.b END FROM f JOIN c ON c.key = f.key AND c.k = f.k + 1)
SELECT key, call_id, at_us, admitted FROM f""",
    "html_text": r"""SELECT page_id, md5(t) AS text_md5, CAST(least(length(t), 170000) AS INT) AS window_chars FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<!--.*?-->|<(head|script|style)\b.*?</(head|script|style)>|<[^>]*>', ' ', 'g'),
'&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM (SELECT page_id, regexp_replace(html, '(?s)<head>.*?</head>', ' ', 'g') AS html FROM pages))""",
}
