"""The identities: small expression trees, and their compilation to Columns over slots.

A slot row has, for every consolidated concept, ``c_<n>`` = ``struct<lo, hi, value, fact_id>``
and, for every aggregate reference, ``a_<n>`` = ``struct<lo, hi, value, fact_ids>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .ontology import BY_ID, CONCEPTS


@dataclass(frozen=True)
class Ref:
    """A concept: fallbacks in order, zero where optional and absent, or the sum over an axis."""

    concept: str
    fallbacks: tuple[str, ...] = ()
    optional: bool = False
    over: str | None = None

    @property
    def label(self) -> str:
        """Name in lists of missing inputs."""
        return f"{self.concept}[{self.over}]" if self.over else self.concept


@dataclass(frozen=True)
class Node:
    """``+`` of any number of terms, ``-`` or ``/`` of two."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Tolerance:
    """Absolute, relative, and relative against trusted data; rounding always counts."""

    abs: float
    rel: float
    rel_truth: float


MONEY, RATIO = Tolerance(1.0, 0.005, 0.0), Tolerance(0.0005, 0.01, 0.0005)


@dataclass(frozen=True)
class Identity:
    """``target = expr`` within a tolerance."""

    id: str
    kind: str
    target: Ref
    expr: Ref | Node
    description: str
    tolerance: Tolerance = MONEY
    severity: str = "hard"

    @property
    def period_type(self) -> str:
        """Period type of the target."""
        return BY_ID[self.target.concept].period_type


def _add(*args):
    return Node("+", args)


def _sub(a, b):
    return Node("-", (a, b))


def _div(a, b):
    return Node("/", (a, b))


_R = Ref
_EQUITY, _MEZZANINE = Ref("equity.total", ("equity.parent",)), Ref("equity.temporary", optional=True)


def _ratio(id, name, top, bottom, description):
    return Identity(id, "ratio_def", _R(name), _div(_R(top), _R(bottom)), description, RATIO)


# The sixteen identities and their order, on which derivation depends.
IDENTITIES = (
    Identity("bs.balance", "equality", _R("assets.total"), _add(_R("liabilities.total"), _EQUITY, _MEZZANINE), "assets equal liabilities and equity"),
    Identity("bs.lse_crosscheck", "equality", _R("liabilities_and_equity.total"), _R("assets.total"), "both sides of the balance sheet agree"),
    Identity("bs.lse_decomp", "equality", _R("liabilities_and_equity.total"), _add(_R("liabilities.total"), _EQUITY, _MEZZANINE), "the right side decomposes"),
    Identity("bs.assets_split", "equality", _R("assets.total"), _add(_R("assets.current"), _R("assets.noncurrent")), "assets by term"),
    Identity("bs.liabilities_split", "equality", _R("liabilities.total"), _add(_R("liabilities.current"), _R("liabilities.noncurrent")), "liabilities by term"),
    Identity("bs.equity_attribution", "equality", _R("equity.total"), _add(_R("equity.parent"), _R("equity.nci")), "equity by owner"),
    Identity("is.gross_profit", "equality", _R("gross_profit.total"), _sub(_R("revenue.total"), _R("cogs.total")), "revenue less cost of sales"),
    Identity("is.operating_income", "equality", _R("operating_income.total"), _sub(_R("gross_profit.total"), _R("opex.total")), "gross profit less operating expenses"),
    Identity("is.pretax_to_net", "equality", _R("net_income.consolidated", ("net_income.parent",)), _add(_sub(_R("pretax_income.total"), _R("income_tax.total")), _R("income.equity_method", optional=True), _R("income.discontinued", optional=True)), "pretax income to net income", severity="soft"),
    Identity("is.net_income_attribution", "equality", _R("net_income.consolidated"), _add(_R("net_income.parent"), _R("net_income.nci")), "net income by owner"),
    Identity("rev.segments_sum", "sum", _R("revenue.total"), _R("revenue.segment", over="segment"), "revenue by segment"),
    Identity("opinc.segments_sum", "sum", _R("operating_income.total"), _R("operating_income.segment", over="segment"), "operating income by segment"),
    _ratio("margin.gross", "gross_margin.ratio", "gross_profit.total", "revenue.total", "gross margin"),
    _ratio("margin.operating", "operating_margin.ratio", "operating_income.total", "revenue.total", "operating margin"),
    _ratio("margin.net", "net_margin.ratio", "net_income.parent", "revenue.total", "net margin"),
    _ratio("tax.effective_rate", "effective_tax_rate.ratio", "income_tax.total", "pretax_income.total", "effective tax rate"),
)
CONSOLIDATED = [c.id for c in CONCEPTS]
SLOT = {c: f"c_{k}" for k, c in enumerate(CONSOLIDATED)}


def refs(e) -> list[Ref]:
    """Leaves in order."""
    return [e] if isinstance(e, Ref) else [r for a in e.args for r in refs(a)]


AGGREGATES = list(dict.fromkeys((r.concept, r.over) for t in IDENTITIES for r in refs(t.expr) if r.over))
AGG_SLOT = {key: f"a_{k}" for k, key in enumerate(AGGREGATES)}


def render(e) -> str:
    """Infix form without parentheses."""
    if isinstance(e, Ref):
        return f"sum({e.label})" if e.over else e.concept
    return f" {e.op} ".join(map(render, e.args))


def registry(spark: SparkSession) -> DataFrame:
    """The identities as a table."""
    rows = [(i, t.id, t.kind, t.description, t.severity, f"{render(t.target)} = {render(t.expr)}", t.period_type, t.tolerance.abs, t.tolerance.rel, t.tolerance.rel_truth) for i, t in enumerate(IDENTITIES)]
    return spark.createDataFrame(rows, "position int, template_id string, kind string, description string, severity string, formula string, period_type string, tol_abs double, tol_rel double, tol_rel_truth double")


# Expressions below are SQL text: one identity is hundreds of operators, and text reaches the planner in one call.
_NONE = "CAST(array() AS array<string>)"


def first_of(r: Ref, side: str, part: str, *more: str) -> str:
    """A field of the first slot of a consolidated leaf that is filled."""
    return f"coalesce({', '.join([*[f'{side}{SLOT[c]}.{part}' for c in (r.concept, *r.fallbacks)], *more])})"


def _resolve(r: Ref, side: str) -> tuple[str, str, str, str]:
    """Ends of the interval, fact ids, and list of missing names of a leaf."""
    if r.over:
        slot = side + AGG_SLOT[(r.concept, r.over)]
        return f"{slot}.lo", f"{slot}.hi", f"coalesce({slot}.fact_ids, {_NONE})", f"CASE WHEN {slot} IS NULL THEN array('{r.label}') ELSE {_NONE} END"
    zero = ("0D",) if r.optional else ()
    missing = _NONE if r.optional else f"CASE WHEN {first_of(r, side, 'lo')} IS NULL THEN array('{r.label}') ELSE {_NONE} END"
    return first_of(r, side, "lo", *zero), first_of(r, side, "hi", *zero), f"array_compact(array({first_of(r, side, 'fact_id')}))", missing


def _evaluate(e, side: str) -> tuple[str, str, str, str]:
    """As for a leaf. Ends are kept apart and each is used once, so that the expression grows with the tree only."""
    if isinstance(e, Ref):
        return _resolve(e, side)
    parts = [_evaluate(a, side) for a in e.args]
    lo, hi, _, missing = parts[0]
    for p in parts[1:]:
        if e.op == "+":
            lo, hi = f"({lo} + {p[0]})", f"({hi} + {p[1]})"
        elif e.op == "-":
            lo, hi = f"({lo} - {p[1]})", f"({hi} - {p[0]})"
        else:
            corners = "array(" + ", ".join(f"try_divide({x}, {y})" for x in (lo, hi) for y in p[:2]) + ")"
            lo, hi = (f"CASE WHEN NOT ({p[0]} <= 0 AND {p[1]} >= 0) THEN {f}({corners}) END" for f in ("array_min", "array_max"))
        # A sum stops at its first missing term; the others look at both sides.
        missing = f"CASE WHEN size({missing}) > 0 THEN {missing} ELSE {p[3]} END" if e.op == "+" else f"concat({missing}, {p[3]})"
    return lo, hi, f"concat({', '.join(p[2] for p in parts)})", missing


def ends(t: Identity, side: str = "") -> str:
    """Both sides of the identity over a slot row, before judgement, as a struct; ``side`` goes before the slots' names."""
    tl, th, t_ids, t_missing = _resolve(t.target, side)
    el, eh, e_ids, e_missing = _evaluate(t.expr, side)
    fields = {
        "template_id": f"'{t.id}'", "severity": f"'{t.severity}'", "tol_abs": f"{t.tolerance.abs}D", "tol_rel": f"{t.tolerance.rel}D", "tol_rel_truth": f"{t.tolerance.rel_truth}D",
        "tl": tl, "th": th, "el": el, "eh": eh, "involved": f"concat({t_ids}, {e_ids})", "missing": f"concat({t_missing}, {e_missing})",
    }
    return struct(fields)


def struct(fields: dict[str, str]) -> str:
    """A struct of named expressions."""
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def verdict(truth: bool, side: str = "") -> tuple[str, str, str]:
    """Status, residual and band of what :func:`ends` gives, by the names of its fields after ``side``; the band's edge still satisfies."""
    part = lambda name: side + name
    expected = f"(({part('el')} + {part('eh')}) / 2)"
    residual = f"(({part('tl')} + {part('th')}) / 2 - {expected})"
    width = f"({part('th')} - {part('tl')} + {part('eh')} - {part('el')}) / 2"
    band = f"CASE WHEN {residual} IS NOT NULL THEN greatest({part('tol_abs')}, {part('tol_rel_truth' if truth else 'tol_rel')} * abs({expected}), {width}) END"
    return f"CASE WHEN {residual} IS NULL THEN 'indeterminate' WHEN abs({residual}) <= {band} THEN 'satisfied' ELSE 'violated' END", residual, band


def judge(rows: DataFrame, truth: bool, keep: list[str]) -> DataFrame:
    """Status, residual and band of rows that carry :func:`ends`."""
    status, residual, band = verdict(truth)
    return rows.selectExpr(*keep, "template_id", "severity", f"{status} AS status", f"{residual} AS residual", f"{band} AS band", "involved", "missing")
