"""The concepts that identities speak of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Concept:
    """A line item: its id, whether it is a balance (instant), a flow (duration) or a ratio, tags and wordings."""

    id: str
    kind: str
    tags: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    dimensional: bool = False

    @property
    def period_type(self) -> str:
        """``instant`` for balances."""
        return "instant" if self.kind == "balance" else "duration"

    @property
    def unit(self) -> str:
        """``ratio`` or ``USD``."""
        return "ratio" if self.kind == "ratio" else "USD"


def _c(id, kind, tags="", aliases="", dimensional=False):
    return Concept(id, kind, tuple(tags.split()), tuple(a for a in aliases.split("; ") if a), dimensional)


# Concept ids, us-gaap tags and the wordings looked for in text.
CONCEPTS = (
    _c("assets.total", "balance", "Assets", "total assets"),
    _c("assets.current", "balance", "AssetsCurrent", "total current assets"),
    _c("assets.noncurrent", "balance", "AssetsNoncurrent"),
    _c("liabilities.total", "balance", "Liabilities", "total liabilities"),
    _c("liabilities.current", "balance", "LiabilitiesCurrent", "total current liabilities"),
    _c("liabilities.noncurrent", "balance", "LiabilitiesNoncurrent"),
    _c("equity.total", "balance", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "total equity"),
    _c("equity.parent", "balance", "StockholdersEquity", "total stockholders equity"),
    _c("equity.nci", "balance", "MinorityInterest", "noncontrolling interest"),
    _c("equity.temporary", "balance", "RedeemableNoncontrollingInterestEquityCarryingAmount TemporaryEquityCarryingAmountIncludingPortionAttributableToNoncontrollingInterests TemporaryEquityCarryingAmountAttributableToParent", "redeemable noncontrolling interest; temporary equity"),
    _c("liabilities_and_equity.total", "balance", "LiabilitiesAndStockholdersEquity"),
    _c("revenue.total", "flow", "Revenues RevenueFromContractWithCustomerExcludingAssessedTax", "total revenue; net sales; total net sales; revenues"),
    _c("revenue.segment", "flow", "RevenueFromContractWithCustomerExcludingAssessedTax", "", True),
    _c("cogs.total", "flow", "CostOfGoodsAndServicesSold CostOfRevenue", "cost of sales; cost of revenue; cost of goods sold"),
    _c("gross_profit.total", "flow", "GrossProfit", "gross profit"),
    _c("opex.total", "flow", "OperatingExpenses CostsAndExpenses", "total operating expenses"),
    _c("operating_income.total", "flow", "OperatingIncomeLoss", "operating income; income from operations"),
    _c("operating_income.segment", "flow", "", "", True),
    _c("net_income.consolidated", "flow", "ProfitLoss", "consolidated net income"),
    _c("net_income.parent", "flow", "NetIncomeLoss", "net income; net earnings"),
    _c("net_income.nci", "flow", "NetIncomeLossAttributableToNoncontrollingInterest"),
    _c("pretax_income.total", "flow", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments", "income before taxes; pretax income"),
    _c("income_tax.total", "flow", "IncomeTaxExpenseBenefit", "income tax expense; provision for income taxes"),
    _c("income.equity_method", "flow", "IncomeLossFromEquityMethodInvestmentsNetOfTax IncomeLossFromEquityMethodInvestments", "equity method investment; equity in earnings"),
    _c("income.discontinued", "flow", "IncomeLossFromDiscontinuedOperationsNetOfTax IncomeLossFromDiscontinuedOperationsNetOfTaxAttributableToReportingEntity", "discontinued operations"),
    _c("cfo.total", "flow", "NetCashProvidedByUsedInOperatingActivities"),
    _c("gross_margin.ratio", "ratio", "", "gross margin"),
    _c("operating_margin.ratio", "ratio", "", "operating margin"),
    _c("net_margin.ratio", "ratio", "", "net margin; net profit margin"),
    _c("effective_tax_rate.ratio", "ratio", "", "effective tax rate"),
)
BY_ID = {c.id: c for c in CONCEPTS}


def tag_index() -> dict[str, str]:
    """Tag to concept; the concept declared first owns a shared tag."""
    owners: dict[str, str] = {}
    for c in CONCEPTS:
        for tag in c.tags:
            owners.setdefault(tag, c.id)
    return owners


def concepts(spark: SparkSession) -> DataFrame:
    """The 30 concepts as a dimension table."""
    rows = [(c.id, c.kind, c.period_type, c.unit, c.dimensional, list(c.tags), list(c.aliases)) for c in CONCEPTS]
    return spark.createDataFrame(rows, "concept string, kind string, period_type string, unit string, dimensional boolean, tags array<string>, aliases array<string>")
