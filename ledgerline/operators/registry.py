"""Metric registry: aliases, candidate concepts by sector and tier, and overrides, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Metric, period type, unit kind, candidate tiers by sector, aliases.
SECTORS = {"bank": ("JPM", "WFC", "BAC", "GS"), "asset_manager": ("BLK", "STT", "TROW", "IVZ")}
METRICS = {
    "revenue": ("duration", "money", {"default": [["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"]], "bank": [["Revenues", "RevenuesNetOfInterestExpense"]], "asset_manager": [["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"]]}, ["revenue", "revenues", "sales", "net sales", "total revenue", "total revenues", "top line", "turnover", "total net sales", "total net revenue"]),
    "net_income": ("duration", "money", {"default": [["NetIncomeLoss"], ["ProfitLoss"]], "bank": [["NetIncomeLoss"], ["ProfitLoss"]]}, ["net income", "net earnings", "profit", "net profit", "bottom line", "net income attributable to the company"]),
    "operating_income": ("duration", "money", {"default": [["OperatingIncomeLoss"]]}, ["operating income", "operating profit", "income from operations", "operating earnings"]),
    "gross_profit": ("duration", "money", {"default": [["GrossProfit"]]}, ["gross profit", "gross margin dollars", "gross income"]),
    "rd_expense": ("duration", "money", {"default": [["ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost"]]}, ["r&d", "rd", "research and development", "research and development expense", "research spend", "r and d"]),
    "total_assets": ("instant", "money", {"default": [["Assets"]]}, ["total assets", "assets", "balance sheet size"]),
    "total_liabilities": ("instant", "money", {"default": [["Liabilities"]]}, ["total liabilities", "liabilities"]),
    "stockholders_equity": ("instant", "money", {"default": [["StockholdersEquity"], ["StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]]}, ["stockholders equity", "shareholders equity", "equity", "book value", "total equity", "net assets"]),
    "cash_and_equivalents": ("instant", "money", {"default": [["CashAndCashEquivalentsAtCarryingValue"], ["CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"]]}, ["cash", "cash and equivalents", "cash and cash equivalents", "cash on hand"]),
    "operating_cash_flow": ("duration", "money", {"default": [["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"]]}, ["operating cash flow", "cash from operations", "cash flow from operations", "ocf", "net cash from operating activities", "cash flow from operating activities", "cash flows from operating activities", "cash provided by operating activities", "net cash provided by operating activities", "operating activities"]),
    "capex": ("duration", "money", {"default": [["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]]}, ["capex", "capital expenditures", "capital spending", "purchases of property and equipment", "payments to acquire property plant and equipment"]),
    "eps_diluted": ("duration", "per_share", {"default": [["EarningsPerShareDiluted"]]}, ["eps", "diluted eps", "earnings per share", "diluted earnings per share"]),
}
STATEMENTS = {"income": ("revenue", "net_income", "operating_income", "gross_profit", "rd_expense", "eps_diluted"), "balance": ("total_assets", "total_liabilities", "stockholders_equity", "cash_and_equivalents"), "cash_flow": ("operating_cash_flow", "capex")}
LABELS = {
    "revenue": "Total net revenue", "net_income": "Net income", "operating_income": "Operating income", "gross_profit": "Gross profit", "rd_expense": "Research and development expense", "total_assets": "Total assets", "total_liabilities": "Total liabilities",
    "stockholders_equity": "Total stockholders' equity", "cash_and_equivalents": "Cash and cash equivalents", "operating_cash_flow": "Net cash provided by operating activities", "capex": "Capital expenditures", "eps_diluted": "Diluted earnings per share",
}
#: Concepts prescribed for a filer: metric, ticker, first and last fiscal label, concept; the first applicable row counts.
OVERRIDES = [("revenue", "BLK", None, None, "RevenueFromContractWithCustomerExcludingAssessedTax")]


def candidates(spark: SparkSession) -> DataFrame:
    """(metric, period_type, sector, tier, concept)."""
    rows = [(m, p, s, i, c) for m, (p, _, sectors, _) in METRICS.items() for s, tiers in sectors.items() for i, tier in enumerate(tiers, 1) for c in tier]
    return spark.createDataFrame(rows, "metric string, period_type string, sector string, tier int, concept string")


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, s) for s, ts in SECTORS.items() for t in ts], "ticker string, sector string")


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "metric string, ticker string, fiscal_from int, fiscal_to int, concept string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, m) for m, (_, _, _, names) in METRICS.items() for a in names], "alias string, metric string")


def statements(spark: SparkSession) -> DataFrame:
    """(metric, statement) in which a metric is printed."""
    return spark.createDataFrame([(m, s) for s, ms in STATEMENTS.items() for m in ms], "metric string, statement string")
