"""Schemas of the engine's tables, and the seed dimensions."""

from __future__ import annotations

SUBTASKS = ("numerical_reasoning", "consistency_checking", "temporal_reasoning")
PREFIXES = {"numerical_reasoning": "nr", "consistency_checking": "cc", "temporal_reasoning": "tr"}
TARGETS = {"numerical_reasoning": 550, "consistency_checking": 200, "temporal_reasoning": 250}
SUBTASK_TABLE = ", ".join(f"('{s}', '{PREFIXES[s]}', {TARGETS[s]}, {k})" for k, s in enumerate(SUBTASKS))

TABLE = "struct<headers: array<string>, rows: array<array<string>>>"
QA = "struct<question: string, program: array<string>, answer: string, gold_evidence: array<bigint>>"
#: A nested question; the last four may be null.
QUESTION = f"id string, subtask string, pre_text array<string>, post_text array<string>, table {TABLE}, qa {QA}, edinet_code string, filing_year string, accounting_standard string, source_doc_id string"
#: The stored form: flat, one file set a subtask.
FLAT = ("id", "subtask", "company_name", "edinet_code", "source_doc_id", "filing_year", "accounting_standard", "scale", "pre_text", "post_text", "table_headers", "table_rows", "question", "program", "answer", "gold_evidence")
ITEM = "company string, year string, statement string, pos bigint, label string, value double"

# Prices of a million input, output and thinking tokens by model; and of an unknown model.
PRICES = {
    "gpt-5.4": (1.25, 10.0, 10.0), "gpt-5.4-mini": (0.25, 2.0, 2.0), "gpt-5.4-nano": (0.05, 0.40, 0.40), "gpt-5.4-pro": (15.0, 120.0, 120.0), "gpt-5.2": (1.25, 10.0, 10.0), "gpt-5-mini": (0.25, 2.0, 2.0),
    "gpt-4.1": (2.0, 8.0, 8.0), "gpt-4.1-mini": (0.4, 1.6, 1.6), "gpt-4o": (2.5, 10.0, 10.0), "gpt-4o-mini": (0.15, 0.60, 0.60), "claude-sonnet-4-5": (3.0, 15.0, 15.0), "claude-opus-4-6": (15.0, 75.0, 75.0), "claude-opus-4-7": (15.0, 75.0, 75.0),
    "gemini-2.5-pro": (1.25, 10.0, 10.0), "gemini-2.5-flash": (0.075, 0.30, 0.30), "gemini-2.5-flash-lite": (0.04, 0.15, 0.15), "gemini-2.0-flash": (0.10, 0.40, 0.40),
}
UNKNOWN_PRICE = (2.0, 10.0, 10.0)
# Regimes of a run: most output tokens, and the effort or thinking budget that each kind of provider is asked for.
REGIMES = {"R0": {"max_output": 2048, "effort": "none", "budget": 0, "own_budget": None}, "R1": {"max_output": 8192, "effort": "medium", "budget": -1, "own_budget": 4096}}

# Filing windows (first month, day, last month, day), the likeliest first.
WINDOWS = ((6, 1, 8, 31), (3, 1, 5, 31), (10, 1, 12, 31), (12, 1, 12, 31), (4, 1, 6, 30), (7, 1, 9, 30))
# Contexts of the consolidated current period.
CURRENT = ("CurrentYearDuration", "CurrentYearInstant", "CurrentYearConsolidatedDuration", "CurrentYearConsolidatedInstant")

# Element names and their labels, by statement.
ELEMENTS = {
    "income_statement": {
        "NetSales": "売上高", "CostOfSales": "売上原価", "GrossProfit": "売上総利益", "SellingGeneralAndAdministrativeExpenses": "販売費及び一般管理費", "OperatingIncome": "営業利益", "NonOperatingIncome": "営業外収益", "NonOperatingExpenses": "営業外費用", "OrdinaryIncome": "経常利益", "ExtraordinaryIncome": "特別利益", "ExtraordinaryLoss": "特別損失", "IncomeBeforeIncomeTaxes": "税引前当期純利益", "IncomeTaxes": "法人税等", "ProfitLoss": "当期純利益", "ProfitLossAttributableToOwnersOfParent": "親会社株主に帰属する当期純利益", "ProfitLossAttributableToNonControllingInterests": "非支配株主に帰属する当期純利益",
        "Revenue": "売上収益", "OperatingProfit": "営業利益", "ProfitBeforeTax": "税引前利益", "ProfitForThePeriod": "当期利益", "ProfitAttributableToOwnersOfParent": "親会社の所有者に帰属する当期利益", "ComprehensiveIncome": "包括利益", "OtherComprehensiveIncome": "その他の包括利益",
        "NetSalesIFRS": "売上高", "RevenueIFRS": "売上高", "SalesRevenueIFRS": "売上高", "CostOfSalesIFRS": "売上原価", "GrossProfitIFRS": "売上総利益", "SellingGeneralAndAdministrativeExpensesIFRS": "販売費及び一般管理費", "OperatingExpensesIFRS": "販売費及び一般管理費", "OperatingIncomeIFRS": "営業利益", "OperatingProfitIFRS": "営業利益", "OperatingProfitLossIFRS": "営業利益", "OtherIncomeIFRS": "その他の収益", "OtherExpensesIFRS": "その他の費用", "OtherNonOperatingIncomeAndExpensesIFRS": "その他の営業外損益", "FinanceIncomeIFRS": "金融収益", "FinanceCostsIFRS": "金融費用", "ProfitBeforeTaxIFRS": "税引前利益", "ProfitLossBeforeTaxIFRS": "税引前利益", "IncomeTaxExpenseIFRS": "法人所得税費用", "IncomeTaxesIFRS": "法人所得税費用", "ProfitLossIFRS": "当期純利益", "ProfitForThePeriodIFRS": "当期純利益", "ProfitLossAttributableToOwnersOfParentIFRS": "親会社株主に帰属する当期純利益", "ProfitLossAttributableToNonControllingInterestsIFRS": "非支配株主に帰属する当期純利益", "ComprehensiveIncomeIFRS": "包括利益", "ComprehensiveIncomeAttributableToOwnersOfParentIFRS": "親会社株主に帰属する包括利益", "OtherComprehensiveIncomeIFRS": "その他の包括利益",
        "InterestIncome": "受取利息", "InterestExpense": "支払利息", "DividendIncome": "受取配当金", "ShareOfProfitOfInvestmentsAccountedForUsingEquityMethod": "持分法による投資利益", "DepreciationAndAmortization": "減価償却費", "ResearchAndDevelopmentExpenses": "研究開発費",
    },
    "balance_sheet": {
        "CurrentAssets": "流動資産", "CashAndDeposits": "現金及び預金", "CashAndCashEquivalents": "現金及び現金同等物", "NotesAndAccountsReceivableTrade": "受取手形及び売掛金", "AccountsReceivableTrade": "売掛金", "Inventories": "棚卸資産", "MerchandiseAndFinishedGoods": "商品及び製品", "ShortTermInvestmentSecurities": "有価証券", "OtherCurrentAssets": "その他の流動資産", "NoncurrentAssets": "固定資産", "PropertyPlantAndEquipment": "有形固定資産", "PropertyPlantAndEquipmentNet": "有形固定資産(純額)", "IntangibleAssets": "無形固定資産", "Goodwill": "のれん", "InvestmentsAndOtherAssets": "投資その他の資産", "InvestmentSecurities": "投資有価証券", "TotalAssets": "資産合計", "TotalAssetsSummaryOfBusinessResults": "資産合計", "TotalAssetsIFRSSummaryOfBusinessResults": "資産合計", "TotalAssetsUSGAAPSummaryOfBusinessResults": "資産合計",
        "CurrentLiabilities": "流動負債", "ShortTermLoansPayable": "短期借入金", "NotesAndAccountsPayableTrade": "支払手形及び買掛金", "AccountsPayableTrade": "買掛金", "CurrentPortionOfLongTermLoansPayable": "1年内返済予定の長期借入金", "NoncurrentLiabilities": "固定負債", "LongTermLoansPayable": "長期借入金", "BondsPayable": "社債", "TotalLiabilities": "負債合計", "NetAssets": "純資産合計", "NetAssetsSummaryOfBusinessResults": "純資産合計", "ShareholdersEquity": "株主資本", "CapitalStock": "資本金", "CapitalSurplus": "資本剰余金", "RetainedEarnings": "利益剰余金", "TreasuryShares": "自己株式", "AccumulatedOtherComprehensiveIncome": "その他の包括利益累計額", "NonControllingInterests": "非支配株主持分", "TotalLiabilitiesAndNetAssets": "負債純資産合計", "EquityAttributableToOwnersOfParent": "親会社の所有者に帰属する持分", "TotalEquity": "資本合計",
        "AssetsIFRS": "資産合計", "TotalAssetsIFRS": "資産合計", "CurrentAssetsIFRS": "流動資産", "NonCurrentAssetsIFRS": "固定資産", "NoncurrentAssetsIFRS": "固定資産", "PropertyPlantAndEquipmentIFRS": "有形固定資産", "IntangibleAssetsIFRS": "無形固定資産", "GoodwillIFRS": "のれん", "InvestmentsIFRS": "投資その他の資産", "LiabilitiesIFRS": "負債合計", "TotalLiabilitiesIFRS": "負債合計", "CurrentLiabilitiesIFRS": "流動負債", "NonCurrentLiabilitiesIFRS": "固定負債", "NoncurrentLiabilitiesIFRS": "固定負債", "EquityIFRS": "純資産合計", "TotalEquityIFRS": "純資産合計", "EquityAttributableToOwnersOfParentIFRS": "親会社の所有者に帰属する持分", "NonControllingInterestsIFRS": "非支配株主持分", "LiabilitiesAndEquityIFRS": "負債純資産合計",
    },
    "cash_flow_statement": {
        "CashFlowsFromOperatingActivities": "営業活動によるキャッシュ・フロー", "CashFlowsFromInvestingActivities": "投資活動によるキャッシュ・フロー", "CashFlowsFromFinancingActivities": "財務活動によるキャッシュ・フロー", "NetCashProvidedByUsedInOperatingActivitiesSummaryOfBusinessResults": "営業活動によるキャッシュ・フロー", "NetCashProvidedByUsedInInvestingActivitiesSummaryOfBusinessResults": "投資活動によるキャッシュ・フロー", "NetCashProvidedByUsedInFinancingActivitiesSummaryOfBusinessResults": "財務活動によるキャッシュ・フロー", "EffectOfExchangeRateChangeOnCashAndCashEquivalents": "現金及び現金同等物に係る換算差額", "NetIncreaseDecreaseInCashAndCashEquivalents": "現金及び現金同等物の増減額", "CashAndCashEquivalentsAtBeginningOfPeriod": "現金及び現金同等物の期首残高", "CashAndCashEquivalentsAtEndOfPeriod": "現金及び現金同等物の期末残高",
        "DepreciationAndAmortizationOpeCF": "減価償却費", "IncreaseDecreaseInNotesAndAccountsReceivable": "売上債権の増減額", "IncreaseDecreaseInInventories": "棚卸資産の増減額", "IncreaseDecreaseInNotesAndAccountsPayable": "仕入債務の増減額", "PurchaseOfPropertyPlantAndEquipment": "有形固定資産の取得による支出", "PurchaseOfInvestmentSecurities": "投資有価証券の取得による支出", "ProceedsFromIssuanceOfBonds": "社債の発行による収入", "RedemptionOfBonds": "社債の償還による支出", "DividendsPaid": "配当金の支払額", "PurchaseOfTreasuryShares": "自己株式の取得による支出",
    },
}

# The order in which elements are shown, by statement.
DISPLAY = {
    "income_statement": (
        "NetSales", "Revenue", "NetSalesIFRS", "RevenueIFRS", "SalesRevenueIFRS", "CostOfSales", "CostOfSalesIFRS", "GrossProfit", "GrossProfitIFRS",
        "SellingGeneralAndAdministrativeExpenses", "SellingGeneralAndAdministrativeExpensesIFRS", "OperatingExpensesIFRS", "OperatingIncome", "OperatingProfit", "OperatingIncomeIFRS",
        "OperatingProfitIFRS", "OperatingProfitLossIFRS", "NonOperatingIncome", "NonOperatingExpenses", "OrdinaryIncome", "ExtraordinaryIncome", "ExtraordinaryLoss",
        "IncomeBeforeIncomeTaxes", "ProfitBeforeTax", "ProfitBeforeTaxIFRS", "ProfitLossBeforeTaxIFRS", "IncomeTaxes", "IncomeTaxExpenseIFRS", "IncomeTaxesIFRS", "ProfitLoss",
        "ProfitForThePeriod", "ProfitLossIFRS", "ProfitForThePeriodIFRS", "ProfitLossAttributableToOwnersOfParent", "ProfitAttributableToOwnersOfParent",
        "ProfitLossAttributableToOwnersOfParentIFRS", "ProfitLossAttributableToNonControllingInterests", "ProfitLossAttributableToNonControllingInterestsIFRS",
    ),
    "balance_sheet": (
        "CurrentAssets", "CurrentAssetsIFRS", "CashAndDeposits", "CashAndCashEquivalents", "NotesAndAccountsReceivableTrade", "AccountsReceivableTrade", "Inventories", "NoncurrentAssets",
        "NonCurrentAssetsIFRS", "NoncurrentAssetsIFRS", "PropertyPlantAndEquipment", "PropertyPlantAndEquipmentIFRS", "IntangibleAssets", "IntangibleAssetsIFRS", "Goodwill", "GoodwillIFRS",
        "InvestmentsAndOtherAssets", "InvestmentsIFRS", "TotalAssets", "AssetsIFRS", "TotalAssetsIFRS", "CurrentLiabilities", "CurrentLiabilitiesIFRS", "NoncurrentLiabilities",
        "NonCurrentLiabilitiesIFRS", "NoncurrentLiabilitiesIFRS", "TotalLiabilities", "LiabilitiesIFRS", "TotalLiabilitiesIFRS", "ShareholdersEquity", "CapitalStock", "RetainedEarnings",
        "TreasuryShares", "NetAssets", "TotalEquity", "EquityIFRS", "TotalEquityIFRS", "EquityAttributableToOwnersOfParentIFRS", "NonControllingInterestsIFRS",
        "TotalLiabilitiesAndNetAssets", "LiabilitiesAndEquityIFRS",
    ),
    "cash_flow_statement": (
        "CashFlowsFromOperatingActivities", "CashFlowsFromInvestingActivities", "CashFlowsFromFinancingActivities", "EffectOfExchangeRateChangeOnCashAndCashEquivalents",
        "NetIncreaseDecreaseInCashAndCashEquivalents", "CashAndCashEquivalentsAtEndOfPeriod",
    ),
}
#: Labels over all statements; where an element is in two, the later statement's label holds.
LABELS = {k: v for s in ELEMENTS.values() for k, v in s.items()}


def element_dim(spark):
    """``statement, element, label, rank`` (null: not in the display order): a seed of some 130 rows."""
    rows = [(s, e, label, DISPLAY[s].index(e) if e in DISPLAY[s] else None) for s, own in ELEMENTS.items() for e, label in own.items()]
    return spark.createDataFrame(rows, "statement string, element string, label string, rank int")
