"""Derived inputs: the engine's tables made from the driver's, by SQL that Spark and DuckDB both run.

None of the driver's tables holds financial statements or Japanese text, so both sides derive them with the same text.
Whole numbers are used wherever a sum is taken. ``{grouped:x}`` marks a number with thousands separators, the one thing
that the two dialects write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

YEN = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"

#: Answers in eight notations, by line.
ANSWERS = f"""
SELECT id, subtask, company,
  CASE k WHEN 0 THEN CAST(v AS STRING) WHEN 1 THEN {{grouped:v}} WHEN 2 THEN concat('△', {{grouped:v}}) WHEN 3 THEN translate(CAST(v AS STRING), '0123456789', '０１２３４５６７８９')
    WHEN 4 THEN concat({{grouped:v}}, '百万円') WHEN 5 THEN concat(CAST(v AS STRING), '億') WHEN 6 THEN concat(CAST(v % 1000 AS STRING), '.', CAST(v % 10 AS STRING), '%') ELSE CASE v % 3 WHEN 0 THEN '増加' WHEN 1 THEN '改善した' ELSE 'Consistent' END END AS gold,
  CASE k WHEN 0 THEN concat(' ', {{grouped:p}}, ' ') WHEN 1 THEN CAST(p AS STRING) WHEN 2 THEN concat('-', CAST(p AS STRING)) WHEN 3 THEN {{grouped:p}}
    WHEN 4 THEN CAST(p AS STRING) WHEN 5 THEN concat({{grouped:p}}, '億円') WHEN 6 THEN concat(CAST(v % 1000 AS STRING), '.', CAST(p % 10 AS STRING), '％') ELSE CASE p % 3 WHEN 0 THEN '増加しました' WHEN 1 THEN '改善' ELSE 'consistent' END END AS predicted
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS company, l_orderkey % 8 AS k, CAST(floor(l_extendedprice) AS BIGINT) AS v,
    CAST(floor(l_extendedprice) AS BIGINT) + CAST(floor(floor(l_extendedprice) * ((l_orderkey + l_linenumber) % 5 - 2) * 6 / 1000) AS BIGINT) AS p,
    CASE l_linenumber % 3 WHEN 0 THEN 'consistency_checking' WHEN 1 THEN 'numerical_reasoning' ELSE 'temporal_reasoning' END AS subtask FROM lineitem) AS x
"""

#: Sums of a supplier's lines by year of the order: the numbers that statements are made of.
SUMS = f"""
SELECT l_suppkey AS c, year(o_orderdate) AS y, CAST(sum({YEN}) AS BIGINT) AS rev, CAST(sum({YEN} * l_linenumber) AS BIGINT) AS w, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, year(o_orderdate)
"""
_LINES = (
    # statement, pos, label, value, condition
    ("income_statement", 0, "売上高", "rev", "c % 5 <> 1"), ("income_statement", 0, "売上収益", "rev", "c % 5 = 1"), ("income_statement", 1, "売上原価", "rev - (rev - rev % 100) * (3 + c % 4) / 10 + CASE WHEN c % 23 = 7 THEN rev ELSE 0 END", "c % 6 <> 2"),
    ("income_statement", 2, "売上総利益", "(rev - rev % 100) * (3 + c % 4) / 10 + CASE WHEN c % 9 = 4 THEN rev - rev % 100 ELSE 0 END", "c % 6 <> 2"), ("income_statement", 3, "販売費及び一般管理費", "(rev - rev % 100) * (2 + w % 3) / 10", "c % 7 <> 3"),
    ("income_statement", 4, "営業利益", "(rev - rev % 100) * (3 + c % 4 - 2 - w % 3) / 10", "true"), ("income_statement", 5, "経常利益", "(rev - rev % 100) * (3 + c % 4 - 2 - w % 3) / 10 + w % 100000 - 50000", "c % 5 <> 1"),
    ("income_statement", 6, "当期純利益", "(rev - rev % 100) * (3 + c % 4 - 3) / 20 - w % 1000", "c % 4 <> 3"), ("income_statement", 7, "親会社株主に帰属する当期純利益", "(rev - rev % 100) * (3 + c % 4 - 3) / 20 - w % 2000", "c % 3 <> 2"), ("income_statement", 8, "非支配株主に帰属する当期純利益", "w % 1000", "c % 3 = 1"),
    ("balance_sheet", 0, "流動資産", "rev + w % 100000", "c % 11 <> 5"), ("balance_sheet", 1, "固定資産", "rev * 2 - w % 100000", "c % 5 <> 1"), ("balance_sheet", 1, "非流動資産", "rev * 2 - w % 100000", "c % 5 = 1"), ("balance_sheet", 2, "資産合計", "rev * 3 + CASE WHEN c % 10 = 7 THEN rev ELSE 0 END", "c % 8 <> 6"),
    ("balance_sheet", 3, "流動負債", "rev + w % 70000", "true"), ("balance_sheet", 4, "固定負債", "CASE WHEN c % 13 = 2 THEN 0 ELSE rev - w % 30000 END", "c % 5 <> 1"), ("balance_sheet", 4, "非流動負債", "rev - w % 30000", "c % 5 = 1"), ("balance_sheet", 5, "負債合計", "rev * 2 + w % 40000", "c % 3 <> 0"),
    ("balance_sheet", 6, "純資産合計", "rev - w % 40000", "c % 7 <> 5"), ("balance_sheet", 7, "株主資本合計", "rev - w % 50000", "c % 2 = 0"),
    ("cash_flow_statement", 0, "営業活動によるキャッシュ・フロー", "(rev - rev % 100) / 10 - w % 900000", "true"), ("cash_flow_statement", 1, "投資活動によるキャッシュ・フロー", "w % 800000 - (rev - rev % 100) / 20", "true"), ("cash_flow_statement", 2, "財務活動によるキャッシュ・フロー", "w % 300000 - 150000", "c % 4 <> 1"), ("cash_flow_statement", 3, "現金及び現金同等物の期末残高", "rev", "true"),
)
#: Line items: company, year, statement, pos, label, value (yen).
FACTS = " UNION ALL ".join(f"SELECT CAST(c AS STRING) AS company, CAST(y AS STRING) AS year, '{s}' AS statement, CAST({p} AS BIGINT) AS pos, '{label}' AS label, CAST(floor({v}) AS DOUBLE) AS value FROM sums WHERE {cond}" for s, p, label, v, cond in _LINES)
COMPANIES = "SELECT CAST(s_suppkey AS STRING) AS edinet_code, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'IFRS' WHEN 1 THEN 'J-GAAP' ELSE 'US-GAAP' END AS gaap FROM supplier"
#: A filing a company and year; the years of some companies have gaps.
FILINGS = "SELECT CAST(c AS STRING) AS company, CAST(y AS STRING) AS year, concat('S', CAST(c * 10000 + y AS STRING)) AS doc_id FROM sums WHERE (c + y) % 17 <> 0"

#: Items as named elements in contexts, some repeated, some unknown.
RAW_ITEMS = f"""
SELECT CAST(l_suppkey AS STRING) AS company, CAST(l_orderkey % 40 AS STRING) AS year, 'income_statement' AS statement, l_orderkey * 10 + l_linenumber AS pos,
  CASE l_partkey % 9 WHEN 0 THEN 'NetSales' WHEN 1 THEN 'NetSalesIFRS' WHEN 2 THEN 'CostOfSales' WHEN 3 THEN 'OperatingIncome' WHEN 4 THEN 'OperatingProfitIFRS' WHEN 5 THEN 'ResearchAndDevelopmentExpenses' WHEN 6 THEN 'TotalAssets' WHEN 7 THEN 'NoSuchElement' ELSE '' END AS element,
  concat(CASE WHEN l_returnflag = 'R' THEN 'Prior1Year' ELSE 'CurrentYear' END, CASE WHEN l_linestatus = 'O' THEN 'Duration' ELSE 'Instant' END, CASE WHEN l_quantity > 40 THEN '_NonConsolidatedMember' ELSE '' END) AS context,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST({YEN} AS DOUBLE) END AS value FROM lineitem
"""
#: Question rows of documents: companies, subtasks and standards, whole texts of which some repeat.
QUESTIONS = """
SELECT doc_id AS idx, doc_id AS pos, text AS question, CAST(n_chars % 7 AS STRING) AS answer, source AS edinet_code, concat('Company ', source) AS company_name,
  CASE doc_id % 3 WHEN 0 THEN 'numerical_reasoning' WHEN 1 THEN 'consistency_checking' ELSE 'temporal_reasoning' END AS subtask, CASE n_chars % 3 WHEN 0 THEN 'IFRS' WHEN 1 THEN 'J-GAAP' ELSE 'US-GAAP' END AS accounting_standard,
  CAST(2023 + doc_id % 2 AS STRING) AS filing_year, 1 + n_chars % 6 AS steps FROM documents
"""
#: Attempts of a run.
ATTEMPTS = """
SELECT event_id AS id, event_type AS subtask, CASE user_id % 3 WHEN 0 THEN 'IFRS' WHEN 1 THEN 'J-GAAP' ELSE 'US-GAAP' END AS accounting_standard, CASE user_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-2.5-flash' WHEN 2 THEN 'gpt-5.4-mini' ELSE 'unlisted' END AS model,
  event_id % 3 <> 0 AS correct, event_id % 11 <> 0 AS parse_success, event_id % 29 = 0 AS truncated, CASE WHEN event_id % 37 = 0 THEN 'timeout' END AS error,
  event_id % 1000 + 200 AS input_tokens, user_id % 500 AS output_tokens, event_id % 7 AS thinking_tokens, CAST(floor(value * 100) AS DOUBLE) / 100 AS latency_s FROM events
"""
#: Programs with numbers from orders; a few can't be run.
PROGRAMS = """
SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS a, 1 + o_custkey % 97 AS b, o_orderkey % 11 AS k FROM orders
"""
TEXTS = {"answers": ANSWERS, "sums": SUMS, "facts": FACTS, "companies": COMPANIES, "filings": FILINGS, "raw_items": RAW_ITEMS, "questions": QUESTIONS, "attempts": ATTEMPTS, "programs": PROGRAMS}
NEEDS = {"facts": ("sums",), "filings": ("sums",)}
#: The driver's tables that each reads.
READS = {"answers": ("lineitem",), "sums": ("lineitem", "orders"), "facts": (), "companies": ("supplier",), "filings": (), "raw_items": ("lineitem",), "questions": ("documents",), "attempts": ("events",), "programs": ("orders",)}


def _dialect(text: str, spark: bool) -> str:
    return re.sub(r"\{grouped:(\w+)\}", lambda m: f"format_number({m[1]}, 0)" if spark else f"format('{{:,}}', {m[1]})", text)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the whole of the driver's tables, as a lazy frame."""
    if name == "facts":  # the same lines as the SQL's union, in one pass over the sums
        lines = ", ".join(f"CASE WHEN {cond} THEN struct('{s}' AS statement, CAST({p} AS BIGINT) AS pos, '{label}' AS label, CAST(floor({v}) AS DOUBLE) AS value) END" for s, p, label, v, cond in _LINES)
        own = derived(spark, sf_dir, "sums").selectExpr("CAST(c AS STRING) AS company", "CAST(y AS STRING) AS year", f"explode(filter(array({lines}), x -> x IS NOT NULL)) AS x")
        return own.select("company", "year", "x.*")
    views = {}
    for need in NEEDS.get(name, ()):
        views[need] = derived(spark, sf_dir, need)
    for t in READS[name]:
        views[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(_bind(_dialect(TEXTS[name], True), views), **views)


def _bind(text: str, views: dict) -> str:
    """Names of tables as the placeholders by which spark.sql takes frames, so that no view is left in the session."""
    for v in views:
        text = re.sub(rf"\b(FROM|JOIN) {v}\b", rf"\1 {{{v}}}", text)
    return text


def with_tables(body: str, *names: str) -> str:
    """DuckDB text: the derived tables as common table expressions before ``body``, which may begin with ``WITH``."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    ctes = ", ".join(f"{n} AS ({_dialect(TEXTS[n], False).strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[14:].strip()}"
    return f"WITH {ctes}, {body[4:].strip()}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
