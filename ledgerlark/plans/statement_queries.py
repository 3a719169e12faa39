"""Queries of statements, contexts, question templates, validation, sampling and audits."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ledgerlark.functions import numbers as N
from ledgerlark.operators import audit as A
from ledgerlark.operators import program as P
from ledgerlark.operators import statements as S
from ledgerlark.operators import templates as G
from ledgerlark.operators import validate as V
from ledgerlark.plans.registry import QUERIES, SQL, query
from ledgerlark.schema import CURRENT, DISPLAY, ELEMENTS, LABELS, PREFIXES, TARGETS, WINDOWS
from ledgerlark.scratch import new_folder
from ledgerlark.sources import collect as C
from ledgerlark.sources import io

# line items

YEARS = "y AS (SELECT company, max(year) AS y1, (list_sort(list_distinct(list(year)), 'DESC'))[2] AS y2, max_by(doc_id, year) AS doc_id FROM filings GROUP BY company)"
LINES = f"""{YEARS}, cur AS (SELECT f.company, statement, pos, label, value, y1, y2 FROM facts f JOIN y ON f.company = y.company AND f.year = y.y1),
 prev AS (SELECT f.company, statement, label, value AS pv FROM facts f JOIN y ON f.company = y.company AND f.year = y.y2),
 one AS (SELECT *, row_number() OVER g AS rn, count(*) OVER (PARTITION BY company, statement) AS n FROM cur WINDOW g AS (PARTITION BY company, statement ORDER BY pos)),
 two AS (SELECT one.company, one.statement, pos, label, value, y1, y2, pv, n, row_number() OVER (PARTITION BY company, statement ORDER BY pos) AS rk, count(*) OVER (PARTITION BY company, statement) AS nc FROM one JOIN prev USING (company, statement, label))"""


@query("w1_latest_two_years", f"WITH {YEARS} SELECT company, y1, y2 FROM y", "filings", "facts")
def _(filings, facts):
    return S.company_lines(facts, filings).select("company", "y1", "y2")


@query("j2_common_labels", f"WITH {LINES} SELECT company, statement, pos, label, value AS cur, pv AS prev FROM two", "facts", "filings")
def _(facts, filings):
    return S.common_labels(facts, filings).select("company", "statement", "pos", "label", "cur", "prev")


@query("j9_prior_year", "SELECT a.company, a.year, a.label, a.value AS cur, b.value AS prev FROM facts a JOIN facts b ON a.company = b.company AND a.label = b.label AND CAST(b.year AS INT) = CAST(a.year AS INT) - 1", "facts")
def _(f):
    return S.with_prior_year(f).select("company", "year", "label", F.col("value").alias("cur"), "prev")


_CURRENT = ", ".join(f"'{c}'" for c in CURRENT)


@query("f2_current_context", f"SELECT pos, context IN ({_CURRENT}) AS is_current FROM raw_items", "raw_items")
def _(r):
    return r.select("pos", S.is_current(F.col("context")).alias("is_current"))


@query("f3_numeric_items", "SELECT pos, value FROM raw_items WHERE value IS NOT NULL AND element <> ''", "raw_items")
def _(r):
    return S.numeric_items(r).select("pos", "value")


@query("j3_labels", f"SELECT pos, CASE element {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in LABELS.items())} END AS label FROM raw_items WHERE element <> ''", "raw_items")
def _(r):
    return S.with_labels(r.where("element <> ''")).select("pos", F.col("any_label").alias("label"))


@query("w2_first_per_label", "SELECT company, year, label, pos, value FROM (SELECT company, year, element AS label, pos, value, row_number() OVER (PARTITION BY company, year, statement, element ORDER BY pos, value) AS rn FROM raw_items WHERE value IS NOT NULL AND element <> '') WHERE rn = 1", "raw_items")
def _(r):
    return S.first_items(r.withColumnRenamed("element", "label")).select("company", "year", "label", "pos", "value")


_RANKS = " ".join(f"WHEN '{e}' THEN {k}" for k, e in enumerate(DISPLAY["income_statement"]))
_OWN = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in ELEMENTS["income_statement"].items() if e in DISPLAY["income_statement"])
_ANY = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in LABELS.items())


@query(
    "w3_display_order",
    f"""WITH u AS (SELECT company, year, element, pos, max(value) AS hi, min(value) AS lo FROM raw_items WHERE context IN ({_CURRENT}) AND value IS NOT NULL AND element <> '' GROUP BY ALL),
 e AS (SELECT company, year, element, arg_max(hi, pos) AS last, arg_min(lo, pos) AS first, min(pos) AS p0 FROM u GROUP BY company, year, element),
 c AS (SELECT company, year, CASE element {_OWN} END AS label, CASE element {_RANKS} END AS pos, last AS value FROM e UNION ALL SELECT company, year, CASE element {_ANY} END, p0 + 1000000, first FROM e)
 SELECT company, year, label, CAST(min(pos) AS BIGINT) AS pos, arg_min(value, pos) AS value FROM c WHERE label IS NOT NULL AND pos IS NOT NULL GROUP BY company, year, label""",
    "raw_items",
)
def _(r):
    # the derived rows repeat a position here and there: of equal ones the larger value is last, the smaller first
    rows = r.where(S.is_current(F.col("context"))).groupBy("company", "year", "statement", "element", "pos").agg(F.max("value").alias("hi"), F.min("value").alias("lo")).withColumn("context", F.lit(CURRENT[0]))
    both = rows.select("company", "year", "statement", "element", "context", (F.col("pos") * 2 + 1).alias("pos"), F.col("hi").alias("value")).unionByName(rows.select("company", "year", "statement", "element", "context", (F.col("pos") * 2).alias("pos"), F.col("lo").alias("value")))
    out = S.element_items(both)
    at = F.col("pos")
    return out.select("company", "year", "label", F.when(at >= 1_000_000, F.floor((at - 1_000_000) / 2).cast("bigint") + 1_000_000).otherwise(at).alias("pos"), "value")


#: Values a thousandth and a millionth as large too, so that every scale occurs.
_SIZES = "(SELECT company, year, statement, value / d AS value, d FROM facts, (VALUES (1.0::DOUBLE), (1000.0::DOUBLE), (1000000.0::DOUBLE)) t(d))"


@query("a9_scale", f"SELECT company, year, statement, d, CASE WHEN max(abs(value)) >= 1e8 THEN '百万円' WHEN max(abs(value)) >= 1e6 THEN '千円' ELSE '円' END AS scale FROM {_SIZES} GROUP BY company, year, statement, d", "facts")
def _(f):
    sizes = f.select("company", "year", "statement", "value", F.explode(F.array(F.lit(1.0), F.lit(1000.0), F.lit(1000000.0))).alias("d")).withColumn("value", F.col("value") / F.col("d"))
    own = sizes.groupBy("company", "year", "statement", "d").agg(S.scale_by_group(F.col("value")).alias("scale"), F.collect_list("value").alias("all"))  # a few values a statement
    both = F.when(S.scale_of(F.col("all"))["label"] == F.col("scale"), F.col("scale")).otherwise("the two differ")
    return own.select("company", "year", "statement", "d", both.alias("scale"))


_WINDOW_SQL = f"""WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS company, o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, o_orderstatus <> 'P' AS x FROM orders),
 h AS (SELECT *, CASE {' '.join(f"WHEN d BETWEEN make_date(y, {a}, {b}) AND make_date(y, {c}, {e}) THEN {k}" for k, (a, b, c, e) in enumerate(WINDOWS))} END AS w FROM f WHERE x)
 SELECT company, CAST(y AS VARCHAR) AS year, CAST(w AS INT) AS window_no, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY company, y ORDER BY w, d DESC, doc_id DESC) AS rn FROM h WHERE w IS NOT NULL) WHERE rn = 1"""


def _windows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    filings = o.select(F.col("o_custkey").cast("string").alias("company"), F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("filing_date"), (F.col("o_orderstatus") != "P").alias("has_xbrl"))
    wanted = filings.select("company", F.year("filing_date").cast("string").alias("year")).distinct()
    return S.pick_filings(filings, wanted).select("company", "year", F.col("window").alias("window_no"), "doc_id")


QUERIES["j4_filing_windows"], SQL["j4_filing_windows"] = _windows, _WINDOW_SQL


def _collected(spark, sf_dir):
    """Orders as a folder of filings, asked through a client in two runs: the second one asks for what the first one has not."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = F.array(F.struct(F.lit("売上高").alias("科目"), F.col("o_totalprice").alias("当期")))
    told = F.to_json(F.struct(F.lit("IFRS").alias("accounting_standard"), lines.alias("income_statement")))
    root, path = new_folder(spark), new_folder(spark)
    filings = o.select(F.col("o_custkey").cast("string").alias("company"), F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("filing_date"), (F.col("o_orderstatus") != "P").alias("has_xbrl"), told.alias("told"))
    buckets = C.catalog_buckets(o.count())
    C.write_catalog(filings, root, buckets)
    years = [str(r["y"]) for r in o.select(F.year("o_orderdate").alias("y")).distinct().orderBy("y").collect()]  # some years
    companies = filings.select(F.col("company").alias("edinet_code")).distinct()
    for part in (companies.where("CAST(edinet_code AS BIGINT) % 2 = 0"), companies):
        C.collect(part, years, lambda: C.CatalogClient(root, buckets), path, wave=50_000, parallel=spark.sparkContext.defaultParallelism, near=C.catalog_bucket("edinet_code", buckets))
    _, found, items = C.load_collected(spark, path)
    return found.join(items, ["company", "year"]).select("company", "year", F.col("doc_id").cast("bigint").alias("doc_id"), "accounting_standard", "label", "value")


QUERIES["s8_collect"], SQL["s8_collect"] = _collected, f"SELECT w.company, w.year, w.doc_id, 'IFRS' AS accounting_standard, '売上高' AS label, CAST(o_totalprice AS DOUBLE) AS value FROM ({_WINDOW_SQL}) w JOIN orders ON o_orderkey = w.doc_id"


# contexts

_CELL = "concat(CASE WHEN {x} < 0 THEN '△' ELSE '' END, CASE WHEN abs({x}) = floor(abs({x})) THEN format('{{:,.0f}}', abs({x})) ELSE format('{{:,.1f}}', abs({x})) END)"


def cell(x: str) -> str:
    return _CELL.format(x=x)


_SCALED = "CASE WHEN top >= 1e8 THEN '百万円' WHEN top >= 1e6 THEN '千円' ELSE '円' END AS scale, CASE WHEN top >= 1e8 THEN 1e6 WHEN top >= 1e6 THEN 1e3 ELSE 1.0::DOUBLE END AS div"


def _pair(kind: str, statement: str, least: int, most: int) -> str:
    """Lines that two years share."""
    return f"SELECT '{kind}' AS kind, company, rk AS row_no, label, value, pv, max(greatest(abs(value), abs(pv))) OVER (PARTITION BY company) AS top, y1, y2 FROM two WHERE statement = '{statement}' AND n >= {max(3, least)} AND nc >= {least} AND rk <= {most}"


def _single(kind: str, where: str) -> str:
    return f"SELECT '{kind}' AS kind, company, rn AS row_no, label, value, NULL::DOUBLE AS pv, max(abs(value)) OVER (PARTITION BY company) AS top, y1, y2 FROM one WHERE statement = 'balance_sheet' AND n >= 4 AND rn <= 18 AND {where}"


def _need(statement: str, labels: tuple[str, ...]) -> str:
    order = " ".join(f"WHEN '{label}' THEN {k}" for k, label in enumerate(labels))
    return f"SELECT company, statement, label, value, y1, y2, n, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN rn <= 4 THEN rn WHEN CASE label {order} END IS NOT NULL THEN 10 + CASE label {order} END ELSE 100 + rn END) AS rk FROM one WHERE statement = '{statement}'"


CONTEXT = f"""{LINES}, need AS ({_need('income_statement', S.REQUIRED_INCOME)} UNION ALL {_need('balance_sheet', S.REQUIRED_BALANCE)}),
 enough AS (SELECT company FROM one GROUP BY company HAVING count(DISTINCT CASE WHEN n >= 2 THEN statement END) FILTER (WHERE statement <> 'cash_flow_statement') = 2),
 lines AS ({_pair('pl_comparison', 'income_statement', 3, 16)} UNION ALL {_pair('bs_summary', 'balance_sheet', 4, 18)} UNION ALL {_single('bs_summary', "y2 IS NOT NULL AND company NOT IN (SELECT company FROM two WHERE statement = 'balance_sheet' AND nc >= 4)")}
  UNION ALL {_single('bs_consistency', "company IN (SELECT company FROM one WHERE statement = 'balance_sheet' AND contains(label, '合計'))")} UNION ALL {_pair('cf_summary', 'cash_flow_statement', 3, 10)}
  UNION ALL SELECT 'cross_statement', company, CASE WHEN statement = 'income_statement' THEN rk ELSE rk + least(7, (SELECT max(m.n) FROM one m WHERE m.company = need.company AND m.statement = 'income_statement')) END, label, value, NULL, max(abs(value)) OVER (PARTITION BY company), y1, y2 FROM need WHERE rk <= 7 AND company IN (SELECT company FROM enough)),
 ctx AS (SELECT kind, company, row_no, label, value, pv, y1, y2, {_SCALED} FROM lines)"""


def _contexts(facts, companies, filings):
    return S.contexts(facts, companies, filings)


def _builder(name: str, kind: str) -> None:
    @query(name, f"WITH {CONTEXT} SELECT company, y1 AS year, CAST(row_no AS BIGINT) AS row_no, label, concat({cell('(value / div)')}, CASE WHEN pv IS NOT NULL THEN concat('|', {cell('(pv / div)')}) ELSE '' END) AS cells, scale FROM ctx WHERE kind = '{kind}'", "facts", "companies", "filings")
    def _(facts, companies, filings):
        rows = _contexts(facts, companies, filings).where(F.col("context_type") == kind).select("edinet_code", "filing_year", "scale", F.posexplode("table.rows").alias("i", "r"))
        return rows.select(F.col("edinet_code").alias("company"), F.col("filing_year").alias("year"), (F.col("i") + 1).cast("bigint").alias("row_no"), F.get("r", F.lit(0)).alias("label"), F.array_join(F.slice("r", 2, 2), "|").alias("cells"), "scale")


for _name, _kind in (("b1_income_comparison", "pl_comparison"), ("b2_balance_summary", "bs_summary"), ("b3_balance_consistency", "bs_consistency"), ("b4_cash_flow_summary", "cf_summary"), ("b5_cross_statement", "cross_statement")):
    _builder(_name, _kind)


@query("b6_f4_kinds", f"WITH {CONTEXT} SELECT company, kind, count(*) AS lines FROM ctx GROUP BY company, kind", "facts", "companies", "filings")
def _(facts, companies, filings):
    return _contexts(facts, companies, filings).select(F.col("edinet_code").alias("company"), F.col("context_type").alias("kind"), F.size("table.rows").cast("bigint").alias("lines"))


_MOVE = "CASE WHEN c IS NULL OR p IS NULL THEN 'であった' WHEN p = 0 THEN CASE WHEN c > 0 THEN 'で増加した' WHEN c = 0 THEN 'でほぼ横ばいであった' ELSE 'で減少した' END WHEN abs((c - p) / abs(p)) < 0.005 THEN 'でほぼ横ばいであった' WHEN c > p THEN 'で増加した' ELSE 'で減少した' END"


@query("k1_k3_context_texts", f"""WITH {CONTEXT}, s AS (SELECT company, arg_min(CASE WHEN value > pv THEN '増収' ELSE '減収' END, row_no) FILTER (WHERE contains(label, '売上')) AS t FROM ctx WHERE kind = 'pl_comparison' GROUP BY company),
 a AS (SELECT company, max(CASE WHEN label = '資産合計' THEN value END) AS c, max(CASE WHEN label = '資産合計' THEN pv END) AS p FROM ctx WHERE kind = 'bs_summary' GROUP BY company),
 f AS (SELECT company, CASE WHEN sum(value) FILTER (WHERE label IN ('{S.OPERATING}', '{S.INVESTING}')) > 0 THEN 'プラス' ELSE 'マイナス' END AS t FROM ctx WHERE kind = 'cf_summary' GROUP BY company)
 SELECT company, 'pl_comparison' AS kind, concat('当期は前期比で', coalesce(t, '増収'), 'となった。') AS text FROM s UNION ALL SELECT company, 'bs_summary', concat('総資産は前期比', {_MOVE}, '。') FROM a UNION ALL SELECT company, 'cf_summary', concat('フリーキャッシュフローは', t, 'であった。') FROM f""", "facts", "companies", "filings")
def _(facts, companies, filings):
    c = _contexts(facts, companies, filings).where("context_type IN ('pl_comparison', 'bs_summary', 'cf_summary')")
    return c.select(F.col("edinet_code").alias("company"), F.col("context_type").alias("kind"), F.get("post_text", F.lit(0)).alias("text"))


# templates: SQL formulas on the pivoted values of each kind of context

_NAMES = {
    "sales": "売上高", "rev2": "売上収益", "cogs": "売上原価", "gross": "売上総利益", "sga": "販売費及び一般管理費", "op": "営業利益", "ord": "経常利益", "ni1": "当期純利益", "ni2": "親会社株主に帰属する当期純利益", "ca": "流動資産", "fa1": "固定資産", "fa2": "非流動資産", "ta0": "資産合計", "cl": "流動負債", "fl1": "固定負債",
    "fl2": "非流動負債", "tl0": "負債合計", "eq1": "純資産合計", "eq2": "株主資本合計", "ocf": G.OPERATING, "icf": G.INVESTING, "fcf": G.FINANCING,
}
_PIVOT = ", ".join(f"max(CASE WHEN label = '{v}' THEN value / div END) AS {k}, max(CASE WHEN label = '{v}' AND CAST(y2 AS INT) = CAST(y1 AS INT) - 1 THEN pv / div END) AS {k}_p" for k, v in _NAMES.items())
#: What formulas may use: stand-ins as the templates define them, for both years.
_STAND = ", ".join(
    f"coalesce(nullif(fa1{s}, 0), fa2{s}) AS fa{s}, coalesce(nullif(fl1{s}, 0), fl2{s}) AS fl{s}, coalesce(nullif(eq1{s}, 0), eq2{s}) AS eq{s}" for s in ("", "_p")
)
_TOTAL = ", ".join(f"CASE WHEN ta0{s} <> 0 THEN ta0{s} WHEN ca{s} <> 0 AND fa{s} <> 0 THEN ca{s} + fa{s} ELSE ta0{s} END AS ta{s}, CASE WHEN tl0{s} <> 0 THEN tl0{s} WHEN cl{s} <> 0 AND fl{s} <> 0 THEN cl{s} + fl{s} ELSE tl0{s} END AS tl{s}" for s in ("", "_p"))
_WIDE = f"""w AS (SELECT company, kind, y1, any_value(scale) AS scale, {_PIVOT} FROM ctx GROUP BY company, kind, y1),
 w2 AS (SELECT *, {_STAND}, coalesce(sales, rev2) AS rev, CASE WHEN sales IS NOT NULL THEN sales_p ELSE rev2_p END AS rev_p, CASE WHEN ni1 IS NOT NULL THEN ni1 ELSE ni2 END AS ni, CASE WHEN ni1 IS NOT NULL THEN ni1_p ELSE ni2_p END AS ni_p, coalesce(nullif(ni1, 0), ni2) AS nix FROM w), v AS (SELECT *, {_TOTAL} FROM w2)"""


# Each gives the answer as text and the program's result as a number (1 and 0 for truth).


def _p1(x):
    return f"format('{{:.1f}}%', {x})", x


def _p2(x):
    return f"format('{{:.2f}}%', {x})", x


def _m(x, unit="''"):
    return f"concat(format('{{:,.0f}}', {x}), {unit})", x


def _w(test, yes, no):
    return f"CASE WHEN {test} THEN '{yes}' ELSE '{no}' END", f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"


def _x(x):
    return f"concat(format('{{:.2f}}', {x}), '倍')", f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


def _pt(x):
    return f"concat(format('{{:.1f}}', {x}), 'ポイント')", x


#: Template: (guard, answer, steps).
FORMULAS = {
    "PL1": ("rev_p <> 0", _p1("(rev - rev_p) / rev_p * 100"), 3), "PL2": ("rev <> 0 AND op IS NOT NULL", _p1("op / rev * 100"), 2), "PL3": ("rev IS NOT NULL AND rev_p IS NOT NULL", _m("abs(rev - rev_p)", "scale"), 2), "PL4": ("rev <> 0 AND gross IS NOT NULL", _p1("gross / rev * 100"), 2),
    "PL5": ("op > 0 AND op_p > 0", _p1("(op - op_p) / op_p * 100"), 3), "PL6": ("rev <> 0 AND sga IS NOT NULL", _p1("sga / rev * 100"), 2), "PL7": ("rev <> 0 AND rev_p <> 0 AND ord IS NOT NULL AND ord_p IS NOT NULL", _pt("ord / rev * 100 - ord_p / rev_p * 100"), 5),
    "PL8": ("rev IS NOT NULL AND rev_p IS NOT NULL", _w("rev - rev_p > 0", "増収", "減収"), 2), "PL9": ("op IS NOT NULL AND op_p IS NOT NULL", _w("op - op_p > 0", "増益", "減益"), 2), "PL10": ("rev <> 0 AND rev_p <> 0 AND op IS NOT NULL AND op_p IS NOT NULL", _w("op / rev - op_p / rev_p > 0", "改善", "悪化"), 4),
    "PL11": ("ord IS NOT NULL AND ord_p IS NOT NULL", _w("ord - ord_p > 0", "増益", "減益"), 2), "PL12": ("rev <> 0 AND ni IS NOT NULL", _p1("ni / rev * 100"), 2), "PL13": ("rev <> 0 AND cogs IS NOT NULL", _p1("cogs / rev * 100"), 2), "PL14": ("rev IS NOT NULL AND cogs IS NOT NULL AND gross IS NOT NULL", _m("rev - cogs"), 1),
    "PL15": ("gross IS NOT NULL AND sga IS NOT NULL AND op IS NOT NULL", _m("gross - sga"), 1), "PL16": ("rev <> 0 AND rev_p <> 0 AND gross IS NOT NULL AND gross_p IS NOT NULL", _w("gross / rev - gross_p / rev_p > 0", "改善", "悪化"), 4), "PL17": ("ni IS NOT NULL AND ni_p IS NOT NULL", _w("ni - ni_p > 0", "増益", "減益"), 2),
    "PL18": ("rev <> 0 AND rev_p <> 0 AND ord IS NOT NULL AND ord_p IS NOT NULL", _w("ord / rev - ord_p / rev_p > 0", "改善", "悪化"), 4),
    "BS1": ("ca <> 0 AND cl <> 0", _p1("ca / cl * 100"), 2), "BS2": ("eq <> 0 AND ta <> 0", _p1("eq / ta * 100"), 2), "BS3": ("tl <> 0 AND ta <> 0 AND tl0 <> 0", _p1("tl / ta * 100"), 2), "BS4": ("fa <> 0 AND ta <> 0", _p1("fa / ta * 100"), 2), "BS5": ("ta IS NOT NULL AND ta_p IS NOT NULL", _w("ta - ta_p > 0", "増加", "減少"), 2),
    "BS6": ("eq IS NOT NULL AND eq_p IS NOT NULL AND ta <> 0 AND ta_p <> 0", _w("eq / ta - eq_p / ta_p > 0", "改善", "悪化"), 4),
    "CC1": ("ca <> 0 AND fa <> 0 AND cl <> 0 AND eq <> 0", _w("abs((ca + fa) - (cl + coalesce(fl, 0) + eq)) < 0.001", "はい", "いいえ"), 4), "CC2": ("ca <> 0 AND fa <> 0", _m("ca + fa"), 1), "CC3": ("cl <> 0 AND fl <> 0", _m("cl + fl"), 1), "CC4": ("ca <> 0 AND fa <> 0 AND eq <> 0 AND ca + fa <> 0", _p1("eq / (ca + fa) * 100"), 3),
    "CF1": ("ocf IS NOT NULL AND icf IS NOT NULL", _m("ocf + icf", "scale"), 1), "CF2": ("ocf IS NOT NULL AND icf IS NOT NULL AND fcf IS NOT NULL", _m("ocf + icf + fcf", "scale"), 2), "CF3": ("ocf <> 0 AND icf <> 0", _p1("ocf / abs(icf) * 100"), 2), "CF4": ("ocf IS NOT NULL AND ocf_p IS NOT NULL", _w("ocf - ocf_p > 0", "増加", "減少"), 2),
    "CF5": ("ocf IS NOT NULL AND icf IS NOT NULL AND ocf_p IS NOT NULL AND icf_p IS NOT NULL", _w("(ocf + icf) - (ocf_p + icf_p) > 0", "改善", "悪化"), 4), "CF6": ("icf IS NOT NULL AND icf_p IS NOT NULL", _w("icf - icf_p > 0", "増加", "減少"), 2), "CF7": ("fcf IS NOT NULL AND fcf_p IS NOT NULL", _w("fcf - fcf_p > 0", "増加", "減少"), 2),
    "XS1": ("ord <> 0 AND ta <> 0", _p2("ord / ta * 100"), 2), "XS2": ("nix <> 0 AND eq <> 0", _p2("nix / eq * 100"), 2), "XS3": ("op <> 0 AND rev <> 0", _p1("op / rev * 100"), 2), "XS4": ("rev IS NOT NULL AND ta <> 0", _p1("rev / ta * 100"), 2), "XS5": ("tl <> 0 AND eq <> 0 AND ta <> 0", _m("tl + eq"), 1), "XS6": ("ord <> 0 AND ta <> 0", _p2("ord / ta * 100"), 2),
    "DP1": ("rev <> 0 AND nix <> 0 AND ta <> 0 AND eq <> 0", _p2("(nix / rev) * (rev / ta) * (ta / eq) * 100"), 6), "DP2": ("rev <> 0 AND nix <> 0 AND ta <> 0 AND eq <> 0", _p2("nix / rev * 100"), 2), "DP3": ("rev <> 0 AND nix <> 0 AND ta <> 0 AND eq <> 0", _x("rev / ta"), 2), "DP4": ("rev <> 0 AND nix <> 0 AND ta <> 0 AND eq <> 0", _x("ta / eq"), 2),
}
_KIND = {"PL": "pl_comparison", "BS": "bs_summary", "CC": "bs_consistency", "CF": "cf_summary", "XS": "cross_statement", "DP": "cross_statement"}


#: Question wordings that must come out, with {who}, {now}, {last} and the labels that stand in. Fixed values.
ASKED = {
    "PL1": "{who}の{now}の{rev}は前期比で何%増減したか。", "PL2": "{who}の{now}の営業利益率は何%か。", "PL3": "{who}の{rev}は{last}から{now}にかけていくら{moved}したか。", "PL4": "{who}の{now}の売上総利益率は何%か。", "PL5": "{who}の{now}の営業利益は前期比で何%変化したか。", "PL6": "{who}の{now}の売上高販管費率は何%か。",
    "PL7": "{who}の経常利益率は{last}から{now}にかけて何ポイント変化したか。", "PL8": "{who}は{last}から{now}にかけて増収か減収か。", "PL9": "{who}は{last}から{now}にかけて営業利益ベースで増益か減益か。", "PL10": "{who}の営業利益率は{last}から{now}にかけて改善したか悪化したか。", "PL11": "{who}は{last}から{now}にかけて経常利益ベースで増益か減益か。", "PL12": "{who}の{now}の当期純利益率は何%か。",
    "PL13": "{who}の{now}の売上原価率は何%か。", "PL14": "{who}の{now}の{rev}から売上原価を差し引いた額はいくらか。", "PL15": "{who}の{now}の売上総利益から販売費及び一般管理費を差し引いた額はいくらか。", "PL16": "{who}の売上総利益率は{last}から{now}にかけて改善したか悪化したか。", "PL17": "{who}は{last}から{now}にかけて当期純利益ベースで増益か減益か。", "PL18": "{who}の経常利益率は{last}から{now}にかけて改善したか悪化したか。",
    "BS1": "{who}の{now}の流動比率は何%か。", "BS2": "{who}の{now}の自己資本比率は何%か。", "BS3": "{who}の{now}の負債比率(負債/総資産)は何%か。", "BS4": "{who}の{now}の{fa}比率({fa}/総資産)は何%か。", "BS5": "{who}の総資産は{last}から{now}にかけて増加したか減少したか。", "BS6": "{who}の自己資本比率は{last}から{now}にかけて改善したか悪化したか。",
    "CC1": "{who}の{now}の資産の部の合計(流動資産+{fa})は、負債・{eq}の合計と一致するか。", "CC2": "{who}の{now}の流動資産と{fa}の合計はいくらか。", "CC3": "{who}の{now}の流動負債と{fl}の合計(負債合計)はいくらか。", "CC4": "{who}の{now}の{eq}は総資産の何%を占めるか。",
    "CF1": "{who}の{now}のフリーキャッシュフロー(営業CF+投資CF)はいくらか。", "CF2": "{who}の{now}の3つのキャッシュフロー活動の合計額はいくらか(為替影響除く)。", "CF3": "{who}の{now}の営業CFは投資CFの何%をカバーしているか。", "CF4": "{who}の営業キャッシュフローは{last}から{now}にかけて増加したか減少したか。", "CF5": "{who}のフリーキャッシュフローは{last}から{now}にかけて改善したか悪化したか。",
    "CF6": "{who}の投資活動によるキャッシュ・フローは{last}から{now}にかけて増加したか減少したか。", "CF7": "{who}の財務活動によるキャッシュ・フローは{last}から{now}にかけて増加したか減少したか。",
    "XS1": "{who}の{now}のROA(経常利益/総資産)は何%か。", "XS2": "{who}の{now}のROE({ni}/純資産)は何%か。", "XS3": "{who}の{now}の{rev}に対する営業利益率は何%か。", "XS4": "{who}の{now}の総資産回転率({rev}/総資産*100)は何%か。", "XS5": "{who}の{now}の負債合計と{eq}の合計はいくらか。", "XS6": "{who}の{now}の損益計算書の経常利益を貸借対照表の総資産で割った値は何%か。",
    "DP1": "{who}の{now}のROEをDuPont分解(純利益率×総資産回転率×財務レバレッジ)で求めると何%か。", "DP2": "{who}の{now}の売上高純利益率は何%か。", "DP3": "{who}の{now}の総資産回転率({rev}/総資産)は何倍か。", "DP4": "{who}の{now}の財務レバレッジ(総資産/{eq})は何倍か。",
}
_SAID = {
    "who": "(SELECT name FROM companies WHERE edinet_code = v.company)", "now": "concat(y1, '年3月期')", "last": "concat(CAST(CAST(y1 AS INT) - 1 AS VARCHAR), '年3月期')", "rev": "CASE WHEN sales IS NOT NULL THEN '売上高' ELSE '売上収益' END", "ni": "CASE WHEN ni1 IS NOT NULL THEN '当期純利益' ELSE '親会社株主に帰属する当期純利益' END",
    "moved": "CASE WHEN rev > rev_p THEN '増加' ELSE '減少' END", "fa": "CASE WHEN fa1 IS NOT NULL THEN '固定資産' ELSE '非流動資産' END", "fl": "CASE WHEN fl1 IS NOT NULL THEN '固定負債' ELSE '非流動負債' END", "eq": "CASE WHEN eq1 IS NOT NULL THEN '純資産合計' ELSE '株主資本合計' END",
}
_TREND = ("PL8", "PL9", "PL10", "PL11", "PL16", "PL17", "PL18", "BS5", "BS6", "CF4", "CF5", "CF6", "CF7")
_CHECK = ("PL14", "PL15", "CC1", "CC2", "CC3", "CC4", "XS5", "XS6")


def _question(name: str) -> str:
    parts = string.Formatter().parse(ASKED[name])
    return f"concat({', '.join(x for text, field, *_ in parts for x in ([f"'{text}'"] if text else []) + ([_SAID[field]] if field else []))})"


def _subtask(name: str) -> str:
    return "temporal_reasoning" if name in _TREND else "consistency_checking" if name in _CHECK else "numerical_reasoning"


def _asked(facts, companies, filings):
    return G.questions(S.contexts(facts, companies, filings))


def _template(name: str) -> None:
    guard, (answer, result), steps = FORMULAS[name]

    @query(
        f"g_{name.lower()}",
        f"WITH {CONTEXT}, {_WIDE} SELECT company, y1 AS year, '{_subtask(name)}' AS subtask, {_question(name)} AS question, {answer} AS answer, CAST({steps} AS BIGINT) AS steps, CAST({result} AS DOUBLE) AS result FROM v WHERE kind = '{_KIND[name[:2]]}' AND coalesce({guard}, false)",
        "facts", "companies", "filings",
    )
    def _(facts, companies, filings):
        kind = S.contexts(facts, companies, filings).where(F.col("context_type") == _KIND[name[:2]])
        q = G.questions(kind, (name,)).withColumn("ran", P.execute(F.col("qa.program")))  # the program's own result: a wrong operand shows
        return q.select(F.col("edinet_code").alias("company"), F.col("filing_year").alias("year"), "subtask", "qa.question", "qa.answer", F.size("qa.program").cast("bigint").alias("steps"), F.col("ran.number").alias("result"))


for _t in G.TEMPLATES:
    _template(_t)


_ALL = " UNION ALL ".join(f"SELECT company, '{t}' AS template, {a} AS answer FROM v WHERE kind = '{_KIND[t[:2]]}' AND coalesce({g}, false)" for t, (g, (a, _r), _s) in FORMULAS.items())


@query("u1_all_questions", f"WITH {CONTEXT}, {_WIDE} {_ALL}", "facts", "companies", "filings")
def _(facts, companies, filings):
    return _asked(facts, companies, filings).select(F.col("edinet_code").alias("company"), "template", F.col("qa.answer").alias("answer"))


_WANTED = ("資産合計", "経常利益", "売上高", "純資産合計", "投資活動によるキャッシュ・フロー", "固定負債")


@query("j7_evidence", f"WITH {CONTEXT} SELECT company, kind, coalesce(string_agg(CAST(row_no - 1 AS VARCHAR), ',' ORDER BY row_no) FILTER (WHERE label IN ({', '.join(f"'{w}'" for w in _WANTED)})), '') AS rows FROM ctx GROUP BY company, kind", "facts", "companies", "filings")
def _(facts, companies, filings):
    # with and without a year, twice, out of order, empty and unknown
    labels = F.array(*(F.concat(F.lit(f"{w}_"), "filing_year") for w in _WANTED), *map(F.lit, _WANTED[::-1]), F.lit(""), F.lit("no such label"))
    return _contexts(facts, companies, filings).select(F.col("edinet_code").alias("company"), F.col("context_type").alias("kind"), F.array_join(G.evidence_rows(labels, F.col("table.rows")), ",").alias("rows"))


@query("a8_generation_stats", f"""WITH {CONTEXT}, {_WIDE}, q AS ({_ALL}) SELECT s.subtask, count(q.template) AS n FROM (VALUES ('numerical_reasoning'), ('consistency_checking'), ('temporal_reasoning')) s(subtask)
 LEFT JOIN q ON s.subtask = CASE WHEN template IN {_TREND} THEN 'temporal_reasoning' WHEN template IN {_CHECK} THEN 'consistency_checking' ELSE 'numerical_reasoning' END GROUP BY s.subtask""", "facts", "companies", "filings")
def _(facts, companies, filings):
    return V.generation_stats(_asked(facts, companies, filings))


# validation: every generated question passes or fails as its numbers say; broken ones are made from programs


def _candidates(p):
    k, a = F.col("k"), F.col("a")
    program = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.format_string("oops(%d, 1)", "a"))).when(k == 2, F.array(F.format_string("divide(%d, 0)", "a"))).when(k == 10, F.lit(None).cast("array<string>")).otherwise(F.array(F.format_string("add(%d, 0)", "a"), F.when(k == 5, "greater(#0, 0)").otherwise("multiply(#0, 2)")))
    answer = F.when(k == 3, F.concat((a * 3).cast("string"), F.lit("円"))).when(k == 5, F.when(F.col("b") % 2 == 0, "増収").otherwise("減収")).when(k == 6, " ").when(k == 7, F.concat(F.format_number(a * 2 + F.floor(a / 50), 0), F.lit("百万円"))).otherwise((a * 2).cast("string"))
    return p.select("id", F.when(k == 8, " ").otherwise("What?").alias("question"), answer.alias("answer"), program.alias("program"), F.when(k == 9, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint"))).alias("gold_evidence"))


@query("f5_validate", "SELECT id, CASE k WHEN 0 THEN 'too_few_steps' WHEN 1 THEN 'dsl_error' WHEN 2 THEN 'invalid_result' WHEN 3 THEN 'answer_mismatch' WHEN 5 THEN CASE WHEN b % 2 = 0 THEN '' ELSE 'answer_mismatch' END WHEN 6 THEN 'empty_answer' WHEN 8 THEN 'empty_question' WHEN 9 THEN 'no_gold_evidence' WHEN 10 THEN 'missing_field' ELSE '' END AS reason FROM programs", "programs")
def _(p):
    return V.validate(_candidates(p)).select("id", F.substring_index("reason", ":", 1).alias("reason"))


@query("a5_final_stats", """WITH f AS (SELECT * FROM questions WHERE idx % 5 <> 0), r AS (SELECT concat(CASE idx % 3 WHEN 0 THEN 'dsl_error' ELSE 'answer_mismatch' END, ':x') AS reason FROM questions WHERE idx % 5 = 0)
 SELECT 'total_questions' AS measure, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM f UNION ALL SELECT 'unique_companies', '', CAST(count(DISTINCT edinet_code) AS DOUBLE) FROM f UNION ALL SELECT 'avg_program_steps', '', avg(steps) FROM f UNION ALL SELECT 'total_rejected', '', CAST(count(*) AS DOUBLE) FROM r
 UNION ALL SELECT 'by_subtask', subtask, CAST(count(*) AS DOUBLE) FROM f GROUP BY subtask UNION ALL SELECT 'by_accounting_standard', accounting_standard, CAST(count(*) AS DOUBLE) FROM f GROUP BY accounting_standard UNION ALL SELECT 'rejection_reasons', split_part(reason, ':', 1), CAST(count(*) AS DOUBLE) FROM r GROUP BY 2""", "questions")
def _(q):
    q = _with_program(q)
    reason = F.concat(F.when(F.col("idx") % 3 == 0, "dsl_error").otherwise("answer_mismatch"), F.lit(":x"))
    return V.final_stats(q.where("idx % 5 <> 0"), q.where("idx % 5 = 0").select(reason.alias("reason")))


def _with_program(q):
    return q.withColumn("program", F.array_repeat(F.lit("add(1, 1)"), F.col("steps").cast("int")))


_SET = "list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, CAST(i AS INT), 3)))"
_ALIKE = "len(g) > 0 AND len(list_filter(kept, lambda k: len(k) > 0 AND len(list_intersect(k, g)) > 0.7 * (len(k) + len(g) - len(list_intersect(k, g))))) > 0"


# the greedy rule row by row, each block on its own
@query("w6_dedupe", f"""WITH RECURSIVE n AS (SELECT pos, subtask, edinet_code, lower(replace(trim(question, ' ' || chr(10) || chr(9) || chr(13)), ',', '')) AS s FROM questions), q AS (SELECT pos, subtask, edinet_code, {_SET} AS g, row_number() OVER (PARTITION BY subtask, edinet_code ORDER BY pos) AS rn FROM n),
 r AS (SELECT DISTINCT subtask, edinet_code, 0::BIGINT AS rn, []::VARCHAR[][] AS kept, NULL::BIGINT AS pos FROM q UNION ALL SELECT q.subtask, q.edinet_code, q.rn, CASE WHEN {_ALIKE} THEN kept ELSE list_append(kept, g) END, CASE WHEN {_ALIKE} THEN NULL ELSE q.pos END FROM r JOIN q ON q.subtask = r.subtask AND q.edinet_code = r.edinet_code AND q.rn = r.rn + 1)
 SELECT pos FROM r WHERE pos IS NOT NULL""", "questions")
def _(q):
    return V.dedupe(q).select("pos")


_TARGETS = " UNION ALL ".join(f"SELECT '{s}' AS subtask, '{PREFIXES[s]}' AS prefix, {TARGETS[s]} AS target" for s in TARGETS)
_TOTAL_TARGET = sum(TARGETS.values())
_DIVERSE = f"""WITH t AS ({_TARGETS}), q AS (SELECT questions.*, target, prefix, count(*) OVER (PARTITION BY subtask) AS n, min(pos) OVER (PARTITION BY subtask, edinet_code) AS first FROM questions JOIN t USING (subtask)),
 r AS (SELECT *, row_number() OVER (PARTITION BY subtask, edinet_code ORDER BY CASE WHEN subtask = 'numerical_reasoning' THEN -steps ELSE 0 END, pos) AS turn FROM q), c AS (SELECT * FROM r WHERE n <= target OR turn <= {max(3, int(_TOTAL_TARGET * 0.05))}),
 o AS (SELECT *, row_number() OVER (PARTITION BY subtask ORDER BY CASE WHEN n <= target THEN pos END, turn, first) AS sample_no FROM c)"""


def _sample(q):
    return V.diverse(_with_program(q))


@query("w7_diverse_sample", f"{_DIVERSE} SELECT pos, subtask, CAST(sample_no AS INT) AS sample_no FROM o WHERE n <= target OR sample_no <= target", "questions")
def _(q):
    return _sample(q).select("pos", "subtask", "sample_no")


@query("w8_ids", f"{_DIVERSE} SELECT pos, concat(prefix, '_', CASE WHEN sample_no < 1000 THEN lpad(CAST(sample_no AS VARCHAR), 3, '0') ELSE CAST(sample_no AS VARCHAR) END) AS id FROM o WHERE n <= target OR sample_no <= target", "questions")
def _(q):
    return V.with_ids(_sample(q)).select("pos", "id")


_STRATA = " ".join(f"WHEN subtask = '{a}' AND accounting_standard = '{b}' THEN {{{k}}}" for k, (a, b) in enumerate(V.LITE_TARGETS))
#: The sequential choice, row by row: a stratum's rows in the order of the draw, then all others, with one count a company.
_LITE = f"""WITH RECURSIVE d AS (SELECT *, md5(concat('42:', pos)) AS draw, CASE {_STRATA.format(*range(9))} END AS s, CASE {_STRATA.format(*V.LITE_TARGETS.values())} END AS target FROM questions), o AS (SELECT *, row_number() OVER (ORDER BY s, draw, pos) AS rn FROM d),
 p1 AS (SELECT 0::BIGINT AS rn, -1 AS s, 0 AS n, []::VARCHAR[] AS picked, NULL::BIGINT AS pos UNION ALL
  SELECT rn, s, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN list_append(picked, company) ELSE picked END, CASE WHEN ok THEN pos END FROM (SELECT *, n < target AND len(list_filter(picked, lambda c: c = company)) < {V.LITE_CAP} AS ok
   FROM (SELECT o.rn, o.s, CASE WHEN o.s = p1.s THEN p1.n ELSE 0 END AS n, picked, o.pos, o.target, o.edinet_code AS company FROM p1 JOIN o ON o.rn = p1.rn + 1))),
 q AS (SELECT pos, edinet_code AS company, row_number() OVER (ORDER BY draw, pos) AS rn FROM d WHERE pos NOT IN (SELECT pos FROM p1 WHERE pos IS NOT NULL)),
 p2 AS (SELECT 0::BIGINT AS rn, (SELECT arg_max(picked, rn) FROM p1) AS picked, NULL::BIGINT AS pos UNION ALL
  SELECT rn, CASE WHEN ok THEN list_append(picked, company) ELSE picked END, CASE WHEN ok THEN pos END FROM (SELECT q.rn, q.pos, q.company, picked, len(picked) < {V.LITE_SIZE} AND len(list_filter(picked, lambda c: c = q.company)) < {V.LITE_CAP} AS ok FROM p2 JOIN q ON q.rn = p2.rn + 1)),
 lite AS (SELECT questions.* FROM questions WHERE pos IN (SELECT pos FROM p1 WHERE pos IS NOT NULL UNION ALL SELECT pos FROM p2 WHERE pos IS NOT NULL))"""


def _spread(table: str, top: int) -> str:
    own = " UNION ALL ".join(f"SELECT '{k}' AS measure, {k} AS key, count(*) AS value FROM {table} GROUP BY {k}" for k in ("subtask", "accounting_standard", "filing_year"))
    return f"{own} UNION ALL SELECT 'total', '', count(*) FROM {table} UNION ALL SELECT 'unique_companies', '', count(DISTINCT edinet_code) FROM {table} UNION ALL SELECT 'top_companies', company_name, n FROM (SELECT company_name, count(*) AS n, min(idx) AS first FROM {table} GROUP BY company_name ORDER BY n DESC, first LIMIT {top})"


@query("w9_lite_sample", f"{_LITE} SELECT pos FROM lite", "questions")
def _(q):
    picked = V.lite(q)
    return q.sparkSession.createDataFrame([(p,) for p in picked], "pos bigint")


@query("a7_sample_distribution", f"{_LITE} {_spread('lite', 10)}", "questions")
def _(q):
    picked = q.join(F.broadcast(q.sparkSession.createDataFrame([(p,) for p in V.lite(q)], "pos bigint")), "pos")
    return A.distribution(picked, 10)


@query("t1_t3_first_by_order", "SELECT pos, question FROM questions ORDER BY edinet_code, pos LIMIT 25", "questions")
def _(q):
    return io.first_rows(q, ["edinet_code", "pos"], 25).select("pos", "question")


@query("f1_subtask_filter", "SELECT pos FROM questions WHERE subtask = 'temporal_reasoning'", "questions")
def _(q):
    return io.of_subtask(q, "temporal_reasoning").select("pos")


@query("t2_a6_distribution", _spread("questions", 15), "questions")
def _(q):
    return A.distribution(q)


# audits


@query("w10_q10_exact_duplicates", "WITH q AS (SELECT idx, trim(question, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM questions) SELECT first_index, idx AS duplicate_index FROM (SELECT idx, t, min(idx) OVER (PARTITION BY t) AS first_index FROM q WHERE t <> '') WHERE idx > first_index", "questions")
def _(q):
    return A.exact_duplicates(q)


@query("j8_q11_near_duplicates", None, "questions")
def _(q):
    return A.near_duplicates(q)


_PIV = ", ".join(f"max(CASE WHEN label = '{v}' THEN value END) AS \"{v}\"" for v in A.LABELS)
_S = {k: f'"{v}"' for k, v in (("sales", A.SALES), ("cost", A.COST), ("gross", A.GROSS), ("exp", A.EXPENSES), ("op", A.OPERATING), ("net", A.NET), ("par", A.PARENT), ("min", A.MINORITY), ("ca", A.CURRENT), ("fa", A.FIXED), ("ta", A.ASSETS), ("cl", A.DEBT), ("fl", A.LONG_DEBT), ("eq", A.EQUITY))}


def _far(a: str, b: str, tol: float) -> str:
    return f"NOT (({a}) = ({b}) OR CASE WHEN ({b}) = 0 THEN abs({a}) <= 0.5 ELSE abs(({a}) - ({b})) / abs({b}) <= {tol} OR abs(({a}) - ({b})) <= 0.5 END)"


_RULES = {
    "q1_impossible_cogs": "{cost} > {sales} * 1.001", "q2_gross_profit_mismatch": _far("{gross}", "{sales} - {cost}", 0.02), "q3_op_income_mismatch": _far("{op}", "{gross} - {exp}", 0.02), "q4_ni_decomposition_mismatch": _far("{net}", "{par} + {min}", 0.01), "q5_asset_total_mismatch": _far("{ta}", "{ca} + {fa}", 0.01),
    "q6_balance_sheet_mismatch": _far("{ta}", "{cl} + {fl} + {eq}", 0.01), "q7_roe_convention_ambiguity": "CAST(id AS BIGINT) % 3 = 0 AND {net} IS NOT NULL AND {par} IS NOT NULL",
}
_FACTS = f"p AS (SELECT company AS id, year, {_PIV} FROM facts GROUP BY company, year)"


def _audited(f):
    values = [F.max(F.when(F.col("label") == v, F.col("value"))).alias(v) for v in A.LABELS]
    wide = f.groupBy(F.col("company").alias("c"), "year").agg(*values)
    wide = wide.withColumn("id", F.concat("c", F.lit("-"), "year")).withColumn("question", F.when(F.col("c").cast("bigint") % 3 == 0, "What is the ROE?").otherwise("How much?"))
    return A.identity_findings(wide)


def _rule(name: str, test: str) -> None:
    @query(name, f"WITH {_FACTS} SELECT concat(id, '-', year) AS id FROM p WHERE coalesce({test.format(**_S)}, false)", "facts")
    def _(f):
        return _audited(f).where(F.col("finding") == name[3:]).select("id")


for _n, _test in _RULES.items():
    _rule(_n, _test)


@query("a11_finding_counts", f"WITH {_FACTS}, f AS ({' UNION ALL '.join(f'''SELECT concat(id, '-', year) AS id, '{n[3:]}' AS finding FROM p WHERE coalesce({t.format(**_S)}, false)''' for n, t in _RULES.items())}) SELECT finding, count(*) AS n FROM f GROUP BY finding UNION ALL SELECT 'affected ids', count(DISTINCT id) FROM f", "facts")
def _(f):
    return A.counts(_audited(f))


#: The sides of the last comparison as the interpreter has them; as it is stated, the rule finds nothing, since sides within
#: 0.0015 of each other are within half a unit too.
_SIDES = "SELECT id, (a % 1000)::DOUBLE + b * 0.0001::DOUBLE AS x, (a % 1000)::DOUBLE AS y FROM programs"


@query("q8_rounding_pedantry", f"SELECT CAST(id AS VARCHAR) AS id, abs(x - y) < 0.0015 AS close, abs(x - y) < 0.0015 AND NOT (x = y OR abs(x - y) <= 0.5) AS finding FROM ({_SIDES})", "programs")
def _(p):
    made = F.array(F.format_string("multiply(%d, 0.0001)", "b"), F.format_string("add(%d, #0)", (F.col("a") % 1000)), F.format_string("add(%d, 0)", (F.col("a") % 1000)), F.lit("eq(#1, #2)"))
    rows = p.select(F.col("id").cast("string").alias("id"), made.alias("program"))
    found = A.rounding_findings(rows).select("id", F.lit(True).alias("finding"))
    close = rows.select("id", P.last_pair(F.col("program")).alias("x")).select("id", (F.abs(F.col("x.a") - F.col("x.b")) < 0.0015).alias("close"))
    return close.join(found, "id", "left").select("id", "close", F.coalesce("finding", F.lit(False)).alias("finding"))


#: Every word of the audit's lists.
_TOLD = (*N.AUDIT_TRUE, *N.AUDIT_FALSE)


@query("q9_program_findings", f"SELECT id AS idx, CASE k % 4 WHEN 0 THEN 'dsl_unparsable' ELSE 'dsl_mismatch' END AS finding FROM programs WHERE k % 4 = 0 OR (k % 4 = 1 AND b % 2 = 0) OR (k % 4 = 2 AND b % {len(_TOLD)} >= {len(N.AUDIT_TRUE)})", "programs")
def _(p):
    k, odd = F.col("k") % 4, F.col("b") % 2 == 0
    program = F.when(k == 0, F.array(F.lit("nope"))).when(k == 1, F.array(F.format_string("add(%d, 0)", "a"))).when(k == 2, F.array(F.format_string("greater(%d, 0)", "a"))).otherwise(F.array(F.format_string("divide(%d, 3)", "a")))
    answer = F.when(k == 1, F.when(odd, F.format_number(F.col("a") * 2, 0)).otherwise(F.concat(F.format_number("a", 0), F.lit("百万円")))).when(k == 2, F.element_at(F.array(*map(F.lit, _TOLD)), (F.col("b") % len(_TOLD) + 1).cast("int"))).otherwise(F.concat(F.format_number(F.col("a") / 3, 1), F.lit("%")))
    return A.program_findings(p.select(F.col("id").alias("idx"), program.alias("program"), answer.alias("answer")))


@query("f6_schema_audit", "SELECT id, CASE k % 3 WHEN 0 THEN 'scale_missing' WHEN 1 THEN 'source_doc_id,qa.answer' ELSE 'qa.question,qa.answer,qa.program' END AS missing FROM programs WHERE k % 3 > 0", "programs")
def _(p):
    from ledgerlark.operators.audit import REQUIRED, REQUIRED_QA

    def json(top, qa):
        return "{" + ", ".join(f'"{k}": null' for k in top) + (', "qa": {' + ", ".join(f'"{k}": 1' for k in qa) + "}" if qa is not None else ', "qa": {}') + "}"

    rest = [k for k in REQUIRED if k != "qa"]
    made = F.when(F.col("k") % 3 == 0, json(rest, REQUIRED_QA)).when(F.col("k") % 3 == 1, json([k for k in rest if k != "source_doc_id"], ["question", "program"])).otherwise(json(rest, None))
    return p.select("id", A.missing_fields(made).alias("m")).where(F.size("m") > 0).select("id", F.array_join("m", ",").alias("missing"))


@query("f7_integrity", """WITH f AS (SELECT concat('E', company) AS stem, year, CASE WHEN CAST(company AS BIGINT) % 7 = 0 THEN 'E0' ELSE concat('E', company) END AS code, CASE WHEN CAST(year AS BIGINT) % 4 = 0 THEN '130' WHEN CAST(year AS BIGINT) % 4 = 1 THEN '' ELSE '120' END AS kind, CASE WHEN CAST(company AS BIGINT) % 5 = 0 THEN '' ELSE 'x' END AS name FROM filings)
 SELECT stem AS file, NULL AS year, 'company_code_mismatch' AS issue FROM f WHERE stem = 'E3' GROUP BY stem UNION ALL SELECT stem, year, 'filing_code_mismatch' FROM f WHERE code <> stem UNION ALL SELECT stem, year, 'non_annual_doc_type' FROM f WHERE kind = '130' UNION ALL SELECT stem, year, 'missing_company_name' FROM f WHERE name = ''""", "filings")
def _(f):
    c, y = F.col("company").cast("bigint"), F.col("year").cast("bigint")
    stem = F.concat(F.lit("E"), "company")
    rows = f.select(stem.alias("file_stem"), "year", F.when(c % 7 == 0, "E0").otherwise(stem).alias("edinet_code"), F.when(y % 4 == 0, "130").when(y % 4 == 1, "").otherwise("120").alias("doc_type"), F.when(c % 5 == 0, "").otherwise("x").alias("company_name"))
    companies = rows.select("file_stem").distinct().withColumn("edinet_code", F.when(F.col("file_stem") != "E3", F.col("file_stem")))
    return A.integrity(rows, companies)


@query("a10_first_label_wins", "SELECT id, a::DOUBLE AS r, b::DOUBLE AS s FROM programs", "programs")
def _(p):
    rows = F.array(F.array(F.lit(" r "), F.format_number("a", 0)), F.array(F.lit("r"), F.lit("1")), F.array(F.lit("s"), F.lit("n/a")), F.array(F.lit("s"), F.concat(F.col("b").cast("string"), F.lit("百万円"))))
    m = A.label_values(rows)
    return p.select("id", m.alias("m")).select("id", F.try_element_at("m", F.lit("r")).alias("r"), F.try_element_at("m", F.lit("s")).alias("s"))


@query("w5_required_labels", f"WITH {LINES}, need AS ({_need('income_statement', S.REQUIRED_INCOME)} UNION ALL {_need('balance_sheet', S.REQUIRED_BALANCE)}) SELECT company, statement, label, CAST(rk AS BIGINT) AS place FROM need WHERE rk <= 7", "facts", "filings")
def _(facts, filings):
    lines, out = S.company_lines(facts, filings), None
    for statement, wanted in (("income_statement", S.REQUIRED_INCOME), ("balance_sheet", S.REQUIRED_BALANCE)):
        own = lines.select("company", F.posexplode(S.with_required(F.col(statement), wanted)).alias("i", "x")).select("company", F.lit(statement).alias("statement"), "x.label", (F.col("i") + 1).cast("bigint").alias("place"))
        out = own if out is None else out.unionByName(own)
    return out


@query("w4_head_of_context", f"WITH {LINES} SELECT company, statement, label FROM two WHERE rk <= CASE statement {' '.join(f"WHEN '{s}' THEN {n}" for s, n in S.MOST.items())} END", "facts", "filings")
def _(facts, filings):
    # one pass over the companies, whatever the statement
    def head(statement, most):
        return F.transform(S.head_of(F.col(statement), most), lambda x: F.struct(F.lit(statement).alias("statement"), x["label"].alias("label")))

    heads = [head(*kind) for kind in S.MOST.items()]
    return S.company_lines(facts, filings).select("company", F.explode(F.concat(*heads)).alias("x")).select("company", "x.*")


@query("p11_inspect", f"""SELECT CAST(pos AS VARCHAR) AS id, concat(repeat('=', 60), chr(10), 'ID: ', pos, '  |  Subtask: ', subtask, chr(10), 'Question: ', question, chr(10), 'Answer: ', answer, chr(10), CASE WHEN steps > 1 THEN concat('Program: add(1, 1)', repeat(' → add(1, 1)', steps - 2), chr(10)) ELSE '' END,
 'Table: 1 rows x ', steps, ' cols', chr(10), CASE WHEN coalesce(edinet_code, '') <> '' THEN concat('Source: ', edinet_code, ' (', filing_year, ')', chr(10)) ELSE '' END) AS shown FROM questions ORDER BY pos LIMIT 5""", "questions")
def _(q):
    from ledgerlark import cli

    names = F.array_repeat(F.lit("x"), F.col("steps").cast("int"))
    program = F.array_repeat(F.lit("add(1, 1)"), (F.col("steps") - 1).cast("int"))
    nested = q.select("pos", F.col("pos").cast("string").alias("id"), "subtask", F.struct("question", program.alias("program"), "answer").alias("qa"), F.struct(names.alias("headers"), F.array(names).alias("rows")).alias("table"), "edinet_code", "filing_year")
    return cli.shown(io.first_rows(nested, ["pos"], 5)).select("id", F.array_join("lines", "\n").alias("shown"))
