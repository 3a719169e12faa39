"""Raw filings to line items, line items to table contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import numbers as N
from ledgerlark.functions.render import fill
from ledgerlark.schema import CURRENT, element_dim

# Texts before and after each kind of table.
BEFORE = {
    "pl_comparison": "以下は{company_name}の{period}連結損益計算書の抜粋である。", "bs_summary": "以下は{company_name}の{period}連結貸借対照表の要約である。", "cf_summary": "以下は{company_name}の{period}連結キャッシュ・フロー計算書の概要である。",
    "cross_statement": "{company_name}({gaap}適用)の{period}における損益計算書および貸借対照表の主要項目を以下に示す。", "bs_consistency": "以下は{company_name}の{period}連結貸借対照表である。",
}
AFTER = {
    "pl_comparison": "当期は前期比で{revenue_direction}となった。", "bs_summary": "総資産は前期比{asset_direction}。", "cf_summary": "フリーキャッシュフローは{fcf_sign}であった。", "cross_statement": "同社は資本効率の改善に取り組んでいる。", "bs_consistency": "なお、金額は{scale}単位で表示している。",
}
# Lines that a table of two statements shows first, in this order.
REQUIRED_INCOME = ("売上高", "売上収益", "営業利益", "当期純利益", "親会社株主に帰属する当期純利益", "経常利益")
REQUIRED_BALANCE = ("資産合計", "純資産合計", "株主資本合計", "負債合計")
# Lines of a table, at most, by statement.
MOST = {"income_statement": 16, "balance_sheet": 18, "cash_flow_statement": 10}
OPERATING, INVESTING = "営業活動によるキャッシュ・フロー", "投資活動によるキャッシュ・フロー"

KEYS = ("company", "year", "statement")


def is_current(context: Column) -> Column:
    """The consolidated current period: neither a prior year nor a breakdown by member."""
    return F.coalesce(context.isin(*CURRENT), F.lit(False))


def first_items(raw: DataFrame, value: str = "value") -> DataFrame:
    """``company, year, statement, pos, label, value`` of labelled rows: the first one with a number for each label."""
    rows = raw.where(F.col(value).isNotNull() & (F.col("label") != ""))
    best = F.min(F.struct("pos", F.col(value).alias("value"))).alias("x")
    return rows.groupBy(*KEYS, "label").agg(best).select(*KEYS, "x.pos", "label", "x.value")


def numeric_items(raw: DataFrame) -> DataFrame:
    """Items of a named element that have a number."""
    return raw.where(F.col("value").isNotNull() & (F.col("element") != ""))


def any_labels(spark) -> DataFrame:
    """``element, any_label``: an element's label over all statements, a later statement's where two have it; some 130 rows."""
    later = F.when(F.col("statement") == "cash_flow_statement", 3).when(F.col("statement") == "balance_sheet", 2).otherwise(1)
    return element_dim(spark).groupBy("element").agg(F.max_by("label", later).alias("any_label"))


def with_labels(raw: DataFrame) -> DataFrame:
    """Items with ``any_label``, null where the element is unknown."""
    return raw.join(F.broadcast(any_labels(raw.sparkSession)), "element", "left")


def with_prior_year(items: DataFrame) -> DataFrame:
    """Items ``(company, label, year, value)`` that have one of the year before, with its value as ``prev``."""
    before = items.select("company", "label", (F.col("year").cast("int") + 1).cast("string").alias("year"), F.col("value").alias("prev"))
    return items.join(before, ["company", "label", "year"])


def head_of(items: Column, most: int) -> Column:
    """The first lines that both years have."""
    return F.slice(F.filter(items, lambda i: i["prev"].isNotNull()), 1, most)


def element_items(raw: DataFrame) -> DataFrame:
    """The same from rows ``(company, year, statement, pos, element, context, value)`` of named elements.

    Elements with a display rank come first, each label once with the value that came last; then others with a known label
    in raw order, with the value that came first.
    """
    dim = element_dim(raw.sparkSession)
    shown = F.broadcast(dim.where("rank IS NOT NULL").select("statement", "element", "label", "rank"))
    rows = numeric_items(raw).where(is_current(F.col("context")))
    own = rows.groupBy(*KEYS, "element").agg(F.max_by("value", "pos").alias("last"), F.min_by("value", "pos").alias("first"), F.min("pos").alias("at"))
    known = with_labels(own.join(shown, ["statement", "element"], "left"))
    ranked = F.when(F.col("rank").isNotNull(), F.struct(F.col("label").alias("label"), F.col("rank").cast("bigint").alias("pos"), F.col("last").alias("value")))
    other = F.when(F.col("any_label").isNotNull(), F.struct(F.col("any_label").alias("label"), (F.col("at") + 1_000_000).alias("pos"), F.col("first").alias("value")))
    both = known.select(*KEYS, F.explode(F.filter(F.array(ranked, other), lambda x: x.isNotNull())).alias("x")).select(*KEYS, "x.*")
    return both.groupBy(*KEYS, "label").agg(F.min(F.struct("pos", "value")).alias("x")).select(*KEYS, "x.pos", "label", "x.value")


def labelled_items(raw: DataFrame) -> DataFrame:
    """Labelled items of both raw shapes: the newer one names labels, the older one elements (``newer`` tells)."""
    return first_items(raw.where("newer")).unionByName(element_items(raw.where("not newer")))


def scale_of(values: Column) -> Column:
    """``struct(label, divisor)`` for an array of values by its largest magnitude."""
    top = F.array_max(F.transform(values, F.abs))
    def pair(label, divisor):
        return F.struct(F.lit(label).alias("label"), F.lit(float(divisor)).alias("divisor"))

    return F.when(top >= 1e8, pair("百万円", 1e6)).when(top >= 1e6, pair("千円", 1e3)).otherwise(pair("円", 1))


def scale_by_group(value: Column) -> Column:
    """As ``scale_of`` for an aggregate over rows."""
    top = F.max(F.abs(value))
    return F.when(top >= 1e8, "百万円").when(top >= 1e6, "千円").otherwise("円")


def with_required(items: Column, required: tuple[str, ...], most: int = 7) -> Column:
    """The first four items, then the required ones in their order, then the rest, cut to ``most``."""
    head = F.slice(items, 1, 4)

    def only(label):
        return F.filter(items, lambda x: (x["label"] == label) & ~F.exists(head, lambda h: h["label"] == label))

    wanted = F.flatten(F.array(*map(only, required)))
    chosen = F.concat(head, wanted)
    rest = F.filter(items, lambda x: ~F.exists(chosen, lambda c: c["label"] == x["label"]))
    return F.slice(F.concat(chosen, rest), 1, most)


def _values(items: Column, *fields: str) -> Column:
    def of(field):
        return F.transform(items, lambda x: x[field])

    return F.flatten(F.array(*map(of, fields)))


def _value(items: Column, label: str, field: str) -> Column:
    return F.get(F.transform(F.filter(items, lambda x: x["label"] == label), lambda x: x[field]), F.lit(0))


def _rows(items: Column, divisor: Column, *fields: str) -> Column:
    return F.transform(items, lambda x: F.array(x["label"], *(N.cell(x[f], divisor) for f in fields)))


def _raw(items: Column, divisor: Column, **years: Column) -> Column:
    """Map from ``label_year`` to scaled value."""
    def of(field, year):
        return F.transform(items, lambda x: F.struct(F.concat(x["label"], F.lit("_"), year).alias("k"), (x[field] / divisor).alias("v")))

    return F.map_from_entries(F.flatten(F.array(*(of(f, y) for f, y in years.items()))))


def company_lines(items: DataFrame, filings: DataFrame) -> DataFrame:
    """One row a company: its two latest years, the latest filing's id, and each statement's lines of the latest year.

    Lines are ``struct(pos, label, cur, prev)`` in order; a company has a few hundred at most. Everything is keyed by the
    company, so that rows move once.
    """
    years = filings.groupBy("company").agg(F.sort_array(F.collect_set("year"), asc=False).alias("years"), F.max_by("doc_id", "year").alias("doc_id"))
    years = years.select("company", F.get("years", F.lit(0)).alias("y1"), F.get("years", F.lit(1)).alias("y2"), "doc_id")
    rows = items.join(years.select(F.col("company").alias("c"), "y1", "y2"), F.col("company") == F.col("c")).where((F.col("year") == F.col("y1")) | (F.col("year") == F.col("y2")))
    now = F.col("year") == F.col("y1")
    lines = rows.groupBy("company", "statement", "label").agg(F.min(F.when(now, F.col("pos"))).alias("pos"), F.min_by(F.when(now, F.col("value")), F.when(now, F.col("pos"))).alias("cur"), F.min_by(F.when(~now, F.col("value")), F.when(~now, F.col("pos"))).alias("prev"))
    line = F.struct("pos", "label", "cur", "prev")
    of = {s: F.array_sort(F.collect_list(F.when(F.col("statement") == s, line))).alias(s) for s in ("income_statement", "balance_sheet", "cash_flow_statement")}
    grouped = lines.where("cur IS NOT NULL").groupBy("company").agg(*of.values())
    return grouped.join(years, "company")


def contexts(items: DataFrame, companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Table contexts of every company, up to five each, in the order ``pos``.

    ``items``: company, year, statement, pos, label, value (one row a label); ``companies``: edinet_code, name, gaap;
    ``filings``: company, year, doc_id. A company without enough lines for a kind of table has none of that kind.
    """
    base = company_lines(items, filings).join(companies, F.col("company") == F.col("edinet_code"))

    def both(name):
        return F.filter(name, lambda i: i["prev"].isNotNull())

    # in steps, so that each list, scale and text is a column that is computed once
    base = base.withColumns({"pl2": both("income_statement"), "bs2": both("balance_sheet"), "cf2": both("cash_flow_statement")})
    base = base.withColumns({
        "l_pl": head_of(F.col("income_statement"), MOST["income_statement"]), "l_bs2": head_of(F.col("balance_sheet"), MOST["balance_sheet"]), "l_bs": F.slice("balance_sheet", 1, MOST["balance_sheet"]), "l_cf": head_of(F.col("cash_flow_statement"), MOST["cash_flow_statement"]),
        "l_x": F.concat(with_required(F.col("income_statement"), REQUIRED_INCOME), with_required(F.col("balance_sheet"), REQUIRED_BALANCE)),
        "free": _value(F.col("cash_flow_statement"), OPERATING, "cur") + _value(F.col("cash_flow_statement"), INVESTING, "cur"), "total": _value(F.col("balance_sheet"), "資産合計", "cur"), "total_p": _value(F.col("balance_sheet"), "資産合計", "prev"),
    })
    base = base.withColumns({f"s_{k}": scale_of(_values(F.col(f"l_{k}"), *f)) for k, f in (("pl", ("cur", "prev")), ("bs2", ("cur", "prev")), ("bs", ("cur",)), ("cf", ("cur", "prev")), ("x", ("cur",)))})
    base = base.withColumn("sales", F.get(F.filter("l_pl", lambda x: F.contains(x["label"], F.lit("売上"))), F.lit(0)))
    pl, bs, cf, y1, y2 = (F.col(c) for c in ("income_statement", "balance_sheet", "cash_flow_statement", "y1", "y2"))
    p1, p2 = N.period(y1), N.period(y2)
    names = {"company_name": F.col("name"), "period": p1, "gaap": F.coalesce("gaap", F.lit(""))}

    def ctx(kind, key, headers, fields, years, **after):
        items, scale = F.col(f"l_{key}"), F.col(f"s_{key}")
        return F.struct(
            F.lit(kind).alias("context_type"), F.array(fill(BEFORE[kind], **names)).alias("pre_text"), F.array(fill(AFTER[kind], **after, **({"scale": scale["label"]} if kind == "bs_consistency" else {}))).alias("post_text"),
            F.struct(headers(scale["label"]).alias("headers"), _rows(items, scale["divisor"], *fields).alias("rows")).alias("table"), _raw(items, scale["divisor"], **years).alias("raw_values"), scale["label"].alias("scale"),
        )

    def two(_):
        return F.array(F.lit(""), p1, p2)

    def one(label):
        return F.array(F.lit(""), F.concat(F.lit("金額("), label, F.lit(")")))

    def named(label):
        return F.array(F.lit("項目"), F.concat(F.lit("金額("), label, F.lit(")")))

    now, pair, sales, free = {"cur": y1}, {"cur": y1, "prev": y2}, F.col("sales"), F.col("free")
    grown = F.when(sales.isNull() | (sales["cur"] > sales["prev"]), "増収").otherwise("減収")
    comparison = F.when((F.size(pl) >= 3) & (F.size("pl2") >= 3), ctx("pl_comparison", "pl", two, ("cur", "prev"), pair, revenue_direction=grown))
    summary2 = ctx("bs_summary", "bs2", two, ("cur", "prev"), pair, asset_direction=N.direction(F.col("total"), F.col("total_p")))
    summary1 = ctx("bs_summary", "bs", one, ("cur",), now, asset_direction=F.lit("であった"))
    summary = F.when((F.size(bs) >= 4) & y2.isNotNull(), F.when(F.size("bs2") >= 4, summary2).otherwise(summary1))
    consistency = F.when((F.size(bs) >= 4) & F.exists(bs, lambda x: F.contains(x["label"], F.lit("合計"))), ctx("bs_consistency", "bs", one, ("cur",), now))
    sign = F.when(free.isNull() | (free > 0), "プラス").otherwise("マイナス")
    cash = F.when((F.size(cf) >= 3) & (F.size("cf2") >= 3), ctx("cf_summary", "cf", two, ("cur", "prev"), pair, fcf_sign=sign))
    cross = F.when((F.size(pl) >= 2) & (F.size(bs) >= 2), ctx("cross_statement", "x", named, ("cur",), now))
    made = base.select(
        F.col("name").alias("company_name"), "edinet_code", F.coalesce("doc_id", F.lit("")).alias("source_doc_id"), y1.alias("filing_year"), F.coalesce("gaap", F.lit("J-GAAP")).alias("accounting_standard"),
        F.posexplode(F.array(comparison, summary, consistency, cash, cross)).alias("pos", "x"),
    )
    return made.where("x IS NOT NULL").select("company_name", "edinet_code", "source_doc_id", "filing_year", "accounting_standard", "pos", "x.*")


def common_labels(items: DataFrame, filings: DataFrame) -> DataFrame:
    """Lines that both of a company's latest years have, in the latest one's order."""
    lines = company_lines(items, filings)
    def of(s):
        return F.transform(F.col(s), lambda x: F.struct(F.lit(s).alias("statement"), x["pos"].alias("pos"), x["label"].alias("label"), x["cur"].alias("cur"), x["prev"].alias("prev")))

    all_lines = F.concat(*map(of, ("income_statement", "balance_sheet", "cash_flow_statement")))
    return lines.select("company", "y1", "y2", F.explode(F.filter(all_lines, lambda x: x["prev"].isNotNull())).alias("x")).select("company", "y1", "y2", "x.*")


def search_windows(spark) -> DataFrame:
    """``group, window, from_month, from_day, to_month, to_day``: the windows in which annual filings are looked for, in order, of the one group ''."""
    from ledgerlark.schema import WINDOWS

    return spark.createDataFrame([("", k, *w) for k, w in enumerate(WINDOWS)], "group string, window int, from_month int, from_day int, to_month int, to_day int")


def pick_filings(filings: DataFrame, wanted: DataFrame, windows: DataFrame | None = None, bucket_days: int = 32) -> DataFrame:
    """The filing of each wanted ``(company, year)``: from the first window that has one with data, the newest (ties: largest id).

    ``filings``: company, doc_id, filing_date, has_xbrl. ``windows``: as ``search_windows``, which is the default; ``wanted`` may have a
    ``group`` whose windows count (null or none: ''). A window that ends before it begins ends in the next year. An interval
    join by equal keys: a window becomes the runs of ``bucket_days`` days that it touches, a filing lies in one, and only those of
    one company and run are compared.
    """
    windows = search_windows(filings.sparkSession) if windows is None else windows
    group = F.coalesce("group", F.lit("")) if "group" in wanted.columns else F.lit("")
    asked = wanted.select("company", "year", group.alias("group"), F.col("year").cast("int").alias("_y")).distinct().join(windows, "group")
    low = F.make_date("_y", "from_month", "from_day")
    high = F.make_date("_y", "to_month", "to_day")
    asked = asked.select("company", "year", "_y", "window", low.alias("lo"), F.when(high < low, F.make_date(F.col("_y") + 1, "to_month", "to_day")).otherwise(high).alias("hi"))

    def run_of(day):
        return F.floor(F.unix_date(day) / bucket_days).cast("int")

    asked = asked.withColumn("_run", F.explode(F.sequence(run_of(F.col("lo")), run_of(F.col("hi")))))
    own = filings.where("has_xbrl").select("company", "doc_id", "filing_date", run_of(F.col("filing_date")).alias("_run"))
    rows = own.join(asked, ["company", "_run"]).where(F.col("filing_date").between(F.col("lo"), F.col("hi")))
    best = F.max(F.struct((-F.col("window")).alias("w"), "filing_date", "doc_id")).alias("x")
    return rows.groupBy("company", "year").agg(best).select("company", "year", (-F.col("x.w")).alias("window"), "x.filing_date", "x.doc_id")


def not_collected(wanted: DataFrame, stored: DataFrame, key: str = "company") -> DataFrame:
    """What has still to be fetched: a stored result is never fetched again."""
    return wanted.join(stored.select(key).distinct(), key, "left_anti")
