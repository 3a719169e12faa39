"""Questions from contexts: 45 metrics, each with its program, answer and evidence, as expressions on a context's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import numbers as N
from ledgerlark.scratch import store

NUMERIC, CHECK, TREND = "numerical_reasoning", "consistency_checking", "temporal_reasoning"
OPERATING, INVESTING, FINANCING = "営業活動によるキャッシュ・フロー", "投資活動によるキャッシュ・フロー", "財務活動によるキャッシュ・フロー"
OWNERS = "親会社株主に帰属する当期純利益"


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _step(name: str, *arguments: Column | str) -> Column:
    """One program step; doubles are written as literals, text (``#0``, ``100``) as it is."""
    out: list[Column | str] = [f"{name}("]
    for k, a in enumerate(arguments):
        out += [", "] if k else []
        out.append(a if isinstance(a, str) else N.literal(a))
    return _cat(*out, ")")


# Labels, question wordings and answers of the metrics below.


class Context:
    """Values of a context row. Lookups and everything made of them are columns of their own, added in levels by ``stage``,
    so that the metrics' expressions stay small."""

    def __init__(self):
        self.company, self.year, self.scale = F.col("company_name"), F.col("filing_year"), F.col("scale")
        self.last = F.col("q_last")
        self.period, self.period_last = N.period(self.year), N.period(self.last)
        self.levels: list[dict[str, Column]] = [{"q_last": (self.year.cast("int") - 1).cast("string")}, {}, {}, {}]

    def let(self, level: int, name: str, value: Column) -> Column:
        self.levels[level][f"q_{name}"] = value
        return F.col(f"`q_{name}`")

    def _value(self, label: str, year: Column, side: str) -> Column:
        return self.let(1, f"{side}_{label}", F.try_element_at(F.col("raw_values"), F.concat(F.lit(f"{label}_"), year)))

    def cur(self, label: str) -> Column:
        """The filing year's value."""
        return self._value(label, self.year, "c")

    def prev(self, label: str) -> Column:
        """The value of the year before."""
        return self._value(label, self.last, "p")

    def first_of(self, name: str, *labels: str) -> tuple[Column, Column, Column]:
        """The first of the labels that the filing year has, its value and its value the year before; nulls without any."""
        label = F.coalesce(*(F.when(self.cur(x).isNotNull(), x) for x in labels))
        return self.let(2, f"{name}_label", label), self.let(2, name, F.coalesce(*map(self.cur, labels))), self.let(2, f"{name}_last", F.coalesce(*(F.when(self.cur(x).isNotNull(), F.struct(self.prev(x).alias("v"))) for x in labels))["v"])

    def named(self, *labels: Column | str, both: bool = False) -> list[Column]:
        """Evidence of the filing year, then of the year before."""
        return [_cat(x, "_", y) for y in ([self.year, self.last] if both else [self.year]) for x in labels]

    def stage(self, rows: DataFrame) -> DataFrame:
        for level in self.levels:
            rows = rows.withColumns(level) if level else rows
        return rows


def metric(name: str, guard: Column, subtask: str, question: Column, answer: Column, program: list[Column], evidence: list) -> Column:
    """A question as a struct, or null where the guard doesn't hold."""
    wanted = F.array(*(F.lit(e) if isinstance(e, str) else e for e in evidence))
    return F.when(F.coalesce(guard, F.lit(False)), F.struct(F.lit(name).alias("template"), F.lit(subtask).alias("subtask"), question.alias("question"), answer.alias("answer"), F.array(*program).alias("program"), wanted.alias("labels")))


def either(test: Column, yes: str, no: str) -> Column:
    return F.when(test, yes).otherwise(no)


def income(c: Context) -> list[Column]:
    rev_l, rev, rev_p = c.first_of("sales", "売上高", "売上収益")
    ni_l, ni, ni_p = c.first_of("net", "当期純利益", OWNERS)
    op, op_p, ordinary, ordinary_p = c.cur("営業利益"), c.prev("営業利益"), c.cur("経常利益"), c.prev("経常利益")
    gross, gross_p, sga, cogs = c.cur("売上総利益"), c.prev("売上総利益"), c.cur("販売費及び一般管理費"), c.cur("売上原価")
    who, now, span = c.company, c.period, (c.period_last, "から", c.period, "にかけて")

    def share(name, part, label, text):
        return metric(name, (rev != 0) & part.isNotNull(), NUMERIC, _cat(who, "の", now, text), N.percent(part / rev * 100), [_step("divide", part, rev), _step("multiply", "#0", "100")], c.named(label, rev_l))

    def trend(name, a, b, label, text, yes="増益", no="減益"):
        return metric(name, a.isNotNull() & b.isNotNull(), TREND, _cat(who, "は", *span, text), either(a - b > 0, yes, no), [_step("subtract", a, b), _step("greater", "#0", "0")], c.named(label, both=True))

    def ratio(name, a, b, label, text):
        evidence = [_cat(label, "_", c.year), _cat(rev_l, "_", c.year), _cat(label, "_", c.last), _cat(rev_l, "_", c.last)]
        return metric(name, (rev != 0) & (rev_p != 0) & a.isNotNull() & b.isNotNull(), TREND, _cat(who, text, *span, "改善したか悪化したか。"), either(a / rev - b / rev_p > 0, "改善", "悪化"), [_step("divide", a, rev), _step("divide", b, rev_p), _step("subtract", "#0", "#1"), _step("greater", "#2", "0")], evidence)

    margin_change = ordinary / rev * 100 - ordinary_p / rev_p * 100
    return [
        metric("PL1", rev_p != 0, NUMERIC, _cat(who, "の", now, "の", rev_l, "は前期比で何%増減したか。"), N.percent((rev - rev_p) / rev_p * 100), [_step("subtract", rev, rev_p), _step("divide", "#0", rev_p), _step("multiply", "#1", "100")], c.named(rev_l, both=True)),
        share("PL2", op, "営業利益", "の営業利益率は何%か。"),
        metric("PL3", rev.isNotNull() & rev_p.isNotNull(), NUMERIC, _cat(who, "の", rev_l, "は", *span, "いくら", either(rev > rev_p, "増加", "減少"), "したか。"), N.money(F.abs(rev - rev_p), c.scale), [_step("subtract", rev, rev_p), _step("abs", "#0")], c.named(rev_l, both=True)),
        share("PL4", gross, "売上総利益", "の売上総利益率は何%か。"),
        metric("PL5", (op_p > 0) & (op > 0), NUMERIC, _cat(who, "の", now, "の営業利益は前期比で何%変化したか。"), N.percent((op - op_p) / op_p * 100), [_step("subtract", op, op_p), _step("divide", "#0", op_p), _step("multiply", "#1", "100")], c.named("営業利益", both=True)),
        share("PL6", sga, "販売費及び一般管理費", "の売上高販管費率は何%か。"),
        metric("PL7", (rev != 0) & (rev_p != 0) & ordinary.isNotNull() & ordinary_p.isNotNull(), NUMERIC, _cat(who, "の経常利益率は", *span, "何ポイント変化したか。"), N.points(margin_change), [_step("divide", ordinary, rev), _step("multiply", "#0", "100"), _step("divide", ordinary_p, rev_p), _step("multiply", "#2", "100"), _step("subtract", "#1", "#3")], [*c.named("経常利益", rev_l, both=True)]),
        trend("PL8", rev, rev_p, rev_l, "増収か減収か。", "増収", "減収"),
        trend("PL9", op, op_p, "営業利益", "営業利益ベースで増益か減益か。"),
        ratio("PL10", op, op_p, "営業利益", "の営業利益率は"),
        trend("PL11", ordinary, ordinary_p, "経常利益", "経常利益ベースで増益か減益か。"),
        share("PL12", ni, ni_l, "の当期純利益率は何%か。"),
        share("PL13", cogs, "売上原価", "の売上原価率は何%か。"),
        metric("PL14", rev.isNotNull() & cogs.isNotNull() & gross.isNotNull(), CHECK, _cat(who, "の", now, "の", rev_l, "から売上原価を差し引いた額はいくらか。"), N.money(rev - cogs), [_step("subtract", rev, cogs)], c.named(rev_l, "売上原価")),
        metric("PL15", gross.isNotNull() & sga.isNotNull() & op.isNotNull(), CHECK, _cat(who, "の", now, "の売上総利益から販売費及び一般管理費を差し引いた額はいくらか。"), N.money(gross - sga), [_step("subtract", gross, sga)], c.named("売上総利益", "販売費及び一般管理費")),
        ratio("PL16", gross, gross_p, "売上総利益", "の売上総利益率は"),
        trend("PL17", ni, ni_p, ni_l, "当期純利益ベースで増益か減益か。"),
        ratio("PL18", ordinary, ordinary_p, "経常利益", "の経常利益率は"),
    ]


class Balance:
    """Balance-sheet values with their stand-ins; a zero total counts as missing."""

    def __init__(self, c: Context, side: str = "now"):
        v = c.cur if side == "now" else c.prev

        def let(level, name, value):
            return c.let(level, f"{side}_{name}", value)

        self.current, self.current_debt = v("流動資産"), v("流動負債")
        self.fixed, self.fixed_debt = let(2, "fixed", N.or_else(v("固定資産"), v("非流動資産"))), let(2, "fixed_debt", N.or_else(v("固定負債"), v("非流動負債")))
        self.equity = let(2, "equity", N.or_else(v("純資産合計"), v("株主資本合計")))
        self.stated, self.stated_debt = v("資産合計"), v("負債合計")
        summed = F.when(N.truthy(self.current) & N.truthy(self.fixed), self.current + self.fixed)
        self.total = let(3, "total", F.when(N.truthy(self.stated), self.stated).otherwise(F.coalesce(summed, self.stated)))
        debts = F.when(N.truthy(self.current_debt) & N.truthy(self.fixed_debt), self.current_debt + self.fixed_debt)
        self.debt = let(3, "debt", F.when(N.truthy(self.stated_debt), self.stated_debt).otherwise(F.coalesce(debts, self.stated_debt)))
        self.equity_label = let(2, "equity_label", F.when(v("純資産合計").isNotNull(), "純資産合計").otherwise("株主資本合計"))
        self.fixed_label = let(2, "fixed_label", F.when(v("固定資産").isNotNull(), "固定資産").otherwise("非流動資産"))
        self.fixed_debt_label = let(2, "fixed_debt_label", F.when(v("固定負債").isNotNull(), "固定負債").otherwise("非流動負債"))


def _share(name, c, guard, part, whole, subtask, text, evidence, decimals=1):
    return metric(name, guard, subtask, _cat(c.company, "の", c.period, *text), N.percent(part / whole * 100, decimals), [_step("divide", part, whole), _step("multiply", "#0", "100")], evidence)


def balance(c: Context) -> list[Column]:
    b, p, ok = Balance(c), Balance(c, "before"), N.truthy
    span = (c.period_last, "から", c.period, "にかけて")
    return [
        _share("BS1", c, ok(b.current) & ok(b.current_debt), b.current, b.current_debt, NUMERIC, ["の流動比率は何%か。"], ["流動資産", "流動負債"]),
        _share("BS2", c, ok(b.equity) & ok(b.total), b.equity, b.total, NUMERIC, ["の自己資本比率は何%か。"], [b.equity_label, "流動資産", "固定資産"]),
        _share("BS3", c, ok(b.debt) & ok(b.total) & ok(b.stated_debt), b.debt, b.total, NUMERIC, ["の負債比率(負債/総資産)は何%か。"], ["負債合計", "流動資産", "固定資産"]),
        _share("BS4", c, ok(b.fixed) & ok(b.total), b.fixed, b.total, NUMERIC, ["の", b.fixed_label, "比率(", b.fixed_label, "/総資産)は何%か。"], [b.fixed_label, "流動資産"]),
        metric("BS5", b.total.isNotNull() & p.total.isNotNull(), TREND, _cat(c.company, "の総資産は", *span, "増加したか減少したか。"), either(b.total - p.total > 0, "増加", "減少"), [_step("subtract", b.total, p.total), _step("greater", "#0", "0")], c.named("資産合計", both=True)),
        metric("BS6", b.equity.isNotNull() & p.equity.isNotNull() & (b.total != 0) & (p.total != 0), TREND, _cat(c.company, "の自己資本比率は", *span, "改善したか悪化したか。"), either(b.equity / b.total - p.equity / p.total > 0, "改善", "悪化"), [_step("divide", b.equity, b.total), _step("divide", p.equity, p.total), _step("subtract", "#0", "#1"), _step("greater", "#2", "0")], c.named(b.equity_label, "資産合計", both=True)),
    ]


def consistency(c: Context) -> list[Column]:
    b, ok = Balance(c), N.truthy
    assets = b.current + b.fixed
    debts = F.coalesce(b.current_debt + b.fixed_debt, b.current_debt)
    agree = F.abs(assets - (debts + b.equity)) < 0.001
    debt_step = F.when(ok(b.fixed_debt), _step("add", b.current_debt, b.fixed_debt)).otherwise(_step("add", b.current_debt, "0"))
    return [
        metric("CC1", ok(b.current) & ok(b.fixed) & ok(b.current_debt) & ok(b.equity), CHECK, _cat(c.company, "の", c.period, "の資産の部の合計(流動資産+", b.fixed_label, ")は、負債・", b.equity_label, "の合計と一致するか。"), either(agree, "はい", "いいえ"), [_step("add", b.current, b.fixed), debt_step, _step("add", "#1", b.equity), _step("eq", "#0", "#2")], ["流動資産", b.fixed_label, "流動負債", F.when(ok(b.fixed_debt), "固定負債").otherwise(""), b.equity_label]),
        metric("CC2", ok(b.current) & ok(b.fixed), CHECK, _cat(c.company, "の", c.period, "の流動資産と", b.fixed_label, "の合計はいくらか。"), N.money(assets), [_step("add", b.current, b.fixed)], ["流動資産", b.fixed_label]),
        metric("CC3", ok(b.current_debt) & ok(b.fixed_debt), CHECK, _cat(c.company, "の", c.period, "の流動負債と", b.fixed_debt_label, "の合計(負債合計)はいくらか。"), N.money(b.current_debt + b.fixed_debt), [_step("add", b.current_debt, b.fixed_debt)], ["流動負債", b.fixed_debt_label]),
        metric("CC4", ok(b.current) & ok(b.fixed) & ok(b.equity) & (assets != 0), CHECK, _cat(c.company, "の", c.period, "の", b.equity_label, "は総資産の何%を占めるか。"), N.percent(b.equity / assets * 100), [_step("add", b.current, b.fixed), _step("divide", b.equity, "#0"), _step("multiply", "#1", "100")], ["流動資産", "固定資産", b.equity_label]),
    ]


def cash(c: Context) -> list[Column]:
    op, inv, fin = c.cur(OPERATING), c.cur(INVESTING), c.cur(FINANCING)
    op_p, inv_p, fin_p = c.prev(OPERATING), c.prev(INVESTING), c.prev(FINANCING)
    span, ok = (c.period_last, "から", c.period, "にかけて"), N.truthy

    def trend(name, a, b, label, text):
        return metric(name, a.isNotNull() & b.isNotNull(), TREND, _cat(c.company, text, *span, "増加したか減少したか。"), either(a - b > 0, "増加", "減少"), [_step("subtract", a, b), _step("greater", "#0", "0")], c.named(label, both=True))

    free, free_p = op + inv, op_p + inv_p
    return [
        metric("CF1", free.isNotNull(), NUMERIC, _cat(c.company, "の", c.period, "のフリーキャッシュフロー(営業CF+投資CF)はいくらか。"), N.money(free, c.scale), [_step("add", op, inv)], c.named(OPERATING, INVESTING)),
        metric("CF2", (free + fin).isNotNull(), NUMERIC, _cat(c.company, "の", c.period, "の3つのキャッシュフロー活動の合計額はいくらか(為替影響除く)。"), N.money(free + fin, c.scale), [_step("add", op, inv), _step("add", "#0", fin)], c.named(OPERATING, INVESTING, FINANCING)),
        metric("CF3", ok(op) & ok(inv), NUMERIC, _cat(c.company, "の", c.period, "の営業CFは投資CFの何%をカバーしているか。"), N.percent(op / F.abs(inv) * 100), [_step("divide", op, F.abs(inv)), _step("multiply", "#0", "100")], c.named(OPERATING, INVESTING)),
        trend("CF4", op, op_p, OPERATING, "の営業キャッシュフローは"),
        metric("CF5", free.isNotNull() & free_p.isNotNull(), TREND, _cat(c.company, "のフリーキャッシュフローは", *span, "改善したか悪化したか。"), either(free - free_p > 0, "改善", "悪化"), [_step("add", op, inv), _step("add", op_p, inv_p), _step("subtract", "#0", "#1"), _step("greater", "#2", "0")], c.named(OPERATING, INVESTING, both=True)),
        trend("CF6", inv, inv_p, INVESTING, "の投資活動によるキャッシュ・フローは"),
        trend("CF7", fin, fin_p, FINANCING, "の財務活動によるキャッシュ・フローは"),
    ]


def cross(c: Context) -> list[Column]:
    b, ok = Balance(c), N.truthy
    rev_l, rev, _ = c.first_of("sales", "売上高", "売上収益")
    op, ordinary, total, equity = c.cur("営業利益"), c.cur("経常利益"), b.total, b.equity
    ni = c.let(2, "net_or", N.or_else(c.cur("当期純利益"), c.cur(OWNERS)))
    ni_l = c.let(2, "net_or_label", F.when(c.cur("当期純利益").isNotNull(), "当期純利益").otherwise(OWNERS))
    dupont = (rev != 0) & ok(ni) & ok(total) & ok(equity)
    roe = (ni / rev) * (rev / total) * (total / equity) * 100

    def ratio(name, a, x, text, evidence):
        return metric(name, dupont, NUMERIC, _cat(c.company, "の", c.period, *text), N.times(rounded(a / x)), [_step("divide", a, x), _step("round", "#0", "2")], evidence)

    def rounded(x):
        return N.plain(x, 2).cast("double")

    return [
        _share("XS1", c, ok(ordinary) & ok(total), ordinary, total, NUMERIC, ["のROA(経常利益/総資産)は何%か。"], ["経常利益", "資産合計"], 2),
        _share("XS2", c, ok(ni) & ok(equity), ni, equity, NUMERIC, ["のROE(", ni_l, "/純資産)は何%か。"], [ni_l, "純資産合計"], 2),
        _share("XS3", c, ok(op) & (rev != 0), op, rev, NUMERIC, ["の", rev_l, "に対する営業利益率は何%か。"], ["営業利益", rev_l]),
        _share("XS4", c, rev.isNotNull() & ok(total), rev, total, NUMERIC, ["の総資産回転率(", rev_l, "/総資産*100)は何%か。"], [rev_l, "資産合計"]),
        metric("XS5", ok(b.debt) & ok(equity) & ok(total), CHECK, _cat(c.company, "の", c.period, "の負債合計と", b.equity_label, "の合計はいくらか。"), N.money(b.debt + equity), [_step("add", b.debt, equity)], ["負債合計", b.equity_label]),
        _share("XS6", c, ok(ordinary) & ok(total), ordinary, total, CHECK, ["の損益計算書の経常利益を貸借対照表の総資産で割った値は何%か。"], ["経常利益", "資産合計"], 2),
        metric("DP1", dupont, NUMERIC, _cat(c.company, "の", c.period, "のROEをDuPont分解(純利益率×総資産回転率×財務レバレッジ)で求めると何%か。"), N.percent(roe, 2), [_step("divide", ni, rev), _step("divide", rev, total), _step("divide", total, equity), _step("multiply", "#0", "#1"), _step("multiply", "#3", "#2"), _step("multiply", "#4", "100")], [ni_l, rev_l, "資産合計", b.equity_label]),
        _share("DP2", c, dupont, ni, rev, NUMERIC, ["の売上高純利益率は何%か。"], [ni_l, rev_l], 2),
        ratio("DP3", rev, total, ["の総資産回転率(", rev_l, "/総資産)は何倍か。"], [rev_l, "資産合計"]),
        ratio("DP4", total, equity, ["の財務レバレッジ(総資産/", b.equity_label, ")は何倍か。"], ["資産合計", b.equity_label]),
    ]


KINDS = {"pl_comparison": income, "bs_summary": balance, "bs_consistency": consistency, "cf_summary": cash, "cross_statement": cross}
NAMES = {
    "pl_comparison": [f"PL{k}" for k in range(1, 19)], "bs_summary": [f"BS{k}" for k in range(1, 7)], "bs_consistency": [f"CC{k}" for k in range(1, 5)], "cf_summary": [f"CF{k}" for k in range(1, 8)],
    "cross_statement": [f"XS{k}" for k in range(1, 7)] + [f"DP{k}" for k in range(1, 5)],
}
TEMPLATES = tuple(name for names in NAMES.values() for name in names)


def evidence_rows(labels: Column, rows: Column) -> Column:
    """Indices of the first rows whose first cells are the labels without their years; sorted, each once, unknown ones left out."""
    firsts = F.transform(rows, lambda r: F.get(r, F.lit(0)))
    at = F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.array_position(firsts, F.regexp_replace(x, "_[0-9]{4}$", "")) - 1)
    return F.array_sort(F.array_distinct(F.filter(at, lambda i: i >= 0)))


#: Metrics in one branch: more would outgrow what a generated method may hold.
BRANCH = 6


def _asked(contexts: DataFrame, kind: str, only: tuple[str, ...]) -> DataFrame:
    """Questions of some templates of one kind, in one pass over its contexts and without a shuffle."""
    names, c = contexts.columns, Context()
    made = [F.when(m.isNotNull(), F.struct(F.lit(no).alias("no"), m.alias("m"))) for no, (name, m) in enumerate(zip(NAMES[kind], KINDS[kind](c), strict=True)) if name in only]
    out = c.stage(contexts.where(F.col("context_type") == kind)).select(*names, F.explode(F.array(*made)).alias("x")).where("x IS NOT NULL").select(*names, F.col("x.no").alias("template_no"), "x.m")
    qa = F.struct("m.question", "m.program", "m.answer", evidence_rows(F.col("m.labels"), F.col("table.rows")).alias("gold_evidence"))
    return out.select("company_name", "edinet_code", "source_doc_id", "filing_year", "accounting_standard", "context_type", "pos", "template_no", "m.template", "m.subtask", "pre_text", "post_text", "table", qa.alias("qa"), "scale")


def questions(contexts: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Questions of all contexts (of some templates only, if named), in the order ``(edinet_code, pos, template_no)``.

    Templates are asked in branches of a few metrics of one kind. Where there are several branches, the contexts are stored
    first, by kind, so that they are made once and a branch reads its kind only.
    """
    wanted = TEMPLATES if only is None else only
    if not set(wanted) <= set(TEMPLATES) or not wanted:
        raise ValueError(f"no such template: {only}")
    branches = []
    for kind, names in NAMES.items():
        own = [n for n in names if n in wanted]
        branches += [(kind, tuple(own[k : k + BRANCH])) for k in range(0, len(own), BRANCH)]
    kept = contexts if len(branches) == 1 else store(contexts, "context_type")
    made = [_asked(kept, *b) for b in branches]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out
