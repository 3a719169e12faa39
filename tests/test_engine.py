"""The engine's operators against golden values, a plain model of the rules, and small fixtures."""

import datetime
import difflib
import itertools
import json
import math
import random
import re
import statistics
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlark import cli, plans
from ledgerlark.functions import numbers as N
from ledgerlark.functions import render as R
from ledgerlark.functions import text as T
from ledgerlark.operators import audit, evaluate, program, runs, statements, templates, validate
from ledgerlark.plans.inputs import derived
from ledgerlark.schema import FLAT, SUBTASKS
from ledgerlark.sources import io


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


# a plain model of the text rules


def model_normalize(s):
    s = unicodedata.normalize("NFKC", (s or "").strip())
    s = re.sub("^[△▲]", "-", s)
    s = re.sub(r"(?<=\d),(?=\d)", "", s)
    for end in ("しました", "した"):
        if s.endswith(end):
            s = s[: -len(end)]
            break
    return s.lower().strip()


def model_number(s):
    s = model_normalize(s)
    for u in T.UNITS:
        s = s.removesuffix(u)
    factor = next((by for sign, by in T.MULTIPLIERS if sign in s), 1)
    try:
        return float(re.sub(r"[^\d.\-+]", "", s)) * factor
    except ValueError:
        return None


GOLDEN = {
    "△1,000": -1000, "１２３": 123, "100百万円": 100, "100百万": 1e8, "50億円": 50, "50億": 5e9, "1.5兆": 1.5e12, "△500百万": -5e8, "1億2千万": 12000, "10万": 10, "5-3": None, "−5": 5, "24,956百万円": 24956, "-42.5%": -42.5, "増加": None, "": None, "1,2,3": 123, "12pt": 12, "1e5": 15,
}


def test_golden_numbers(spark):
    assert column(spark, list(GOLDEN), T.extract_number) == list(GOLDEN.values())


def test_text_agrees_with_the_model(spark):
    rng = random.Random(1)
    alphabet = list("0123456789,,..-+△▲ 　%円千百万億兆した増改ABpt１２，％−\n")
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None]
    assert column(spark, values, T.normalize_answer) == [model_normalize(v) for v in values]
    assert column(spark, values, T.extract_number) == [model_number(v) for v in values]


@pytest.mark.parametrize(("predicted", "gold", "tolerance", "want"), [
    ("42.5", "42.0", 0.02, True), ("42.5", "40.0", 0.01, False), ("0", "0", 0.01, True), ("0.1", "0", 0.01, False), ("増加した", "増加", 0.01, True), ("24956百万円", "24956", 0.01, True), ("", "5", 0.01, False), ("101", "100", 0.01, True),
])
def test_numerical_match(spark, predicted, gold, tolerance, want):
    df = spark.createDataFrame([(predicted, gold)], "p string, g string")
    assert df.select(T.numerical_match("p", "g", tolerance)).first()[0] is want


def test_answers_in_outputs(spark):
    values = ["steps\nAnswer: 42\nmore", "回答：増加", "EBITDA: 5", "one\n\n two \n ", "", None, "answer:\n7"]
    assert column(spark, values, T.harness_answer) == ["42", "増加", "5", "two", "", "", "7"]
    tagged = column(spark, ["ANSWER: 1 \nx", "no tag\nlast", "", "answer：3"], T.tagged_answer)
    assert [(r.predicted, r.parsed) for r in tagged] == [("1", True), ("last", False), ("", False), ("answer：3", False)]


def test_cells_and_near(spark):
    assert column(spark, ["△1,234百万円", " ▲5 ", "12.5%", "1e3", "n/a", None, "1 234"], T.cell_number) == [-1234, -5, 12.5, 1000, None, None, 1234]
    df = spark.createDataFrame([(1.0, 1.0), (100.0, 99.0), (0.4, 0.0), (3.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(T.near(F.col("a"), F.col("b"))).collect()] == [True, True, True, False]


def test_cell_number_reads_full_width_digits(spark):
    cells = ["１２３", "△１,２３４百万円", "１２.５%", "٣٤", "１２．５", "５e２"]
    assert column(spark, cells, T.cell_number) == [123, -1234, 12.5, 34, None, 500]


def test_near_query_has_tolerance_zero(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.id: r.near for r in plans.QUERIES["n13_near"](spark, folder).collect()}
    rows = derived(spark, folder, "programs").collect()
    assert got.keys() == {r.id for r in rows} and any(r.k == 0 for r in rows)
    for r in rows:
        d = abs(r.a - r.b * 1000)
        assert got[r.id] == (d <= 0.5 or d / (r.b * 1000) <= 0.02 * r.k)


def test_cell_number_query_reads_every_line(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.id: r.number for r in plans.QUERIES["n12_cell_number"](spark, folder).collect()}
    gold = {r.id: r.gold for r in derived(spark, folder, "answers").select("id", "gold").collect()}
    assert got.keys() == gold.keys()
    wide = {k: float(g) for k, g in gold.items() if any("０" <= c <= "９" for c in g)}
    assert wide and all(got[k] == v for k, v in wide.items())


def test_numbers_as_text(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(0, 9) for _ in range(2000)] + [0.35, 0.45, -0.04, 2.5, 1e6]
    assert column(spark, values, lambda v: N.plain(v, 1), "double") == [f"{v:.1f}" for v in values]
    assert column(spark, [1439231.0, 0.5, 12345678.25, -3.0], N.literal, "double") == ["1439231.0", "0.5", "12345678.25", "-3.0"]
    assert column(spark, [1234567.0, -1500.0, 1234.0], lambda v: N.cell(v, 1000), "double") == ["1,234.6", "△1.5", "1.2"]


# programs


@pytest.mark.parametrize(("steps", "want"), [
    (["add(10, 20)"], 30), (["subtract(1500000, 1200000)", "divide(#0, 1200000)", "multiply(#1, 100)"], 25.0), (["divide(1, 0)"], math.inf), (["eq(1, 1.0005)"], True), (["greater(1, 2)"], False), (["min(3, 1, 2)"], 1), (["max(#0)"], "argument error"), (["round(2.5)"], 2.0), (["add(a, b)"], "ab"),
    (["add(5000, -15000)", "abs(#0)"], 10000), ([], "Empty program"), (["frob(1)"], "unknown operation"), (["add(1)"], "execution error"), (["add 1"], "cannot parse"), (["add(f(1, 2), x)"], "f(1, 2)x"), (["add(1e5, 2)"], "execution error"), (["multiply(true, 3)"], 3), (["exp(2, 10)"], 1024), (["add(1, 2,)"], 3),
])
def test_programs(steps, want):
    if isinstance(want, str) and want != "ab" and want != "f(1, 2)x":
        with pytest.raises(program.ProgramError, match=want):
            program.run(steps)
    else:
        assert program.run(steps)[-1] == want and isinstance(program.run(steps)[-1], bool) == isinstance(want, bool)


def test_programs_in_spark(spark):
    df = spark.createDataFrame([(["add(1, 2)"],), (["eq(1, 1)"],), (None,), (["nope"],)], "p array<string>")
    got = [r[0] for r in df.select(program.execute(F.col("p"))).collect()]
    assert [(r.kind, r.text) for r in got[:2]] == [("number", "3"), ("bool", "true")] and got[2].error == "Empty program" and "cannot parse" in got[3].error


# files

NATIVE = {"id": "nr_1", "subtask": "numerical_reasoning", "pre_text": ["前"], "post_text": [], "table": {"headers": ["", "2024"], "rows": [["売上高", "△1,000"], ["原価", "5"]]}, "qa": {"question": "いくらか。", "program": ["add(1, 2)"], "answer": "3", "gold_evidence": [0]}, "edinet_code": "E1", "filing_year": "2024"}
GRID = {"id": "g", "table": [["", "2023"], ["r", "1"]], "qa": {"question": "q", "answer": "5"}}
FLAT_ROW = {"id": "f", "subtask": "temporal_reasoning", "pre_text": [], "table_headers": ["h"], "table_rows": [["1"]], "question": "fq", "program": [], "answer": "増収", "gold_evidence": [1, 2]}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([NATIVE, GRID, FLAT_ROW], ensure_ascii=False))
    (tmp_path / "b.jsonl").write_text("\n".join(["", json.dumps(NATIVE), "  ", json.dumps(GRID)]))
    a = io.load_file(spark, str(tmp_path / "a.json")).collect()
    assert [r.id for r in a] == ["nr_1", "g", "f"] and a[0].table.rows[0] == ["売上高", "△1,000"] and a[1].table.headers == ["", "2023"] and a[1].table.rows == [["r", "1"]] and a[1].subtask == "numerical_reasoning"
    assert a[2].qa.answer == "増収" and a[2].qa.gold_evidence == [1, 2] and a[0].edinet_code == "E1" and a[0].source_doc_id is None and a[2].table.headers == ["h"]
    assert [r.id for r in io.load_file(spark, str(tmp_path / "b.jsonl")).collect()] == ["nr_1", "g"]
    assert [r.id for r in io.load_file(spark, str(tmp_path / "a.json"), "temporal_reasoning").collect()] == ["f"]
    (tmp_path / "bad.json").write_text(json.dumps([NATIVE | {"subtask": "nope"}]))
    with pytest.raises(Exception, match="unknown subtask"):
        io.load_file(spark, str(tmp_path / "bad.json")).collect()


def test_tables_and_round_trips(spark, tmp_path):
    rows = [json.dumps(NATIVE | {"id": f"x{k}", "subtask": s}) for k, s in enumerate(SUBTASKS)]
    (tmp_path / "q.jsonl").write_text("\n".join(rows))
    q = io.load_file(spark, str(tmp_path / "q.jsonl"))
    flat = io.flatten(q)
    assert tuple(flat.columns) == FLAT
    io.publish(flat, str(tmp_path / "table"))
    back = io.load_table(spark, str(tmp_path / "table"))
    assert sorted(r.id for r in back.collect()) == ["x0", "x1", "x2"] and io.load_table(spark, str(tmp_path / "table"), SUBTASKS[1]).count() == 1
    assert sorted(map(str, io.unflatten(back.select(*FLAT)).collect())) == sorted(map(str, q.select(*io.unflatten(back).columns).collect()))
    grid = io.to_grid_rows(q)
    assert grid.first().table == [["", "2024"], ["売上高", "△1,000"], ["原価", "5"]] and io.from_grid_rows(grid).first().table.headers == ["", "2024"]
    io.publish(flat.where("subtask <> 'temporal_reasoning'"), str(tmp_path / "two"))
    with pytest.raises(ValueError, match="temporal"):
        io.load_table(spark, str(tmp_path / "two"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "q.json").write_text(json.dumps([NATIVE, GRID], ensure_ascii=False))
    (tmp_path / "p.json").write_text(json.dumps({"nr_1": "3.0", "zz": "1"}))
    assert cli.main(["evaluate", "-d", str(tmp_path / "q.json"), "-p", str(tmp_path / "p.json"), "-o", str(tmp_path / "out")], spark) == 0
    said = capsys.readouterr().out
    assert "Overall: 50.0% (1/2)" in said and "numerical_reasoning: 50.0% (1/2)" in said
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert cli.main(["inspect", "-d", str(tmp_path / "q.json"), "-n", "1"], spark) == 0
    assert "ID: nr_1" in (said := capsys.readouterr().out) and "Program: add(1, 2)" in said and "2 rows x 2 cols" in said and "Source: E1 (2024)" in said
    assert cli.main(["inspect", "-d", str(tmp_path / "q.json"), "-j"], spark) == 0 and len(json.loads(capsys.readouterr().out)) == 2


# scoring


def questions(spark, rows):
    return spark.createDataFrame(rows, "id string, subtask string, gold string")


def test_evaluate(spark):
    q = questions(spark, [("a", "numerical_reasoning", "25.0%"), ("b", "numerical_reasoning", "16%"), ("c", "temporal_reasoning", "増収")])
    p = spark.createDataFrame([("a", "25"), ("c", "増収した"), ("z", "1")], "id string, predicted string")
    v = evaluate.evaluate(q, predictions=p)
    assert {r.question_id: r.correct for r in v.collect()} == {"a": True, "b": False, "c": True}
    acc = {r.subtask: (r.total, r.correct, r.accuracy) for r in evaluate.accuracy(v).collect()}
    assert acc[None] == (3, 2, 2 / 3) and acc["numerical_reasoning"] == (2, 1, 0.5)
    assert evaluate.summary(evaluate.accuracy(v)).splitlines()[2:] == ["Overall: 66.7% (2/3)", "", "  numerical_reasoning: 50.0% (1/2)", "  temporal_reasoning: 100.0% (1/1)"]
    assert [r.correct for r in evaluate.evaluate(q, predictions=p, mode="exact").orderBy("question_id").collect()] == [False, False, True]


def test_evaluate_without_questions_or_inputs(spark):
    q = questions(spark, [])
    empty = spark.createDataFrame([], "id string, predicted string")
    assert [tuple(r) for r in evaluate.accuracy(evaluate.evaluate(q, predictions=empty)).collect()] == [(None, 0, 0, 0.0)]
    with pytest.raises(ValueError):
        evaluate.evaluate(q)
    with pytest.raises(ValueError):
        evaluate.evaluate(q, predictions=empty, model=lambda a, b: "")
    with pytest.raises(ValueError, match="mode"):
        evaluate.evaluate(q, predictions=empty, mode="fuzzy")


def test_model_function(spark):
    q = spark.createDataFrame([("a", "numerical_reasoning", "7", "3+4", "ctx")], "id string, subtask string, gold string, question string, context string")
    assert evaluate.evaluate(q, model=lambda question, context: str(sum(map(int, question.split("+"))))).first().correct


def test_rendering(spark):
    df = spark.createDataFrame([(["", "x"], [["r", "1"], ["s", None]], ["p"], [])], "h array<string>, r array<array<string>>, pre array<string>, post array<string>")
    got = df.select(R.markdown(F.col("h"), F.col("r")), R.context(*(F.col(c) for c in ("pre", "h", "r", "post")))).first()
    assert got[0] == "|  | x |\n| --- | --- |\n| r | 1 |\n| s |  |" and got[1] == "p\n\n" + got[0]
    assert df.select(R.fill("{a} {{x}}", a=F.lit("1"))).first()[0] == "1 {x}"


# statements and templates


def make_items(year, scale=1.0, drop=()):
    values = {"income_statement": {"売上高": 2000, "売上原価": 1200, "売上総利益": 800, "販売費及び一般管理費": 500, "営業利益": 300, "経常利益": 310, "当期純利益": 200}, "balance_sheet": {"流動資産": 900, "固定資産": 1100, "資産合計": 2000, "流動負債": 500, "固定負債": 500, "負債合計": 1000, "純資産合計": 1000}, "cash_flow_statement": {"営業活動によるキャッシュ・フロー": 250, "投資活動によるキャッシュ・フロー": -300, "財務活動によるキャッシュ・フロー": 20}}
    return [("E1", year, s, k, label, v * 1e6 * scale) for s, own in values.items() for k, (label, v) in enumerate(own.items()) if label not in drop]


def build(spark, items):
    items = spark.createDataFrame(items, "company string, year string, statement string, pos bigint, label string, value double")
    filings = items.select("company", "year").distinct().withColumn("doc_id", F.concat(F.lit("S"), "year"))
    return statements.contexts(items, spark.createDataFrame([("E1", "Example", "J-GAAP")], "edinet_code string, name string, gaap string"), filings)


def test_contexts(spark):
    c = {r.context_type: r for r in build(spark, make_items("2024") + make_items("2023", 0.8)).collect()}
    assert list(c) == ["pl_comparison", "bs_summary", "bs_consistency", "cf_summary", "cross_statement"]
    pl = c["pl_comparison"]
    assert pl.table.headers == ["", "2024年3月期", "2023年3月期"] and pl.table.rows[0] == ["売上高", "2,000", "1,600"] and pl.scale == "百万円" and pl.raw_values["売上高_2023"] == 1600.0
    assert pl.pre_text == ["以下はExampleの2024年3月期連結損益計算書の抜粋である。"] and pl.post_text == ["当期は前期比で増収となった。"] and c["bs_summary"].post_text == ["総資産は前期比で増加した。"]
    assert c["cf_summary"].post_text == ["フリーキャッシュフローはマイナスであった。"] and c["cf_summary"].table.rows[1][1] == "△300" and c["bs_consistency"].table.headers == ["", "金額(百万円)"]
    assert [r[0] for r in c["cross_statement"].table.rows[:7]] == ["売上高", "売上原価", "売上総利益", "販売費及び一般管理費", "営業利益", "当期純利益", "経常利益"] and len(c["cross_statement"].table.rows) == 14


def test_contexts_of_one_year(spark):
    kinds = [r.context_type for r in build(spark, make_items("2024")).collect()]
    assert kinds == ["bs_consistency", "cross_statement"]
    assert build(spark, make_items("2024")[:1]).count() == 0


def test_questions_pass_validation(spark):
    q = templates.questions(build(spark, make_items("2024") + make_items("2023", 0.8))).cache()
    assert {r.template for r in q.select("template").collect()} == set(templates.TEMPLATES)
    flat = q.select("template", "qa.question", "qa.answer", "qa.program", "qa.gold_evidence")
    bad = validate.validate(flat).where("reason <> ''").collect()
    assert not bad, bad[:3]
    by = {r.template: r for r in flat.collect()}
    assert by["PL1"].answer == "25.0%" and by["PL1"].program == ["subtract(2000.0, 1600.0)", "divide(#0, 1600.0)", "multiply(#1, 100)"] and by["PL1"].gold_evidence == [0]
    assert by["CC1"].answer == "はい" and by["CF1"].answer == "-50百万円" and by["DP3"].answer == "1.00倍" and by["PL3"].answer == "400百万円" and by["CC1"].gold_evidence == [0, 1, 3, 4, 6]
    assert by["PL1"].question == "Exampleの2024年3月期の売上高は前期比で何%増減したか。" and by["DP1"].answer == "20.00%"
    assert templates.questions(build(spark, make_items("2024"))).where("subtask = 'temporal_reasoning'").count() == 0


def test_stand_ins(spark):
    items = [(*r[:4], {"固定資産": "非流動資産", "純資産合計": "株主資本合計"}.get(r[4], r[4]), 0.0 if r[4] == "資産合計" else r[5]) for r in make_items("2024")]
    by = {r.template: r for r in templates.questions(build(spark, items)).select("template", "qa.question", "qa.answer").collect()}
    assert by["CC4"].answer == "50.0%" and "株主資本合計" in by["CC4"].question and by["XS1"].answer == "15.50%" and "非流動資産" in by["CC2"].question


def test_named_elements(spark):
    rows = [("E1", "2024", "income_statement", k, e, c, v) for k, (e, c, v) in enumerate([("OperatingIncome", "CurrentYearDuration", 5.0), ("NetSales", "CurrentYearDuration", 1.0), ("NetSales", "CurrentYearDuration", 2.0), ("NetSales", "Prior1YearDuration", 9.0), ("NetSales", "CurrentYearDuration_NonConsolidatedMember", 8.0), ("ResearchAndDevelopmentExpenses", "CurrentYearInstant", 3.0), ("ResearchAndDevelopmentExpenses", "CurrentYearInstant", 4.0), ("Unknown", "CurrentYearInstant", 7.0), ("TotalAssets", "CurrentYearInstant", 6.0)])]
    got = statements.element_items(spark.createDataFrame(rows, "company string, year string, statement string, pos bigint, element string, context string, value double")).orderBy("pos").collect()
    assert [(r.label, r.value) for r in got] == [("売上高", 2.0), ("営業利益", 5.0), ("研究開発費", 3.0), ("資産合計", 6.0)]


def test_filing_files(spark, tmp_path):
    raw = {"company": {"edinet_code": "E1", "name": "Example", "industry": "x", "gaap": "IFRS"}, "filings": {"2024": {"filing": {"doc_id": "S1", "edinet_code": "E9", "doc_type": "130", "company_name": ""}, "accounting_standard": "IFRS", "income_statement": [{"科目": "売上高", "当期": 5, "前期": 4}, {"科目": "x", "当期": "n/a"}], "balance_sheet": [{"element": "TotalAssets", "value": 7.5, "context": "CurrentYearInstant"}], "cash_flow_statement": None}}}
    (tmp_path / "E1.json").write_text(json.dumps(raw, ensure_ascii=False))
    companies, filings, items = io.load_filings(spark, str(tmp_path))
    assert companies.first().file_stem == "E1" and companies.first().gaap == "IFRS" and filings.first().doc_id == "S1"
    got = {(r.statement, r.pos): (r.label, r.element, r.value, r.previous, r.newer) for r in items.collect()}
    assert got == {("income_statement", 0): ("売上高", None, 5.0, 4.0, True), ("income_statement", 1): ("x", None, None, None, True), ("balance_sheet", 0): (None, "TotalAssets", 7.5, None, False)}
    assert sorted(r.issue for r in audit.integrity(filings, companies).collect()) == ["filing_code_mismatch", "missing_company_name", "non_annual_doc_type"]


# validation, sampling


def test_reasons(spark):
    rows = [("q", "3", ["add(1, 2)"], [0]), (" ", "3", ["add(1, 2)"], [0]), ("q", "", ["add(1, 2)"], [0]), ("q", "3", [], [0]), ("q", "3", ["x"], [0]), ("q", "3", ["divide(1, 0)"], [0]), ("q", "9", ["add(1, 2)"], [0]), ("q", "3", ["add(1, 2)"], []), (None, "3", ["add(1, 2)"], [0]), ("q", "いいえ", ["greater(1, 2)"], [0]), ("q", "3.1%", ["add(1, 2)"], [0]), ("q", "ab", ["add(a, b)"], [0]), ("q", "3", None, [0])]
    got = [r.reason for r in validate.validate(spark.createDataFrame(rows, "question string, answer string, program array<string>, gold_evidence array<bigint>")).collect()]
    assert [g.split(":")[0] for g in got] == ["", "empty_question", "empty_answer", "too_few_steps", "dsl_error", "invalid_result", "answer_mismatch", "no_gold_evidence", "missing_field", "", "", "", "missing_field"]


def greedy(rows):
    def grams(t):
        t = unicodedata.normalize("NFKC", t.strip()).replace("△", "-").replace("▲", "-").replace(",", "").lower()
        return {t[i : i + 3] for i in range(len(t) - 2)}

    kept, out = {}, []
    for pos, text, subtask, company in rows:
        own = kept.setdefault((subtask, company), [])
        g = grams(text)
        if not any(g and k and len(g & k) / len(g | k) > 0.7 for k in own):
            own.append(g)
            out.append(pos)
    return out


def test_dedupe_is_greedy(spark):
    rng = random.Random(3)
    rows = []
    for pos in range(160):
        base = list("the quick brown fox jumps over"[: rng.choice([2, 12, 30])])
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice("xyz")
        rows.append((pos, "".join(base), rng.choice("ab"), rng.choice(["E1", "E2"])))
    df = spark.createDataFrame(rows, "pos bigint, question string, subtask string, edinet_code string")
    assert sorted(r.pos for r in validate.dedupe(df).collect()) == greedy(rows)
    assert validate.dedupe(df.limit(0)).count() == 0


def test_diverse_sample(spark):
    rng = random.Random(4)
    rows = [(pos, rng.choice(SUBTASKS), rng.choice(["A", "B", "C", "D", None]), ["s"] * rng.randint(1, 5)) for pos in range(150)]
    targets = [(s, s[:2], t, k) for k, (s, t) in enumerate(zip(SUBTASKS, (12, 100, 9)))]
    df = spark.createDataFrame(rows, "pos bigint, subtask string, edinet_code string, program array<string>")
    got = {}
    for r in validate.diverse(df, spark.createDataFrame(targets, "subtask string, prefix string, target int, rank int")).orderBy("sample_no").collect():
        got.setdefault(r.subtask, []).append(r.pos)
    cap = max(3, int(121 * 0.05))
    for s, _, target, _ in targets:
        own = [r for r in rows if r[1] == s]
        want = [r[0] for r in own]
        if len(own) > target:
            queues = {}
            for r in own:
                queues.setdefault(r[2] or "unknown", []).append(r)
            if s == "numerical_reasoning":
                queues = {k: sorted(v, key=lambda r: -len(r[3])) for k, v in queues.items()}
            want = [q[i][0] for i in range(cap) for q in queues.values() if i < len(q)][:target]
        assert got[s] == want
    assert validate.with_ids(spark.createDataFrame([("numerical_reasoning", 1234), ("temporal_reasoning", 7), ("other", 1)], "subtask string, sample_no int")).select("id").collect() == [("nr_1234",), ("tr_007",), ("q_001",)]


def test_lite_sample(spark):
    rng = random.Random(5)
    rows = [(pos, rng.choice(SUBTASKS), rng.choice(["J-GAAP", "IFRS", "US-GAAP"]), f"E{rng.randrange(90)}") for pos in range(1500)]
    df = spark.createDataFrame(rows, "pos bigint, subtask string, accounting_standard string, edinet_code string")
    got = validate.lite(df)
    assert got == sorted(got) == validate.lite(df) and len(got) == validate.LITE_SIZE
    companies = [rows[p][3] for p in got]
    assert max(companies.count(c) for c in companies) <= validate.LITE_CAP
    few = df.where("edinet_code IN ('E1', 'E2', 'E3')")
    assert len(validate.lite(few)) == 12 and validate.lite(df.limit(0)) == []


# normal forms


@pytest.mark.parametrize("text", ["é", "e\u0301", "ｶﾞ", "が", "か\u3099", "①½ﬁ", "１２３％", "　全角　", "△1,000", "Ａ\u0301", "ｱ\u3099", "百万円", "～｀", "Ǆ", "한", "한"])
def test_normal_form(spark, text):
    assert column(spark, [f"a{text}b", text], T.nfkc) == [unicodedata.normalize("NFKC", t) for t in (f"a{text}b", text)]


def test_characters_that_stay_are_normal():
    inside = re.compile(f"[{T.PLAIN}]+")
    rng = random.Random(8)
    stay = [c for c in map(chr, range(0x80, 0x10000)) if inside.fullmatch(c)]
    assert all(unicodedata.normalize("NFKC", c) == c for c in stay)
    for _ in range(2000):
        t = "".join(rng.choice(stay) for _ in range(6))
        assert unicodedata.normalize("NFKC", t) == t
    assert unicodedata.normalize("NFKC", T.FULL) == T.NARROW


# audits


def test_audit_findings(spark):
    rows = [(0, ["add(1, 2)"], "3"), (1, ["add(1, 2)"], "9"), (2, ["greater(2, 1)"], "はい"), (3, ["greater(2, 1)"], "いいえ"), (4, [], "1"), (5, ["divide(36, 10000)"], "0.00%"), (6, ["add(a, b)"], "ab")]
    got = {r.idx: r.finding for r in audit.program_findings(spark.createDataFrame(rows, "idx int, program array<string>, answer string")).collect()}
    assert got == {1: "dsl_mismatch", 3: "dsl_mismatch", 4: "dsl_unparsable"}


def test_duplicates(spark):
    base = "What was the operating margin of Example in fiscal 2024?"
    rows = [(0, base, "C", "s", "2024", "1%"), (1, f" {base} ", "C", "s", "2024", "1%"), (2, base.replace("2024", "2023"), "C", "s", "2024", "1%"), (3, base.replace("2024", "2022"), "C", "s", "2024", "2%"), (4, "other", "C", "s", "2024", "1%"), (5, None, "C", "s", "2024", None)]
    df = spark.createDataFrame(rows, "idx int, question string, company_name string, subtask string, filing_year string, answer string")
    assert [tuple(r) for r in audit.exact_duplicates(df).collect()] == [(0, 1)]
    near = sorted(tuple(r)[:2] for r in audit.near_duplicates(df).collect())
    assert near == [(0, 1), (0, 2), (1, 2)]


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng, rows = random.Random(12), []
    for k in range(120):
        base = list(rng.choice(["How much did net sales of Example grow in fiscal 2024?", "営業利益率は何%か。前期と比べて改善したか。", "Was it more?"]) * rng.choice([1, 3]))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            base[rng.randrange(len(base))] = rng.choice("xyzあ")
        rows.append((k, "".join(base), rng.choice("CD"), "s", "2024", rng.choice(["1%", "増加"])))
    df = spark.createDataFrame(rows, "idx int, question string, company_name string, subtask string, filing_year string, answer string")
    want = {}
    for (i, p, *a), (j, q, *b) in itertools.combinations(rows, 2):
        ratio = difflib.SequenceMatcher(a=p, b=q, autojunk=False).ratio()
        if a == b and p != q and ratio >= audit.SIMILAR:
            want[i, j] = round(ratio, 3)
    got = {(r.first_index, r.similar_index): r.ratio for r in audit.near_duplicates(df).collect()}
    assert got == want and len(want) > 50
    assert audit.near_duplicates(df.limit(0)).count() == 0


def test_distribution_in_one_pass(spark):
    rng = random.Random(14)
    rows = [(k, rng.choice([*SUBTASKS, None]), rng.choice(["IFRS", None]), rng.choice(["2023", "2024"]), rng.choice(["E1", "E2", None]), rng.choice(["A", "B", "C", None])) for k in range(60)]
    df = spark.createDataFrame(rows, "idx int, subtask string, accounting_standard string, filing_year string, edinet_code string, company_name string")
    got = {(r.measure, r.key): r.value for r in audit.distribution(df, 2).collect()}
    want = {("total", ""): 60, ("unique_companies", ""): len({r[4] or "?" for r in rows})}
    for name, k in (("subtask", 1), ("accounting_standard", 2), ("filing_year", 3)):
        for r in rows:
            want[name, r[k] or "?"] = want.get((name, r[k] or "?"), 0) + 1
    tops = Counter(r[5] or "?" for r in rows).most_common(2)
    assert got == want | {("top_companies", c): n for c, n in tops}
    assert {(r.measure, r.value) for r in audit.distribution(df.limit(0)).collect()} == {("total", 0), ("unique_companies", 0)}


def test_identities(spark):
    rows = [("a", "ROEは何%か。", [["売上高", "100"], ["売上原価", "120"], ["売上総利益", "50"], ["当期純利益", "10"], ["親会社株主に帰属する当期純利益", "9"], ["売上高", "999"]]), ("b", "q", [["資産合計", "100百万円"], ["流動資産", "40"], ["固定資産", "60"], [None, "x"], []])]
    got = sorted(tuple(r) for r in audit.table_findings(spark.createDataFrame(rows, "id string, question string, table_rows array<array<string>>")).collect())
    assert got == [("a", "gross_profit_mismatch"), ("a", "impossible_cogs"), ("a", "roe_convention_ambiguity")]
    report = audit.report(spark.createDataFrame(got, "id string, finding string"), spark.createDataFrame([("total", "", 2)], "measure string, key string, value bigint"))
    assert "- impossible_cogs: 1" in report and "- affected ids: 1" in report and "- total" in report


def test_missing_fields(spark):
    full = {k: None for k in audit.REQUIRED} | {"qa": {k: 1 for k in audit.REQUIRED_QA}}
    rows = [json.dumps(full), json.dumps({k: v for k, v in full.items() if k not in ("table", "qa")}), "{}"]
    got = column(spark, rows, audit.missing_fields)
    assert got[0] == [] and got[1] == ["table", "qa", "qa.question", "qa.answer", "qa.program"] and len(got[2]) == 13


# runs


def test_exclusive_quantiles(spark):
    rng = random.Random(6)
    for n in (1, 2, 3, 6, 40, 333):
        xs = [round(rng.uniform(0, 50), 2) for _ in range(n)]
        got = runs.spread(spark.createDataFrame([(x,) for x in xs], "x double"), "x").first()
        q = statistics.quantiles(xs, n=20) if n > 1 else xs * 19
        assert [got.mean, got.median, got.p90, got.p95, got.max] == pytest.approx([round(v, 3) for v in (sum(xs) / n, statistics.median(xs), q[17], q[18], max(xs))], abs=0.0011)
        assert spark.createDataFrame([(sorted(xs),)], "v array<double>").select(runs.exclusive_quantile(F.col("v"), 0.9)).first()[0] == pytest.approx(q[17])
    assert runs.spread(spark.createDataFrame([], "x double"), "x").count() == 0


def test_run_and_resume(spark, tmp_path):
    q = spark.createDataFrame([(str(k), f"q{k}", "ctx") for k in range(6)], "id string, question string, context string").coalesce(1)

    def provider(question, context):
        if question == "q1":
            raise RuntimeError("no luck")
        return {"text": f"Answer: {question}", "input_tokens": 10, "output_tokens": 5}

    got = runs.run(q, provider).collect()
    assert len(got) == 6 and got[1].error == "RuntimeError: no luck" and got[0].raw_response == "Answer: q0"
    assert runs.run(q, lambda a, b: 1 / 0).count() == 4
    io.append_attempts(runs.run(q.where("id < '3'"), provider), str(tmp_path / "a"))
    assert sorted(r.id for r in runs.to_do(q, spark.read.parquet(str(tmp_path / "a"))).collect()) == ["3", "4", "5"]


def test_run_summary(spark):
    rows = [("a", "s1", "IFRS", "gpt-4o", True, True, False, None, 1_000_000, 0, 0), ("b", "s1", "J-GAAP", "unlisted", False, True, True, None, 0, 1_000_000, 1_000_000), ("c", "s2", "IFRS", "gpt-4o", False, False, False, "x", 0, 0, 0)]
    df = spark.createDataFrame(rows, "id string, subtask string, accounting_standard string, model string, correct boolean, parse_success boolean, truncated boolean, error string, input_tokens bigint, output_tokens bigint, thinking_tokens bigint")
    got = {(r.grouping, r.key): r for r in runs.summary(runs.with_cost(df)).collect()}
    whole = got["all", ""]
    assert (whole.total, whole.accuracy_pct, whole.parse_success_pct, whole.error_rate_pct, whole.cost_total_usd, whole.cost_per_correct_usd) == (3, 33.33, 66.67, 33.33, 22.5, 22.5)
    assert got["subtask", "s2"].cost_per_correct_usd is None and len(got) == 5 and runs.summary(runs.with_cost(df.limit(0))).count() == 0


def test_filing_windows(spark):
    rows = [("E1", 1, "2024-06-20", True), ("E1", 2, "2024-07-01", True), ("E1", 3, "2024-08-01", False), ("E1", 4, "2024-03-10", True), ("E2", 5, "2024-12-24", True), ("E3", 6, "2024-01-05", True)]
    f = spark.createDataFrame(rows, "company string, doc_id bigint, d string, has_xbrl boolean").withColumn("filing_date", F.to_date("d"))
    wanted = spark.createDataFrame([(c, "2024") for c in ("E1", "E2", "E3")], "company string, year string")
    assert {r.company: (r.doc_id, r.window) for r in statements.pick_filings(f, wanted).collect()} == {"E1": (2, 0), "E2": (5, 2)}
    assert statements.not_collected(wanted, f.where("company = 'E1'")).count() == 2


def test_filing_windows_of_groups(spark):
    rng = random.Random(9)
    day = datetime.date(2023, 1, 1)
    windows = [(f"g{k % 2500}", k // 2500, rng.randint(1, 12), rng.randint(1, 28), rng.randint(1, 12), rng.randint(1, 28)) for k in range(10_000)]
    table = spark.createDataFrame(windows, "group string, window int, from_month int, from_day int, to_month int, to_day int")
    filings = [(f"E{rng.randrange(80)}", k, day + datetime.timedelta(rng.randrange(1100)), rng.random() < 0.8) for k in range(900)]
    f = spark.createDataFrame([*filings, ("E1", None, None, True), (None, 5, day, True)], "company string, doc_id bigint, filing_date date, has_xbrl boolean")
    wanted = [(f"E{k}", str(y), f"g{k * 31 % 2500}") for k in range(80) for y in (2023, 2024)] + [("E5", None, "g1"), ("E6", "2024", None)]
    got = statements.pick_filings(f, spark.createDataFrame(wanted, "company string, year string, group string"), table)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {}
    for company, year, group in wanted:
        for g, w, a, b, c, d in windows if year else ():
            lo, hi = datetime.date(int(year), a, b), datetime.date(int(year), c, d)
            hi = datetime.date(int(year) + 1, c, d) if hi < lo else hi
            if g == group:
                for key in ((-w, x, i) for own, i, x, data in filings if own == company and data and lo <= x <= hi):
                    want[company, year] = max(want.get((company, year), (-99,)), key)
    assert {(r.company, r.year): (-r.window, r.filing_date, r.doc_id) for r in got.collect()} == want and len(want) > 100


def test_stream(spark, tmp_path):
    from ledgerlark.streaming import score

    q = questions(spark, [("a", "numerical_reasoning", "25.0%"), ("b", "temporal_reasoning", "増収")])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "a", "predicted": "25"}\n{"id": "zz", "predicted": "1"}\n')
    stream = spark.readStream.schema("id string, predicted string").json(str(tmp_path / "in"))
    score.append_verdicts(score.stream_verdicts(stream, q), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    (tmp_path / "in" / "2.json").write_text('{"id": "b", "predicted": "減収"}\n')
    score.append_verdicts(score.stream_verdicts(stream, q), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.question_id: r.correct for r in got.collect()} == {"a": True, "b": False}
    assert {r.subtask: r.accuracy for r in score.running_accuracy(got).collect()} == {"numerical_reasoning": 1.0, "temporal_reasoning": 0.0}


def test_registered_queries():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 140 and set(sql) <= set(queries)
    assert {"j8_q11_near_duplicates"} == {q for q in queries if q not in sql and not q.startswith("op") and q != "pipeline"}


# the whole construction and its commands


LINES = {
    "income_statement": ["売上高", "売上原価", "売上総利益", "販売費及び一般管理費", "営業利益", "経常利益", "当期純利益"],
    "balance_sheet": ["流動資産", "固定資産", "資産合計", "流動負債", "固定負債", "負債合計", "純資産合計"],
    "cash_flow_statement": ["営業活動によるキャッシュ・フロー", "投資活動によるキャッシュ・フロー", "財務活動によるキャッシュ・フロー"],
}


def raw_folder(path, companies=6):
    path.mkdir(parents=True)
    for c in range(companies):
        filings = {}
        for y in ("2022", "2023", "2024"):
            rng = random.Random(f"{c}-{y}")
            filings[y] = {"filing": {"doc_id": f"S{c}{y}", "edinet_code": f"E{c}", "doc_type": "120", "company_name": f"Company {c}"}, "accounting_standard": "IFRS", **{s: [{"科目": label, "当期": rng.randrange(10**9, 10**11)} for label in labels] for s, labels in LINES.items()}}
        (path / f"E{c}.json").write_text(json.dumps({"company": {"edinet_code": f"E{c}", "name": f"Company {c}", "gaap": ["IFRS", "J-GAAP"][c % 2]}, "filings": filings}, ensure_ascii=False))


def test_build_in_one_call_and_stage_by_stage(spark, tmp_path):
    raw_folder(tmp_path / "a" / "raw")
    raw_folder(tmp_path / "b" / "raw")
    assert cli.main(["build", "--data-dir", str(tmp_path / "a")], spark) == 0
    for stage in ("2", "3", "4"):
        assert cli.main(["build", "--stage", stage, "--data-dir", str(tmp_path / "b")], spark) == 0
    final = {x: sorted(tuple(r) for r in io.load_final(spark, str(tmp_path / x / "final" / "questions")).select("id", "subtask", "edinet_code", "qa.question", "qa.answer").collect()) for x in "ab"}
    assert final["a"] == final["b"]
    generated = io.load_generated(spark, str(tmp_path / "a" / "generated"))
    assert generated.count() > 200 and io.load_contexts(spark, str(tmp_path / "a" / "contexts")).count() == 30
    told = json.loads((tmp_path / "a" / "final" / "stats.json").read_text())
    rejected = io.load_rejected(spark, str(tmp_path / "a" / "final" / "rejected")).count()
    assert told["total_questions"] == len(final["a"]) > 100 and told["total_rejected"] == rejected and told["unique_companies"] == 6 and sum(told["by_subtask"].values()) == told["total_questions"]
    # what is left after validation, one by one: the greedy rule in the order of companies, contexts and templates
    rows = generated.orderBy("edinet_code", "pos", "template_no").collect()
    flat = spark.createDataFrame([(k, r.qa.question, r.qa.answer, r.qa.program, r.qa.gold_evidence) for k, r in enumerate(rows)], "pos int, question string, answer string, program array<string>, gold_evidence array<bigint>")
    passed = [r.pos for r in validate.validate(flat).orderBy("pos").collect() if r.reason == ""]
    kept = greedy([(k, rows[k].qa.question, rows[k].subtask, rows[k].edinet_code) for k in passed])
    assert sorted(rows[k].qa.question for k in kept) == sorted(q for *_, q, _ in final["a"])
    assert len(passed) + rejected == len(rows)
    ids = [i for i, *_ in final["a"]]
    assert len(set(ids)) == len(ids) and {i[:3] for i in ids} == {"nr_", "cc_", "tr_"}


def test_commands(spark, tmp_path, capsys):
    raw_folder(tmp_path / "raw", 3)
    assert cli.main(["integrity", "-d", str(tmp_path / "raw")], spark) == 0 and "3 files, 0 violations" in capsys.readouterr().out
    cli.main(["build", "--data-dir", str(tmp_path)], spark)
    questions_at, out = str(tmp_path / "final" / "questions"), tmp_path / "out"
    assert cli.main(["audit", "-d", questions_at, "-o", str(out)], spark) in (0, 1)
    told = json.loads((out / "audit_report.json").read_text())
    n = io.load_final(spark, questions_at).count()
    assert {r["value"] for r in told["distribution"] if r["measure"] == "total"} == {n} and set(told["counts"]) == {*audit.BASIC, "affected ids"}
    assert "Deep audit report" in (out / "audit_quality_report.md").read_text() and set(json.loads((out / "audit_quality_report.json").read_text())["counts"]) == {*audit.DEEP, "affected ids"}
    assert cli.main(["lite", "-d", questions_at, "-o", str(tmp_path / "lite")], spark) == 0
    manifest = json.loads((tmp_path / "lite" / "manifest.json").read_text())
    assert len(manifest["row_indices"]) == validate.LITE_CAP * 3 == io.load_final(spark, str(tmp_path / "lite" / "questions")).count() and manifest["per_company_cap"] == validate.LITE_CAP
    capsys.readouterr()
    assert cli.main(["publish", "-d", questions_at, "-o", str(tmp_path / "flat")], spark) == 0
    assert f"all: {n} questions" in capsys.readouterr().out and io.load_table(spark, str(tmp_path / "flat"), "all").count() == n
    assert cli.main(["inspect", "-d", questions_at, "-n", "2"], spark) == 0 and capsys.readouterr().out.count("Question: ") == 2
    for limit in ("5", "8"):  # the second run asks only what is new
        assert cli.main(["run", "--model", "gpt-4o", "--regime", "R1", "--provider", "test_engine:right", "-d", questions_at, "-n", limit, "-o", str(tmp_path / "runs")], spark) == 0
    told = json.loads((tmp_path / "runs" / "gpt-4o__R1__metrics.json").read_text())
    assert told["n"] == 8 == spark.read.parquet(str(tmp_path / "runs" / "gpt-4o__R1__attempts")).count() and told["regime"] == "R1"
    assert told["summary"]["parse_success_pct"] == 100.0 and told["summary"]["output_tokens"]["max"] == 8192 and told["summary"]["cost_total_usd"] > 0


def right(model, system, prompt, settings):
    assert model == "gpt-4o" and system.startswith("You are") and "質問: " in prompt
    return {"text": "Answer: 1", "input_tokens": 10, "output_tokens": settings["max_output"]}


def test_repeated_predictions_the_last_counts(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"a": "z", "b": "2", "a": "1"}')
    got = evaluate.bind(questions(spark, [("a", "s", "1"), ("b", "s", "2"), ("c", "s", "3")]), io.load_predictions(spark, str(tmp_path / "p.json")))
    assert {r.id: r.predicted for r in got.collect()} == {"a": "1", "b": "2", "c": ""}


def test_json_lines_are_not_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n\n  [1,\n {\"x\": \"[\"}]\n")
    (tmp_path / "b.json").write_text('﻿\n{"x": 1}\n\n[2]\n')
    (tmp_path / "c d.json").write_text('﻿[{"y": 3}]')
    (tmp_path / "e.json").write_text("\n \n")
    got = {}
    for r in io.json_rows(spark, str(tmp_path)).orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[1].replace("%20", " "), []).append(r.value)
    assert got == {"a.json": ["1", '{"x":"["}'], "b.json": ['{"x": 1}', "[2]"], "c d.json": ['{"y":3}']}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from ledgerlark import scratch

    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        scratch.new_folder(Cluster())


def test_literals_give_the_number_back(spark):
    rng = random.Random(15)
    xs = [rng.uniform(-1e6, 1e6) for _ in range(200)] + [rng.randrange(10**12) / 1e6 for _ in range(200)] + [0.1 + 0.2, 1e15, 619.9856200000001, 0.0, 0.001]
    assert [float(t) for t in column(spark, xs, N.literal, "double")] == xs and not any("E" in t for t in column(spark, xs, N.literal, "double"))
