"""Queries of text functions, scoring, programs, rendering and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import numbers as N
from ledgerlark.functions import render as R
from ledgerlark.functions import text as T
from ledgerlark.operators import evaluate as E
from ledgerlark.operators import program as P
from ledgerlark.operators import runs
from ledgerlark.operators import validate as V
from ledgerlark.plans.registry import query
from ledgerlark.schema import PRICES, UNKNOWN_PRICE

# SQL twins of the text functions, for the characters that the derived answers hold.
WIDE, NARROW = "０１２３４５６７８９％", "0123456789%"


def norm(x: str) -> str:
    s = f"regexp_replace(translate(trim({x}), '{WIDE}', '{NARROW}'), '^[△▲]', '-')"
    return f"trim(lower(regexp_replace(regexp_replace({s}, '([0-9]),([0-9])', '\\1\\2', 'g'), '(しました|した)$', '')))"


def number(n: str) -> str:
    """Of a normalised answer."""
    s = n
    for unit in T.UNITS:
        s = f"regexp_replace({s}, '{unit}$', '')"
    factor = " ".join(f"WHEN contains({s}, '{sign}') THEN {float(by)}" for sign, by in T.MULTIPLIERS)
    return f"(TRY_CAST(regexp_replace({s}, '[^0-9.+-]', '', 'g') AS DOUBLE) * CASE {factor} ELSE 1.0 END)"


def match(p: str, g: str) -> str:
    return f"CASE WHEN {number(p)} IS NULL OR {number(g)} IS NULL THEN {p} = {g} WHEN {number(g)} = 0 THEN {number(p)} = 0 ELSE abs({number(p)} - {number(g)}) / abs({number(g)}) <= 0.01 END"


NORMAL = f"n AS (SELECT *, {norm('predicted')} AS p, {norm('gold')} AS g FROM answers)"
VERDICT = f"WITH {NORMAL}, v AS (SELECT id, subtask, company, gold, predicted, p, g, {match('p', 'g')} AS correct FROM n)"


@query("n1_normalize_answer", f"SELECT id, {norm('predicted')} AS normal FROM answers", "answers")
def _(a):
    return a.select("id", T.normalize_answer("predicted").alias("normal"))


@query("n2_extract_number", f"WITH {NORMAL} SELECT id, {number('p')} AS number FROM n", "answers")
def _(a):
    return a.select("id", T.extract_number("predicted").alias("number"))


@query("n3_exact_match", f"WITH {NORMAL} SELECT id, p = g AS correct FROM n", "answers")
def _(a):
    return a.select("id", T.exact_match("predicted", "gold").alias("correct"))


@query("n4_numerical_match", f"{VERDICT} SELECT id, correct FROM v", "answers")
def _(a):
    return E.verdicts(a).select(F.col("question_id").alias("id"), "correct")


@query("n5_harness_twins", f"{VERDICT} SELECT id, p = g AS exact, correct AS numerical FROM v", "answers")
def _(a):
    own = a.select("id", T.normalize_answer("predicted").alias("p"), T.normalize_answer("gold").alias("g"))
    own = own.select("*", T.number_of(F.col("p")).alias("x"), T.number_of(F.col("g")).alias("y"))  # read once, in a projection of their own
    return own.select("id", (F.col("p") == F.col("g")).alias("exact"), T.match_numbers(F.col("p"), F.col("g"), F.col("x"), F.col("y")).alias("numerical"))


def _wrapped(a):
    p = F.col("predicted")
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Reasoning\nAnswer: "), p, F.lit("\nmore"))).when(F.col("id") % 4 == 1, F.concat(F.lit("回答： "), p)).when(F.col("id") % 4 == 2, F.concat(F.lit("first\n\n"), p, F.lit("\n \n"))).otherwise(p)
    return a.withColumn("response", text)


@query("n6_harness_answer", "SELECT id, trim(predicted) AS answer FROM answers", "answers")
def _(a):
    return _wrapped(a).select("id", T.harness_answer("response").alias("answer"))


@query("n7_tagged_answer", "SELECT id, CASE WHEN id % 4 = 1 THEN trim(concat('回答： ', predicted)) ELSE trim(predicted) END AS answer, id % 4 = 0 AS parsed FROM answers", "answers")
def _(a):
    return _wrapped(a).select("id", T.tagged_answer("response").alias("x")).select("id", F.col("x.predicted").alias("answer"), "x.parsed")


@query("n8_harness_score", f"{VERDICT} SELECT id, CAST(p = g AS DOUBLE) AS exact_match, CAST(correct AS DOUBLE) AS numerical_match FROM v", "answers")
def _(a):
    return T.with_harness_score(_wrapped(a).select("id", "response", "gold"), "response", "gold").select("id", "exact_match", "numerical_match")


def vnorm(x: str) -> str:
    return f"lower(replace(translate(trim({x}), '{WIDE}△▲', '{NARROW}--'), ',', ''))"


def vnumber(x: str) -> str:
    s = vnorm(x)
    for unit in T.VALIDATOR_UNITS:
        s = f"replace({s}, '{unit}', '')"
    return f"TRY_CAST(regexp_extract({s}, '-?[0-9]+[.]?[0-9]*') AS DOUBLE)"


@query("n9_validator_normalize", f"SELECT id, {vnorm('predicted')} AS normal FROM answers", "answers")
def _(a):
    return a.select("id", T.validator_normalize("predicted").alias("normal"))


@query("n10_validator_match", f"WITH n AS (SELECT id, {vnorm('predicted')} AS p, {vnorm('gold')} AS g, {vnumber('predicted')} AS x, {vnumber('gold')} AS y FROM answers) SELECT id, CASE WHEN x IS NULL OR y IS NULL THEN p = g WHEN y = 0 THEN abs(x) < 0.001 ELSE abs(x - y) / abs(y) <= 0.05 END AS correct FROM n", "answers")
def _(a):
    return a.select("id", T.validator_match("predicted", "gold").alias("correct"))


def anumber(x: str) -> str:
    return f"TRY_CAST(replace(regexp_extract({x}, '-?[0-9,]+[.]?[0-9]*'), ',', '') AS DOUBLE)"


_ROUNDED = "CAST(CASE d WHEN 0 THEN format('{:.0f}', x) ELSE format('{:.1f}', x) END AS DOUBLE)"


@query("n11_audit_match", f"{VERDICT}, r AS (SELECT id, correct, {anumber('predicted')} AS x, {anumber('gold')} AS y, CAST(length(regexp_extract(gold, '-?[0-9,]+[.]([0-9]+)', 1)) AS INT) AS d FROM v) SELECT id, correct OR coalesce(abs({_ROUNDED} - y) < 0.5 * pow(10.0, -d) + 1e-9, false) AS correct FROM r", "answers")
def _(a):
    return T.with_audit_match(a, "predicted", "gold", "correct").select("id", "correct")


def cnumber(x: str) -> str:
    s = f"replace(replace(regexp_replace(trim({x}), '^[△▲]', ''), ',', ''), ' ', '')"
    for unit in T.CELL_UNITS:
        s = f"regexp_replace({s}, '{unit}$', '')"
    s = f"translate({s}, '{WIDE[:10]}', '{NARROW[:10]}')"
    return f"CASE WHEN regexp_matches(trim({x}), '^[△▲]') THEN -1 ELSE 1 END * TRY_CAST({s} AS DOUBLE)"


@query("n12_cell_number", f"SELECT id, {cnumber('gold')} AS number FROM answers", "answers")
def _(a):
    return a.select("id", T.cell_number("gold").alias("number"))


@query("n13_near", "SELECT id, a = b * 1000 OR CASE WHEN b = 0 THEN a <= 0.5 ELSE abs(a - b * 1000) * 1.0 / abs(b * 1000) <= 0.02 * k OR abs(a - b * 1000) <= 0.5 END AS near FROM programs", "programs")
def _(p):
    a, b = F.col("a").cast("double"), F.col("b") * 1000.0
    tests = F.coalesce(*(F.when(F.col("k") == k, T.near(a, b, 0.02 * k)) for k in range(11)))
    return p.select("id", tests.alias("near"))


# numbers to text

CELL = "concat(CASE WHEN x < 0 THEN '△' ELSE '' END, CASE WHEN abs(x) = floor(abs(x)) THEN format('{:,.0f}', abs(x)) ELSE format('{:,.1f}', abs(x)) END)"


@query("x1_cell", f"SELECT company, year, label, {CELL} AS cell FROM (SELECT *, value / 1000 AS x FROM facts)", "facts")
def _(f):
    return f.select("company", "year", "label", N.cell(F.col("value"), 1000).alias("cell"))


@query("x2_answer_formats", "SELECT id, format('{:.1f}%', x) AS p1, format('{:.2f}%', x) AS p2, concat(format('{:,.0f}', x * 1000), '百万円') AS money, concat(format('{:.1f}', x - 50), 'ポイント') AS points, concat(format('{:.2f}', x), '倍') AS times FROM (SELECT id, a / (b * 1000.0) AS x FROM programs)", "programs")
def _(p):
    x = F.col("a") / (F.col("b") * F.lit(1000.0))
    return p.select("id", N.percent(x).alias("p1"), N.percent(x, 2).alias("p2"), N.money(x * 1000, "百万円").alias("money"), N.points(x - 50).alias("points"), N.times(x).alias("times"))


@query("x3_literal", "SELECT id, CAST(a / 1000.0 AS VARCHAR) AS literal FROM (SELECT id, CAST(a AS DOUBLE) AS a FROM programs)", "programs")
def _(p):
    return p.select("id", N.literal(F.col("a").cast("double") / 1000).alias("literal"))


@query("k1_direction", "SELECT id, CASE WHEN k = 0 THEN 'であった' WHEN b - 3 = 0 THEN CASE WHEN a % 3 - 1 > 0 THEN 'で増加した' WHEN a % 3 - 1 = 0 THEN 'でほぼ横ばいであった' ELSE 'で減少した' END WHEN abs((a % 300 - b) * 1.0) / abs(b) < 0.005 THEN 'でほぼ横ばいであった' WHEN a % 300 > b THEN 'で増加した' ELSE 'で減少した' END AS direction FROM programs", "programs")
def _(p):
    zero = F.col("b") == 3
    cur, prev = F.when(zero, F.col("a") % 3 - 1).otherwise(F.col("a") % 300).cast("double"), F.when(F.col("k") != 0, F.when(zero, 0).otherwise(F.col("b"))).cast("double")
    return p.select("id", N.direction(cur, prev).alias("direction"))


#: Every word of the validator's lists, in the forms in which answers hold them, and words of neither list.
_WORDS = (*N.VALIDATOR_TRUE, *N.VALIDATOR_FALSE, "TRUE", "No", "改善した", "減少しました", " はい ", "Consistent", "普通", "0")
_WORD = f"list_extract([{', '.join(f"'{w}'" for w in _WORDS)}], CAST(1 + b % {len(_WORDS)} AS BIGINT))"
_VALID = "CASE {} ELSE w END".format(" ".join(f"WHEN w IN ({', '.join(f"'{x}'" for x in own)}) THEN '{told}'" for own, told in ((N.VALIDATOR_TRUE, "true"), (N.VALIDATOR_FALSE, "false"))))


@query("k4_boolean_answers", f"SELECT id, {_VALID} AS answer FROM (SELECT id, {norm(_WORD)} AS w FROM programs)", "programs")
def _(p):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("b") % len(_WORDS) + 1).cast("int"))
    return p.select("id", N.boolean_answer(T.normalize_answer(word)).alias("answer"))


@query("k5_period", "SELECT DISTINCT concat(year, '年3月期') AS period FROM facts", "facts")
def _(f):
    return f.select(N.period(F.col("year")).alias("period")).distinct()


@query("k6_falsy_zero", "SELECT company, year, label, CASE WHEN value = 0 THEN NULL ELSE value END AS value, value <> 0 AS truthy FROM facts", "facts")
def _(f):
    return f.select("company", "year", "label", N.or_else(F.col("value"), F.lit(None).cast("double")).alias("value"), N.truthy(F.col("value")).alias("truthy"))


# rendering


def _table(p, *more):
    headers = F.when(F.col("k") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(""), F.lit("2024"), F.lit("2023")))
    rows = F.when(F.col("k") % 5 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("r"), F.col("a").cast("string"), F.col("b").cast("string")), F.array(F.lit("s"), F.col("b").cast("string"), F.lit("△1"))))
    pre = F.when(F.col("k") == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("before"), F.concat(F.lit("no "), F.col("id").cast("string"))))
    post = F.when(F.col("k") == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("after")))
    return p.select("id", "k", headers.alias("headers"), rows.alias("rows"), pre.alias("pre"), post.alias("post"), F.concat(F.lit("How much is "), F.col("a").cast("string"), F.lit("?")).alias("question"), *more)


_HEAD = "'|  | 2024 | 2023 |' || chr(10) || '| --- | --- | --- |'"
_ROWS = "CASE WHEN k % 5 = 0 THEN '' ELSE chr(10) || '| r | ' || a || ' | ' || b || ' |' || chr(10) || '| s | ' || b || ' | △1 |' END"
MARK = f"CASE WHEN k = 0 THEN '' ELSE {_HEAD} || {_ROWS} END"
CTX = f"concat_ws(chr(10) || chr(10), CASE WHEN k <> 3 THEN 'before' || chr(10) || 'no ' || id END, CASE WHEN k <> 0 THEN {MARK} END, CASE WHEN k <> 4 THEN 'after' END)"
ASK = "'How much is ' || a || '?'"


@query("p1_p2_grid_round_trip", f"SELECT id, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 3 END AS BIGINT) AS grid_rows, {MARK} AS markdown FROM programs", "programs")
def _(p):
    t = _table(p).withColumn("g", R.grid(F.col("headers"), F.col("rows")))
    return t.select("id", F.size("g").cast("bigint").alias("grid_rows"), R.markdown(R.grid_headers(F.col("g")), R.grid_rows(F.col("g"))).alias("markdown"))


@query("p3_markdown", f"SELECT id, {MARK} AS markdown FROM programs", "programs")
def _(p):
    return _table(p).select("id", R.markdown(F.col("headers"), F.col("rows")).alias("markdown"))


@query("p4_counts", "SELECT id, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS BIGINT) AS num_rows, CAST(CASE WHEN k = 0 THEN 0 ELSE 3 END AS BIGINT) AS num_cols FROM programs", "programs")
def _(p):
    return _table(p).select("id", F.size("rows").cast("bigint").alias("num_rows"), F.size("headers").cast("bigint").alias("num_cols"))


@query("p5_context", f"SELECT id, {CTX} AS context FROM programs", "programs")
def _(p):
    return _table(p).select("id", R.context(F.col("pre"), F.col("headers"), F.col("rows"), F.col("post")).alias("context"))


@query("p6_grid_questions", f"SELECT id, {ASK} AS question, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 3 END AS BIGINT) AS grid_rows, 'numerical_reasoning' AS subtask FROM programs", "programs")
def _(p):
    from ledgerlark.sources import io

    t = _table(p)
    nested = t.select(F.col("id").cast("string").alias("id"), F.lit("temporal_reasoning").alias("subtask"), F.col("pre").alias("pre_text"), F.col("post").alias("post_text"), F.struct("headers", "rows").alias("table"), F.struct("question", F.array(F.lit("add(1, 2)")).alias("program"), F.lit("3").alias("answer"), F.array(F.lit(0).cast("bigint")).alias("gold_evidence")).alias("qa"))
    grid = io.to_grid_rows(nested)
    back = io.from_grid_rows(grid)
    return back.join(grid.select("id", F.size("table").cast("bigint").alias("grid_rows")), "id").select(F.col("id").cast("bigint").alias("id"), F.col("qa.question").alias("question"), "grid_rows", "subtask")


def _prompt_sql() -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    cases = []
    for k, t in enumerate(R.PROMPTS.values()):
        cases.append(f"WHEN {k} THEN replace(replace({lit(t)}, '{{context}}', {CTX}), '{{question}}', {ASK})")
    return f"CASE id % 4 {' '.join(cases)} ELSE replace(replace({lit(R.NUMERICAL_PROMPT)}, '{{context}}', {CTX}), '{{question}}', {ASK}) END"


@query("p7_prompt", f"SELECT id, {_prompt_sql()} AS prompt FROM programs", "programs")
def _(p):
    t = _table(p)
    subtask = F.coalesce(*(F.when(F.col("id") % 4 == k, s) for k, s in enumerate(R.PROMPTS)), F.lit("other"))
    return t.select("id", R.prompt(subtask, F.col("question"), R.context(F.col("pre"), F.col("headers"), F.col("rows"), F.col("post"))).alias("prompt"))


@query("p8_harness_prompt", f"SELECT id, CASE WHEN {CTX} = '' THEN '' ELSE {CTX} || chr(10) || chr(10) END || 'Question: ' || {ASK} || chr(10) || 'Answer:' AS prompt FROM programs", "programs")
def _(p):
    return _table(p).select("id", R.harness_prompt(*(F.col(c) for c in ("pre", "headers", "rows", "post", "question"))).alias("prompt"))


@query("p9_run_prompt", f"SELECT id, '以下の財務データを読み、質問に答えてください。' || chr(10) || chr(10) || {CTX} || chr(10) || chr(10) || '質問: ' || {ASK} || chr(10) || chr(10) || '計算過程を示した後、最終行に「Answer: 値」の形式で答えを出力してください。' AS prompt FROM programs", "programs")
def _(p):
    t = _table(p)
    return t.select("id", R.run_prompt(F.col("question"), R.context(F.col("pre"), F.col("headers"), F.col("rows"), F.col("post"))).alias("prompt"))


@query("p12_template_fill", "SELECT id, concat('x ', a, ' of ', b) AS filled, '{missing}' AS kept FROM programs", "programs")
def _(p):
    return p.select("id", R.fill("x {a} of {b}", a=F.col("a").cast("string"), b=F.col("b").cast("string")).alias("filled"), R.fill("{missing}", a=F.col("a")).alias("kept"))


# scoring

_ACC = f"{VERDICT}, s AS (SELECT subtask, count(*) AS total, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM v GROUP BY subtask UNION ALL SELECT NULL, count(*), CAST(coalesce(sum(CASE WHEN correct THEN 1 ELSE 0 END), 0) AS BIGINT) FROM v)"


@query("a1_accuracy", f"{_ACC} SELECT subtask, total, correct, coalesce(correct * 1.0::DOUBLE / nullif(total, 0), 0.0::DOUBLE) AS accuracy FROM s", "answers")
def _(a):
    return E.accuracy(E.verdicts(a))


@query("p10_summary", f"{_ACC} SELECT CASE WHEN subtask IS NULL THEN 'Overall: ' ELSE concat('  ', subtask, ': ') END || format('{{:.1f}}', 100.0::DOUBLE * correct / total) || '% (' || correct || '/' || total || ')' AS line FROM s", "answers")
def _(a):
    return E.summary_lines(E.accuracy(E.verdicts(a))).where("k IN (2, 4)").select("line")


@query("a2_harness_aggregate", f"{VERDICT} SELECT subtask, sum(CAST(p = g AS DOUBLE)) / count(*) AS exact_match, sum(CAST(correct AS DOUBLE)) / count(*) AS numerical_match, count(*) AS size FROM v GROUP BY GROUPING SETS ((), (subtask))", "answers")
def _(a):
    return E.harness(_wrapped(a))


@query("j1_bind_predictions", "SELECT a.id, subtask, gold, coalesce(p.predicted, '') AS predicted FROM answers a LEFT JOIN (SELECT id, arg_max(predicted, predicted) AS predicted FROM answers WHERE id % 3 <> 0 GROUP BY id) p ON a.id = p.id", "answers")
def _(a):
    # earlier predictions of the same ids, none of which counts, and some of ids that no question has
    own = a.where("id % 3 <> 0")
    at = F.row_number().over(Window.partitionBy("id").orderBy("predicted")).cast("bigint")
    made = own.select(at.alias("pos"), "id", "predicted").unionByName(own.select(F.lit(0).cast("bigint").alias("pos"), "id", F.lit("~earlier").alias("predicted")))
    made = made.unionByName(a.select(F.lit(1).cast("bigint").alias("pos"), (-F.col("id")).alias("id"), "predicted"))
    return E.bind(a.select("id", "subtask", "gold"), made).select("id", "subtask", "gold", "predicted")


@query("u2_jaccard", "WITH s AS (SELECT id, list_distinct(list_transform(range(1, length(CAST(a AS VARCHAR)) - 1), lambda i: substr(CAST(a AS VARCHAR), CAST(i AS INT), 3))) AS x, list_distinct(list_transform(range(1, length(CAST(a * 7 AS VARCHAR)) - 1), lambda i: substr(CAST(a * 7 AS VARCHAR), CAST(i AS INT), 3))) AS y FROM programs) SELECT id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END AS jaccard FROM s", "programs")
def _(p):
    return p.select("id", V.ngrams(F.col("a").cast("string")).alias("x"), V.ngrams((F.col("a") * 7).cast("string")).alias("y")).select("id", V.jaccard(F.col("x"), F.col("y")).alias("jaccard"))


@query("u3_distinct", "SELECT DISTINCT subtask, company % 10 AS bucket FROM answers", "answers")
def _(a):
    return a.select("subtask", (F.col("company") % 10).alias("bucket")).distinct()


@query("model_hook", "SELECT id, concat(CAST(a AS VARCHAR), '!') AS predicted FROM programs", "programs")
def _(p):
    return E.ask(p.select("id", F.col("a").cast("string").alias("question"), F.lit("").alias("context")), lambda q, c: f"{q}!").select("id", "predicted")


# programs


def _program(name, steps, value, kind="number", where="true"):
    """A query that runs one program a row and its SQL value."""
    text = "text" if kind == "bool" else "number"
    shown = f"CASE WHEN {value} THEN 'true' ELSE 'false' END" if kind == "bool" else f"CAST({value} AS DOUBLE)"

    @query(name, f"SELECT id, {shown} AS result FROM programs WHERE {where}", "programs")
    def _(p):
        made = F.array(*(F.expr(f"format_string('{s}', a, b)") if "%" in s else F.lit(s) for s in steps))
        return p.where(where).select("id", P.execute(made).alias("r")).select("id", F.col(f"r.{text}").alias("result"))


_program("d1_arithmetic", ["add(%1$d, %2$d)", "subtract(#0, 17)", "multiply(#1, 3)"], "(a + b - 17) * 3")
_program("d2_divide", ["divide(%1$d, %2$d)", "divide(#0, 0.5)"], "a::DOUBLE / b / 0.5")
_program("d2_divide_by_zero", ["subtract(%2$d, 48)", "divide(%1$d, #0)"], "CASE WHEN b = 48 THEN 'inf'::DOUBLE ELSE a / (b - 48)::DOUBLE END")
_program("d3_exp", ["exp(%2$d, 2)"], "b * b")
_program("d4_greater", ["multiply(%2$d, 1000)", "greater(%1$d, #0)"], "a > b * 1000", "bool")
_program("d4_less", ["multiply(%2$d, 1000)", "less(%1$d, #0)"], "a < b * 1000", "bool")
_program("d5_eq", ["divide(%2$d, 48500)", "eq(#0, 0.0)"], "abs(b / 48500.0::DOUBLE - 0.0::DOUBLE) < 0.001", "bool")
_program("d5_not_eq", ["multiply(%2$d, 0.0001)", "subtract(%1$d, #0)", "eq(#1, %1$d)"], "abs((a - b * 0.0001::DOUBLE) - a) < 0.001", "bool")
_program("d6_min_max", ["max(%1$d, %2$d, 50000)", "min(#0, 90000, 80000)"], "least(greatest(a, b, 50000), 80000)")
_program("d7_abs_round", ["subtract(%2$d, %1$d)", "abs(#0)", "divide(#1, 4)", "round(#2, 0)"], "CAST(format('{:.0f}', abs(b - a) / 4.0::DOUBLE) AS DOUBLE)")
_program("d9_arguments", ["add(true, %1$d)", "multiply(#0, 1.50)"], "(a + 1) * 1.5")

_BROKEN = ("add(1, 2", "frobnicate(1, 2)", "add(#5, 1)", "subtract(a, b)", "")


@query("d8_d11_errors", "SELECT id, CASE k % 5 WHEN 0 THEN 'cannot parse' WHEN 1 THEN 'unknown operation' WHEN 2 THEN 'argument error' WHEN 3 THEN 'execution error' ELSE 'Empty program' END AS error FROM programs", "programs")
def _(p):
    step = F.coalesce(*(F.when(F.col("k") % 5 == k, F.when(F.lit(k == 4), F.array().cast("array<string>")).otherwise(F.array(F.lit(s)))) for k, s in enumerate(_BROKEN)))
    told = F.regexp_extract("r.error", "(cannot parse|unknown operation|argument error|execution error|Empty program)", 1)
    return p.select("id", P.execute(step).alias("r")).select("id", told.alias("error"))


@query("d10_nested_arguments", "SELECT id, concat('f(', a, ', ', b, ')x') AS result FROM programs", "programs")
def _(p):
    made = F.array(F.format_string("add(f(%d, %d), x)", "a", "b"))
    return p.select("id", P.execute(made).alias("r")).select("id", F.col("r.text").alias("result"))


@query("d12_last_pair", "SELECT id, 0.001::DOUBLE AS a, CASE WHEN k = 1 THEN 1 / 3000.0::DOUBLE ELSE a + 2.0::DOUBLE END AS b FROM programs WHERE k <> 2 UNION ALL SELECT id, NULL, NULL FROM programs WHERE k = 2", "programs")
def _(p):
    made = F.when(F.col("k") == 2, F.array(F.lit("add(1, 2)"))).otherwise(F.array(F.lit("divide(1, 1000)"), F.when(F.col("k") == 1, "divide(1, 3000)").otherwise(F.format_string("add(%d, 2)", "a")), F.lit("eq(#0, #1)")))
    return p.select("id", P.last_pair(made).alias("x")).select("id", "x.a", "x.b")


# runs

_COST = "coalesce(CASE model {} END, {})"


def _price(k: int) -> str:
    return _COST.format(" ".join(f"WHEN '{m}' THEN {p[k]}::DOUBLE" for m, p in PRICES.items()), f"{UNKNOWN_PRICE[k]}::DOUBLE")


COST = f"input_tokens * {_price(0)} / 1000000 + output_tokens * {_price(1)} / 1000000 + thinking_tokens * {_price(2)} / 1000000"


@query("j5_cost", f"SELECT id, round({COST}, 9) AS cost_usd FROM attempts", "attempts")
def _(a):
    return runs.with_cost(a).select("id", F.round("cost_usd", 9).alias("cost_usd"))


@query("j6_resume", "SELECT id FROM attempts WHERE id % 5 <> 0", "attempts")
def _(a):
    return runs.to_do(a.select("id"), a.where("id % 5 = 0"))


@query("a3_run_summary", f"""SELECT CASE WHEN grouping(subtask) = 1 AND grouping(accounting_standard) = 1 THEN 'all' WHEN grouping(subtask) = 0 THEN 'subtask' ELSE 'accounting_standard' END AS grouping, coalesce(subtask, accounting_standard, '') AS key, count(*) AS total,
 round(100.0::DOUBLE * sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*), 2) AS accuracy_pct, round(100.0::DOUBLE * sum(CASE WHEN parse_success THEN 1 ELSE 0 END) / count(*), 2) AS parse_success_pct,
 round(100.0::DOUBLE * sum(CASE WHEN truncated THEN 1 ELSE 0 END) / count(*), 2) AS truncation_rate_pct, round(100.0::DOUBLE * sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) / count(*), 2) AS error_rate_pct, round(sum({COST}), 4) AS cost_total_usd, round(sum({COST}) / nullif(sum(CASE WHEN correct THEN 1 ELSE 0 END), 0), 4) AS cost_per_correct_usd FROM attempts GROUP BY GROUPING SETS ((), (subtask), (accounting_standard))""", "attempts")
def _(a):
    return runs.summary(runs.with_cost(a))


def _quantile(p: float) -> str:
    """By the exclusive method in twentieths, whole numbers throughout."""
    i = round(p * 20)
    j = f"greatest(1, least({i} * (n + 1) // 20, n - 1))"
    return f"(list_extract(l, {j}) * (20 - ({i} * (n + 1) - 20 * {j})) + list_extract(l, {j} + 1) * ({i} * (n + 1) - 20 * {j})) / 20"


@query("a4_distribution", f"SELECT CAST(format('{{:.3f}}', list_sum(l) / n) AS DOUBLE) AS mean, CAST(format('{{:.3f}}', median(x)) AS DOUBLE) AS median, CAST(format('{{:.3f}}', {_quantile(0.9)}) AS DOUBLE) AS p90, CAST(format('{{:.3f}}', {_quantile(0.95)}) AS DOUBLE) AS p95, CAST(format('{{:.3f}}', list_max(l)) AS DOUBLE) AS max FROM (SELECT list_sort(list(latency_s)) AS l, count(*) AS n FROM attempts), (SELECT latency_s AS x FROM attempts) GROUP BY l, n", "attempts")
def _(a):
    return runs.spread(a, "latency_s")
