"""Audits of a question set: schema, programs against answers, duplicates, table identities, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import numbers as N
from ledgerlark.functions import text as T
from ledgerlark.operators import program as P
from ledgerlark.operators.ratio import RATIO_TILE, ratios_of
from ledgerlark.operators.similar import in_tiles
from ledgerlark.scratch import discard, store
from ledgerlark.ship import by_value

by_value(__name__)

REQUIRED = ("company_name", "edinet_code", "source_doc_id", "filing_year", "accounting_standard", "subtask", "pre_text", "table", "post_text", "qa")
REQUIRED_QA = ("question", "answer", "program")
SIMILAR = 0.90
COST, SALES, GROSS, EXPENSES, OPERATING = "売上原価", "売上高", "売上総利益", "販売費及び一般管理費", "営業利益"
NET, PARENT, MINORITY = "当期純利益", "親会社株主に帰属する当期純利益", "非支配株主に帰属する当期純利益"
CURRENT, FIXED, ASSETS, DEBT, LONG_DEBT, EQUITY = "流動資産", "固定資産", "資産合計", "流動負債", "固定負債", "純資産合計"
LABELS = (SALES, COST, GROSS, EXPENSES, OPERATING, NET, PARENT, MINORITY, CURRENT, FIXED, ASSETS, DEBT, LONG_DEBT, EQUITY)


def missing_fields(json_row: Column) -> Column:
    """Required keys that a JSON object lacks, top level first, those of ``qa`` as ``qa.key``. A present null is present."""
    keys, qa = F.json_object_keys(json_row), F.json_object_keys(F.get_json_object(json_row, "$.qa"))
    def absent(name, shown, have):
        return F.when(~F.coalesce(F.array_contains(have, name), F.lit(False)), shown)

    return F.filter(F.array(*(absent(k, k, keys) for k in REQUIRED), *(absent(k, f"qa.{k}", qa) for k in REQUIRED_QA)), lambda x: x.isNotNull())


def program_findings(rows: DataFrame) -> DataFrame:
    """``idx, finding`` of rows ``(idx, program, answer)``: ``dsl_unparsable`` or ``dsl_mismatch``."""
    ran = rows.select("idx", P.execute(F.col("program")).alias("_r"), F.coalesce("answer", F.lit("")).alias("_gold")).withColumn("_text", F.col("_r.text"))
    ran = T.with_audit_match(ran, "_text", "_gold", "_same")
    r, gold = F.col("_r"), F.col("_gold")
    wrong = F.when(r["kind"] == "bool", F.when(r["text"] == "true", ~gold.isin(*N.AUDIT_TRUE)).otherwise(~gold.isin(*N.AUDIT_FALSE))).otherwise(~F.col("_same"))
    # a column of its own: a filter on the expression would repeat it all inside the condition
    found = F.when(r["kind"] == "error", "dsl_unparsable").when(wrong, "dsl_mismatch")
    return ran.select("idx", F.explode_outer(F.array(found)).alias("finding")).where("finding IS NOT NULL")


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """``first_index, duplicate_index`` of questions equal but for white space at their ends."""
    own = rows.select("idx", T.strip(F.coalesce(F.col("question"), F.lit(""))).alias("q")).where("q <> ''")
    first = own.groupBy("q").agg(F.min("idx").alias("first_index"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(first, "q").where("idx > first_index").select("first_index", F.col("idx").alias("duplicate_index"))


def near_duplicates(rows: DataFrame, least: float = SIMILAR, tile: int = RATIO_TILE) -> DataFrame:
    """``first_index, similar_index, ratio`` of different questions in one (company, subtask, year) with equal answers.

    Equal texts of a block are compared once. Blocks are compared in tiles (``in_tiles``): a ratio r needs sizes within
    r / (2 - r), then as many characters in common, then so long a common subsequence; only what passes is matched block by
    block, both ways, as the ratio depends on the order.
    """
    own = rows.select("idx", F.col("question").alias("q"), *(F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("company_name", "subtask", "filing_year")), T.strip(F.coalesce(F.col("answer"), F.lit(""))).alias("answer")).where(T.strip(F.col("q")) != "")
    keys = ["company_name", "subtask", "filing_year", "answer"]
    names = [f"_k{i}" for i in range(len(keys))]
    texts = store(own.groupBy(*keys, "q").agg(F.min("idx").alias("pos")))
    sized = texts.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("pos").cast("bigint").alias("pos"), F.col("q").alias("text"), F.length("q").alias("n"))
    found = in_tiles(sized, names, (2 - least) / least, tile, ratios_of(least), "a bigint, b bigint, ab double, ba double")
    hit = found.select(F.explode(F.array("a", "b")).alias("pos")).distinct()
    members = store(own.join(texts.join(hit, "pos", "left_semi"), [*keys, "q"]).select("pos", "idx"))
    discard(texts)
    pairs = found.join(members.select(F.col("pos").alias("a"), F.col("idx").alias("i")), "a").join(members.select(F.col("pos").alias("b"), F.col("idx").alias("j")), "b")
    pairs = pairs.select(F.least("i", "j").alias("first_index"), F.greatest("i", "j").alias("similar_index"), F.when(F.col("i") < F.col("j"), F.col("ab")).otherwise(F.col("ba")).alias("ratio"))
    return pairs.where(F.col("ratio") >= least).withColumn("ratio", F.round("ratio", 3))


def label_values(rows: Column) -> Column:
    """Map from a table's first cells to the numbers in its second ones, the first of each label."""
    pairs = F.filter(F.transform(rows, lambda r: F.struct(T.strip(F.get(r, F.lit(0))).alias("label"), T.cell_number(F.get(r, F.lit(1))).alias("value"))), lambda x: x["value"].isNotNull())
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["label"]), x["label"]) == i + 1)
    return F.map_from_entries(first)


def identity_findings(facts: DataFrame) -> DataFrame:
    """``id, finding`` of rows ``(id, question, <one column a label, null if absent>)``: one pass, no shuffle."""
    v = {k: F.col(f"`{k}`") for k in LABELS}
    def off(have, a, b, tolerance):
        return F.coalesce(~T.near(a, b, tolerance), F.lit(False)) & have

    def known(*labels):
        out = F.lit(True)
        for k in labels:
            out = out & v[k].isNotNull()
        return out

    about = F.col("question").rlike("ROE|DuPont|自己資本利益率")
    rules = (
        ("impossible_cogs", known(SALES, COST) & (v[COST] > v[SALES] * 1.001)), ("gross_profit_mismatch", off(known(SALES, COST, GROSS), v[GROSS], v[SALES] - v[COST], 0.02)), ("op_income_mismatch", off(known(GROSS, EXPENSES, OPERATING), v[OPERATING], v[GROSS] - v[EXPENSES], 0.02)),
        ("ni_decomposition_mismatch", off(known(NET, PARENT, MINORITY), v[NET], v[PARENT] + v[MINORITY], 0.01)), ("asset_total_mismatch", off(known(ASSETS, CURRENT, FIXED), v[ASSETS], v[CURRENT] + v[FIXED], 0.01)),
        ("balance_sheet_mismatch", off(known(ASSETS, DEBT, LONG_DEBT, EQUITY), v[ASSETS], v[DEBT] + v[LONG_DEBT] + v[EQUITY], 0.01)), ("roe_convention_ambiguity", F.coalesce(about, F.lit(False)) & known(NET, PARENT)),
    )
    return facts.select("id", F.explode(F.filter(F.array(*(F.when(test, name) for name, test in rules)), lambda x: x.isNotNull())).alias("finding"))


def table_findings(questions: DataFrame) -> DataFrame:
    """``identity_findings`` of questions ``(id, question, table_rows)``."""
    own = questions.select("id", "question", label_values(F.col("table_rows")).alias("m"))
    return identity_findings(own.select("id", "question", *(F.try_element_at("m", F.lit(k)).alias(k) for k in LABELS)))


def rounding_findings(rows: DataFrame) -> DataFrame:
    """``id`` of programs ending in ``eq`` whose sides lie within 0.0015 but aren't near each other."""
    x = P.last_pair(F.col("program"))
    own = rows.select("id", x.alias("x")).where("x IS NOT NULL").select("id", "x.a", "x.b")
    return own.where((F.abs(F.col("a") - F.col("b")) < 0.0015) & ~T.near(F.col("a"), F.col("b"), 0.0001)).select("id", F.lit("rounding_pedantry").alias("finding"))


def distribution(rows: DataFrame, top: int = 15) -> DataFrame:
    """``measure, key, value``: rows by subtask, standard and year, distinct companies, and the companies with most rows.

    Ties among the top companies go to the one that appears first (by ``idx``).
    """
    keys = [F.coalesce(F.col(k), F.lit("?")).alias(k) for k in ("subtask", "accounting_standard", "filing_year", "edinet_code", "company_name")]
    own = rows.select("idx", *keys)
    names = own.columns[1:]
    sets = own.groupingSets([[k] for k in names], *names).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    sets = store(sets.select("g", F.coalesce(*names).alias("key"), "n", "first"))  # one pass over the rows; a row a key
    of = {k: 31 - (16 >> i) for i, k in enumerate(names)}
    out = sets.select(F.coalesce(*(F.when(F.col("g") == of[k], k) for k in names[:3])).alias("measure"), "key", F.col("n").alias("value")).where("measure IS NOT NULL")
    total = sets.where(F.col("g") == of["subtask"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).select(F.lit("total").alias("measure"), F.lit("").alias("key"), "value")
    companies = sets.where(F.col("g") == of["edinet_code"]).agg(F.count(F.lit(1)).alias("value")).select(F.lit("unique_companies").alias("measure"), F.lit("").alias("key"), "value")
    best = sets.where(F.col("g") == of["company_name"]).orderBy(F.desc("n"), "first").limit(top)
    return out.unionByName(total).unionByName(companies).unionByName(best.select(F.lit("top_companies").alias("measure"), "key", F.col("n").alias("value")))


def counts(findings: DataFrame) -> DataFrame:
    """``finding, n`` by category, and the distinct ids that are affected."""
    by = findings.groupBy("finding").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(findings.agg(F.count_distinct("id").alias("n")).select(F.lit("affected ids").alias("finding"), "n"))


def integrity(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """``file, year, issue`` of raw files: ``companies (file_stem, edinet_code)``, ``filings (file_stem, year, edinet_code, doc_type, company_name)``."""
    stem = F.col("file_stem")
    top = companies.where(~F.coalesce(F.col("edinet_code") == stem, F.lit(False))).select(stem.alias("file"), F.lit(None).cast("string").alias("year"), F.lit("company_code_mismatch").alias("issue"))
    wrong = F.when(~F.coalesce(F.col("edinet_code") == stem, F.lit(False)), "filing_code_mismatch")
    kind = F.when((F.col("doc_type") != "") & (F.col("doc_type") != "120"), "non_annual_doc_type")
    name = F.when(F.coalesce(F.col("company_name"), F.lit("")) == "", "missing_company_name")
    return top.unionByName(filings.select(stem.alias("file"), "year", F.explode(F.filter(F.array(wrong, kind, name), lambda x: x.isNotNull())).alias("issue")))


def first_ids(findings: DataFrame, most: int = 20) -> DataFrame:
    """``finding, id`` of the first ids of each category: the limit is known before the rows move."""
    place = F.row_number().over(Window.partitionBy("finding").orderBy("id"))
    return findings.select("finding", "id").distinct().withColumn("place", place).where(F.col("place") <= most).select("finding", "id", "place")


def found(findings: DataFrame, spread: DataFrame, most: int = 20) -> dict:
    """``distribution, counts, first``: what a report tells, as JSON would hold it (small by construction). Findings are made once and stored."""
    findings = store(findings)
    first: dict[str, list] = {}
    for r in first_ids(findings, most).orderBy("finding", "place").collect():
        first.setdefault(r["finding"], []).append(r["id"])
    told_now = {
        "distribution": [{"measure": r["measure"], "key": r["key"], "value": r["value"]} for r in spread.orderBy("measure", F.desc("value"), "key").collect()],
        "counts": {r["finding"]: r["n"] for r in counts(findings).orderBy("finding").collect()}, "first": first,
    }
    discard(findings)
    return told_now


def report(findings: DataFrame, spread: DataFrame, most: int = 20) -> str:
    """A Markdown report from counts, the distribution and the first findings of each category."""
    return as_markdown(found(findings, spread, most))


def as_markdown(told: dict, title: str = "Audit report") -> str:
    lines = [f"# {title}", "", "## Distribution", ""]
    lines += [f"- {r['measure']} {r['key']}: {r['value']}".replace("  ", " ") for r in told["distribution"]]
    lines += ["", "## Findings", "", *(f"- {k}: {n}" for k, n in told["counts"].items())]
    for k, ids in told["first"].items():
        lines += ["", f"### {k} (first {len(ids)})", "", *(f"- {i}" for i in ids)]
    return "\n".join(lines) + "\n"


BASIC = ("schema_missing", "dsl_unparsable", "dsl_mismatch", "exact_duplicates", "near_duplicates")
DEEP = ("impossible_cogs", "gross_profit_mismatch", "op_income_mismatch", "ni_decomposition_mismatch", "asset_total_mismatch", "balance_sheet_mismatch", "roe_convention_ambiguity", "rounding_pedantry")


def basic(rows: DataFrame) -> DataFrame:
    """``id, finding, detail`` of JSON objects ``(idx, value)`` by schema, program and duplicates; rows that miss a field are
    not run as programs."""
    def at(path):
        return F.try_variant_get("v", path, "string")

    own = rows.withColumn("missing", missing_fields(F.col("value"))).withColumn("v", F.parse_json("value"))
    own = own.select(
        "idx", "missing", F.coalesce(F.try_variant_get("v", "$.qa.program", "array<string>"), F.array().cast("array<string>")).alias("program"), at("$.qa.answer").alias("answer"), at("$.qa.question").alias("question"),
        *(at(f"$.{k}").alias(k) for k in ("company_name", "subtask", "filing_year")),
    )
    own = store(own)
    key = F.col("idx").cast("string").alias("id")
    out = own.where(F.size("missing") > 0).select(key, F.lit(BASIC[0]).alias("finding"), F.array_join("missing", ",").alias("detail"))
    out = out.unionByName(program_findings(own.where(F.size("missing") == 0)).select(key, "finding", F.lit("").alias("detail")))
    out = out.unionByName(exact_duplicates(own).select(F.col("first_index").cast("string").alias("id"), F.lit(BASIC[3]).alias("finding"), F.col("duplicate_index").cast("string").alias("detail")))
    return out.unionByName(near_duplicates(own).select(F.col("first_index").cast("string").alias("id"), F.lit(BASIC[4]).alias("finding"), F.concat_ws(" ", F.col("similar_index").cast("string"), F.col("ratio").cast("string")).alias("detail")))


def deep(questions: DataFrame) -> DataFrame:
    """``id, finding`` of nested questions by the identities of their tables and the tolerance of their last comparison."""
    own = questions.select("id", F.col("qa.question").alias("question"), F.col("table.rows").alias("table_rows"), F.col("qa.program").alias("program"))
    return table_findings(own).unionByName(rounding_findings(own))


def told(findings: DataFrame, spread: DataFrame, names: tuple[str, ...], most: int = 20) -> dict:
    """``found`` with a count for every category, zero where there is none."""
    out = found(findings, spread, most)
    return out | {"counts": {k: out["counts"].get(k, 0) for k in (*names, "affected ids")}}
