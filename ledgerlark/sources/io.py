"""Readers and writers. All files are read by Spark, so any store that Spark reaches will do."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import render as R
from ledgerlark.schema import FLAT, QA, SUBTASKS, TABLE
from ledgerlark.sources import scan
from ledgerlark.sources.versions import current, replace, write_text

NAMES = "array<string>"
#: The name under which a published set is read whole.
ALL = "all"
#: Bytes of files whose questions one task sorts.
SORTED = 1 << 26
META = ("edinet_code", "filing_year", "accounting_standard", "source_doc_id")


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, value``: the objects of a JSON array, or of JSON lines (blank ones skipped), as text in their order.

    A file whose first character that isn't blank is ``[`` is an array, others are read line by line; either is cut by many
    tasks, however large it is (``scan``), and an array that isn't JSON fails. First characters are found by an aggregate
    over pieces between colons, which any object has, so that no long line is read whole. Only a folder that mixes both
    kinds brings its files' names to the driver, which has listed them for Spark before.
    """
    root = current(spark, path)
    pieces = spark.read.text(root, lineSep=":").select(F.col("_metadata.file_path").alias("file"), scan.place().alias("pos"), F.regexp_extract("value", r"^[\s\x{FEFF}]*(\S)", 1).alias("char")).where("char <> ''")
    first = starts_array(pieces)
    kinds = {r["array"] for r in first.select("array").distinct().collect()}
    lines_in = arrays_in = root
    if len(kinds) == 2:
        # a path as the metadata shows it is a URI
        named = [(r["array"], spark._jvm.java.net.URI(f).getPath() if (f := r["file"]).startswith("file:") else f) for r in first.collect()]
        lines_in, arrays_in = ([f for array, f in named if array == k] for k in (False, True))
    lines = spark.read.text(lines_in).select(F.col("_metadata.file_path").alias("file"), scan.place().alias("pos"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("value")).where(F.trim("value") != "")
    if True not in kinds:
        return lines
    items = scan.elements(spark, arrays_in).withColumn("value", F.to_json(F.parse_json("value")))
    return items.unionByName(lines) if False in kinds else items


def starts_array(pieces: DataFrame) -> DataFrame:
    """``file, array`` of pieces ``(file, pos, char)``: whether the first one is ``[``. The least place and, in its last bit, the kind, are one
    number, which is aggregated by hashing: of texts all pieces would be sorted by file."""
    return pieces.groupBy("file").agg((F.min(F.col("pos") * 2 + (F.col("char") == "[").cast("bigint")) % 2 == 1).alias("array"))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files that a path names, by patterns too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(current(spark, path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(f.getPath()).getLength() for f in fs.globStatus(at) or [])


def of_subtask(questions: DataFrame, subtask: str | None) -> DataFrame:
    """The questions of one subtask, or all; an unknown subtask is an error."""
    if subtask is None:
        return questions
    if subtask not in SUBTASKS:
        raise ValueError(f"unknown subtask: {subtask}")
    return questions.where(F.col("subtask") == subtask)


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows in an order: a sort with a limit keeps that many rows a task, so nothing else moves."""
    return rows.orderBy(*order).limit(most)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def to_questions(rows: DataFrame) -> DataFrame:
    """Nested questions from JSON objects ``(file, pos, value)`` in any of three shapes.

    A list under ``table`` is the grid shape (header first, ``id`` defaults to empty), ``table_headers`` the flat one, else
    the native one, which must have an ``id``. Absent lists are empty, an absent subtask is numerical; an unknown one fails.
    """
    v = F.col("v")
    own = rows.withColumn("v", F.parse_json("value"))
    listed = F.schema_of_variant(_get(v, "$.table", "variant")).startswith("ARRAY")
    flat = _get(v, "$.table_headers", NAMES).isNotNull()
    def text(path):
        return _get(v, path, "string")

    def array(path):
        return F.coalesce(_get(v, path, NAMES), F.array().cast(NAMES))

    grid = F.coalesce(_get(v, "$.table", "array<array<string>>"), F.array().cast("array<array<string>>"))
    def rows_at(path):
        return F.coalesce(_get(v, path, "array<array<string>>"), F.array().cast("array<array<string>>"))

    headers = F.when(listed, R.grid_headers(grid)).when(flat, array("$.table_headers")).otherwise(array("$.table.headers"))
    body = F.when(listed, R.grid_rows(grid)).when(flat, rows_at("$.table_rows")).otherwise(rows_at("$.table.rows"))
    def qa(name):
        return F.when(flat, text(f"$.{name}")).otherwise(text(f"$.qa.{name}"))

    evidence = F.coalesce(_get(v, "$.gold_evidence", "array<bigint>"), _get(v, "$.qa.gold_evidence", "array<bigint>"), F.array().cast("array<bigint>"))
    program = F.when(flat, array("$.program")).otherwise(array("$.qa.program"))
    subtask = F.coalesce(text("$.subtask"), F.lit("numerical_reasoning"))
    checked = F.when(subtask.isin(*SUBTASKS), subtask).otherwise(F.raise_error(F.concat(F.lit("unknown subtask: "), subtask)))
    key = F.when(listed, F.coalesce(text("$.id"), F.lit(""))).otherwise(F.coalesce(text("$.id"), F.raise_error(F.lit("a question has no id")).cast("string")))
    return own.select(
        "file", "pos", key.alias("id"), checked.alias("subtask"), array("$.pre_text").alias("pre_text"), array("$.post_text").alias("post_text"), F.struct(headers.alias("headers"), body.alias("rows")).alias("table"),
        F.struct(F.coalesce(qa("question"), F.lit("")).alias("question"), program.alias("program"), F.coalesce(qa("answer"), F.lit("")).alias("answer"), evidence.alias("gold_evidence")).cast(QA).alias("qa"), *(text(f"$.{m}").alias(m) for m in META),
    )


def load_file(spark: SparkSession, path: str, subtask: str | None = None, in_order: bool = True) -> DataFrame:
    """Questions of a JSON or JSONL file, of one subtask if given, in file order: that sorts whole questions, in parts of about ``SORTED`` bytes
    of the files. Without ``in_order`` nothing is sorted or moved."""
    rows = of_subtask(to_questions(json_rows(spark, path)), subtask)
    if in_order:
        rows = rows.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size(spark, path) // SORTED)), "file", "pos").sortWithinPartitions("file", "pos")
    return rows.drop("file", "pos")


def load_table(spark: SparkSession, root: str, subtask: str | None = None) -> DataFrame:
    """The stored flat questions; one subtask reads only its own files, ``all`` whatever there is. Without one, all three
    subtasks must be there."""
    rows = spark.read.parquet(current(spark, root))
    if subtask is not None:
        return rows if subtask == ALL else of_subtask(rows, subtask)
    have = {r[0] for r in rows.select("subtask").distinct().collect()}
    if missing := [s for s in SUBTASKS if s not in have]:
        raise ValueError(f"no questions for {', '.join(missing)}")
    return rows


def flatten(questions: DataFrame) -> DataFrame:
    """Nested questions as the 16 flat columns; absent ones are null."""
    have = set(questions.columns)
    def top(name):
        return F.col(name) if name in have else F.lit(None).cast("string").alias(name)

    return questions.select("id", "subtask", top("company_name"), top("edinet_code"), top("source_doc_id"), top("filing_year"), top("accounting_standard"), top("scale"), "pre_text", "post_text", F.col("table.headers").alias("table_headers"), F.col("table.rows").alias("table_rows"), "qa.question", "qa.program", "qa.answer", "qa.gold_evidence").select(*FLAT)


def unflatten(flat: DataFrame) -> DataFrame:
    """Flat questions as nested ones."""
    return flat.select("id", "subtask", "pre_text", "post_text", F.struct(F.col("table_headers").alias("headers"), F.col("table_rows").alias("rows")).alias("table"), F.struct("question", "program", "answer", "gold_evidence").alias("qa"), *META)


def publish(flat: DataFrame, root: str) -> dict[str, int]:
    """The flat questions, one directory a subtask; rows by configuration, that of ``all`` included.

    What was written is read back and counted before it becomes the published set: one that lacks rows is an error, and
    then, or if the write fails, the set published before stays.
    """
    spark = flat.sparkSession
    wanted = dict(flat.groupBy("subtask").count().collect())

    def complete(folder: str) -> None:
        have = dict(spark.read.schema(flat.schema).parquet(folder).groupBy("subtask").count().collect())
        if wanted != have:
            raise RuntimeError(f"the written set is not complete: {have} of {wanted}")

    replace(spark, root, lambda folder: flat.write.partitionBy("subtask").parquet(folder), complete)
    return {**dict(sorted(wanted.items())), ALL: sum(wanted.values())}


def to_grid_rows(questions: DataFrame) -> DataFrame:
    """Export with the table as one grid and without the filing's metadata."""
    return questions.select("id", "pre_text", "post_text", R.grid(F.col("table.headers"), F.col("table.rows")).alias("table"), "qa")


def from_grid_rows(rows: DataFrame, subtask: str = "numerical_reasoning") -> DataFrame:
    """The way back; every row gets the subtask, absent metadata are null."""
    have = set(rows.columns)
    return rows.select(F.coalesce("id", F.lit("")).alias("id"), F.lit(subtask).alias("subtask"), "pre_text", "post_text", F.struct(R.grid_headers(F.col("table")).alias("headers"), R.grid_rows(F.col("table")).alias("rows")).alias("table"), "qa", *(F.col(m) if m in have else F.lit(None).cast("string").alias(m) for m in META))


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``pos, id, predicted`` of JSON objects from ids to answers; an id that an object repeats is there each time, in order.

    An object of any size is cut by many tasks (``scan``); one that isn't JSON fails.
    """
    pair = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,string>", {"mode": "FAILFAST"})
    return scan.elements(spark, path).select("pos", F.explode(pair).alias("id", "predicted"))


def write_results(verdicts: DataFrame, path: str) -> None:
    """Verdicts as JSON lines; text beyond ASCII stays as it is."""
    verdicts.write.mode("overwrite").json(path)


def load_filings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``filing_tables`` of raw filing files, one JSON object each."""
    return filing_tables(spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1).alias("file_stem"), "value"))


def filing_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies, filings and line items of raw filings: rows of file_stem and value, a JSON object.

    ``companies``: file_stem, edinet_code, name, industry, gaap; ``filings``: those and year, doc_id, doc_type, company_name,
    accounting_standard; ``items``: company, year, statement, pos, label, element, context, value, previous. A statement any
    of whose items has the key 科目 is in the newer shape: its label is that key's value and its numbers are 当期 and 前期.
    """
    raw = files.select("file_stem", F.parse_json("value").alias("v"))
    def text(path):
        return F.try_variant_get("v", path, "string")

    companies = raw.select("file_stem", *(text(f"$.company.{k}").alias(k) for k in ("edinet_code", "name", "industry", "gaap")))
    years = raw.select("file_stem", text("$.company.edinet_code").alias("company"), F.explode(F.try_variant_get("v", "$.filings", "map<string,variant>")).alias("year", "f"))
    def of(path):
        return F.try_variant_get("f", path, "string")

    filings = years.select("file_stem", "company", "year", of("$.filing.doc_id").alias("doc_id"), of("$.filing.edinet_code").alias("edinet_code"), of("$.filing.doc_type").alias("doc_type"), of("$.filing.company_name").alias("company_name"), of("$.accounting_standard").alias("accounting_standard"))
    statements = years.select("company", "year", F.explode(F.create_map(*(x for s in ("income_statement", "balance_sheet", "cash_flow_statement", "summary") for x in (F.lit(s), F.try_variant_get("f", f"$.{s}", "array<variant>"))))).alias("statement", "own")).where("own IS NOT NULL")
    newer = F.exists("own", lambda i: F.try_variant_get(i, "$['科目']", "string").isNotNull())
    rows = statements.withColumn("newer", newer).select("company", "year", "statement", "newer", F.posexplode("own").alias("pos", "i"))
    def item(key, kind="string"):
        return F.try_variant_get("i", f"$['{key}']", kind)

    # only JSON numbers count: a number in quotes is text
    def number(key):
        return F.when(F.schema_of_variant(F.try_variant_get("i", f"$['{key}']", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), item(key, "double"))

    items = rows.select("company", "year", "statement", F.col("pos").cast("bigint").alias("pos"), F.when(F.col("newer"), item("科目")).otherwise(item("label")).alias("label"), item("element").alias("element"), F.coalesce(item("context"), F.lit("")).alias("context"), F.when(F.col("newer"), number("当期")).otherwise(number("value")).alias("value"), F.when(F.col("newer"), number("前期")).alias("previous"), "newer")
    return companies, filings, items


#: Stored contexts and generated questions.
CONTEXT = f"company_name string, edinet_code string, source_doc_id string, filing_year string, accounting_standard string, pos bigint, context_type string, pre_text array<string>, post_text array<string>, table {TABLE}, raw_values map<string,double>, scale string"
GENERATED = f"company_name string, edinet_code string, source_doc_id string, filing_year string, accounting_standard string, context_type string, pos bigint, template_no bigint, template string, subtask string, pre_text array<string>, post_text array<string>, table {TABLE}, qa {QA}, scale string"


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows of any stage (contexts, generated, final, rejected) as JSON lines, nulls included; what was there stays until all are written."""
    replace(rows.sparkSession, path, lambda folder: rows.write.option("ignoreNullFields", "false").json(folder))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows as they were written, from JSON lines or arrays; without a stored ``pos`` the place in the file counts."""
    rows = json_rows(spark, path).select(F.col("pos").alias("_place"), F.from_json("value", schema).alias("r"))
    names = [f.name for f in rows.schema["r"].dataType]
    return rows.select(*(F.coalesce("r.pos", "_place").alias("pos") if n == "pos" else F.col(f"r.{n}") for n in names))


def load_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Stored contexts, of this writer or as JSON arrays, one file a company."""
    return _stored(spark, path, CONTEXT)


def load_generated(spark: SparkSession, path: str) -> DataFrame:
    """Stored generated questions; one without a subtask is numerical."""
    return _stored(spark, path, GENERATED).withColumn("subtask", F.coalesce("subtask", F.lit(SUBTASKS[0]))).withColumn("template_no", F.coalesce("template_no", F.lit(0).cast("bigint")))


#: A question of the final set as it is stored.
FINAL = f"id string, subtask string, company_name string, edinet_code string, source_doc_id string, filing_year string, accounting_standard string, scale string, pre_text array<string>, post_text array<string>, table {TABLE}, qa {QA}"


def load_final(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a final set with all their metadata, from JSON lines or arrays."""
    return _stored(spark, path, FINAL)


def load_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rejected candidates with their ``reason``."""
    return _stored(spark, path, f"reason string, {FINAL.removeprefix('id string, ')}")


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds data files: names that don't start with a dot or an underscore."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and any(f.getPath().getName()[0] not in "._" for f in fs.listStatus(at))


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Attempts are appended; what is stored is never asked again (``runs.to_do``)."""
    attempts.write.mode("append").parquet(path)


def load_attempts(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored attempts, or None where there are none yet: no folder, or one that a run left without a commit."""
    return spark.read.parquet(path) if has_files(spark, path) else None
