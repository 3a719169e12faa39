"""What grows with the input: nothing is sorted or read again where it need not be."""

import json
import os
import re
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark import scratch
from ledgerlark.functions import text as T
from ledgerlark.operators import audit as A
from ledgerlark.operators import evaluate as E
from ledgerlark.operators import runs, similar
from ledgerlark.plans import io_queries
from ledgerlark.plans.registry import QUERIES
from ledgerlark.sources import io, scan


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def answers(spark):
    rows = [("Answer: 1,234百万円", "1234"), ("so\n回答： △５", "-5"), ("x\n\n増加しました\n \n", "増加"), (None, ""), ("12.5%", "12.6"), ("0", "0"), ("none", "1")]
    return spark.createDataFrame([(k, "s", p, g) for k, (p, g) in enumerate(rows)], "id bigint, subtask string, response string, gold string").repartition(2)


def test_harness_scores_in_steps(spark, answers):  # F17
    own = T.with_harness_score(answers, "response", "gold").select("id", "exact_match", "numerical_match")
    whole = answers.select("id", T.harness_score("response", "gold").alias("s")).select("id", "s.*")
    assert sorted(own.collect()) == sorted(whole.collect()) and own.count() == 7
    assert plan(own).count("億円)?") == 10 < plan(whole).count("億円)?")  # each of the two numbers is read once: five uses in one reading


def test_twins_read_each_number_once(spark):  # F18
    assert plan(QUERIES["n5_harness_twins"](spark, "/root/testdata/sf0.001")).count("億円)?") == 10


def test_harness_means_read_each_number_once(spark, answers):  # F20
    got = E.harness(answers)
    assert plan(got).count("億円)?") == 10
    assert [(r.subtask, r.size) for r in got.orderBy("subtask").collect()] == [(None, 7), ("s", 7)]


def test_a_report_makes_its_findings_once(spark, tmp_path):  # F19
    folder = str(tmp_path)

    @F.udf("string")
    def noted(x):
        open(os.path.join(folder, os.urandom(8).hex()), "w").close()
        return f"i{x}"

    found = spark.range(12).repartition(2).select(noted.asNondeterministic()("id").alias("id"), F.lit("f").alias("finding"))
    told = A.told(found, spark.createDataFrame([("m", "k", 1)], "measure string, key string, value bigint"), ("f", "g"))
    assert told["counts"] == {"f": 12, "g": 0, "affected ids": 12} and len(told["first"]["f"]) == 12
    assert len(list(tmp_path.iterdir())) == 12


def test_first_characters_are_not_sorted(spark):  # F14, F16
    pieces = spark.createDataFrame([("a", 3, "{"), ("a", 1, "["), ("b", 0, "{"), ("b", 9, "[")], "file string, pos bigint, char string")
    got = io.starts_array(pieces)
    assert {r.file: r.array for r in got.collect()} == {"a": True, "b": False}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("brackets", ["[]", "{}"])  # F7, F9
def test_one_file_is_written_without_a_sort(spark, tmp_path, brackets):
    rows = spark.range(500).repartition(5).selectExpr("concat(CASE WHEN '%s' = '{}' THEN concat('\"k', id, '\": ') ELSE '' END, '\"v', id, '\"') AS entry" % brackets)
    io_queries._one_file(rows, brackets[0], brackets[1], str(tmp_path / "f"))
    (part,) = Path(tmp_path / "f").glob("part-*")
    value = json.loads(part.read_text())
    assert sorted(value if brackets == "[]" else value.values()) == sorted(f"v{k}" for k in range(500))


@pytest.mark.parametrize("pause", [0, 0.01])
def test_quick_rounds_need_no_threads(spark, pause):  # F2
    def provider(question, context):
        time.sleep(pause)
        return {"text": threading.current_thread().name}

    rows = spark.range(0, 80, 1, 1).select("id", F.col("id").alias("_no"), F.lit("q").alias("question"), F.lit("").alias("context"))
    names = [r.raw_response for r in runs.asked(rows, provider, 0, 80, parallel=4).orderBy("id").collect()]
    assert len(names) == 80 and len(set(names[-40:])) == (4 if pause else 1)


def test_a_wave_reads_its_own_folder(spark, monkeypatch):  # F2
    monkeypatch.setattr(runs, "FOLDER", 10)
    rows = runs._in_order(spark.range(35).select("id", F.lit("q").alias("question"), F.lit("").alias("context")), ("id",))
    got = runs.asked(rows, lambda question, context: {"text": question}, 8, 14, parallel=2)
    assert sorted(r.id for r in got.collect()) == list(range(8, 14)) and "_folder" not in got.columns
    assert len(rows.inputFiles()) >= 4 and "PartitionFilters: [isnotnull(_folder" in got._jdf.queryExecution().executedPlan().toString()


def test_characters_beyond_the_plain_ones(spark):  # F8
    own = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    slow = rf"[^\x00-\x7F{T.FULL[0]}-{T.FULL[-2]}　{T.PLAIN}]"
    own = own.select("c", F.col("c").rlike(slow).alias("want"), F.concat(F.lit("aé"), "c", F.lit("ー。")).rlike(T.BEYOND).alias("got"))
    counts = {tuple(r)[:2]: r[2] for r in own.groupBy("want", "got").count().collect()}
    assert set(counts) == {(True, True), (False, False)} and counts[True, True] > 1_000_000


def test_pairs_across_fill_no_table_of_both_sides():  # F8
    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in range(30)]
    whole = similar.shared(sets, 0)
    assert similar.shared(sets, 2).shape == (2, 28) and (similar.shared(sets, 2) == whole[:2, 2:]).all()
    assert similar.PART == similar.TILE  # grams are numbered once a task


def test_filings_are_files_of_one_folder(spark, monkeypatch):  # F11, F15
    seen, load = [], io.load_filings
    monkeypatch.setattr(io, "load_filings", lambda spark, path: seen.append(path) or load(spark, path))
    rows = [(c, y, s, k, f"l{k}", float(k)) for c in "abcde" for y in ("2023", "2024") for s in ("income_statement", "balance_sheet") for k in range(2)]
    facts = spark.createDataFrame(rows, "company string, year string, statement string, pos bigint, label string, value double").repartition(3)
    got = io_queries._filed(facts)
    assert sorted(tuple(r) for r in got.select("company", "year", "statement", "pos", "label", "value").collect()) == sorted(rows)
    folder = Path(seen[0].removeprefix("file://"))
    assert not [f for f in folder.iterdir() if f.is_dir()] and len(list(folder.glob("part-*"))) == 5


def test_heads_of_all_statements_are_one_pass(spark):  # F21
    got = QUERIES["w4_head_of_context"](spark, "/root/testdata/sf0.001")
    assert "Union" not in plan(got) and got.columns == ["company", "statement", "label"]
    assert {r.statement for r in got.collect()} == {"income_statement", "balance_sheet", "cash_flow_statement"}


def moved(df) -> list[str]:
    """Columns of each shuffle of a plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", text)


@pytest.fixture
def small_batches(spark):
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("block", [5, scan.BLOCK])  # F10
def test_only_shares_of_elements_move(spark, tmp_path, small_batches, block):
    rows = [{"a": [k, f'x,{k}]"\\', "é" * (k % 50)], "b": {"c": "\\" * (k % 4) + ","}} for k in range(150)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(rows[:2], ensure_ascii=False))
    (tmp_path / "c.json").write_text(json.dumps([rows[0], "y" * 5000, [rows[1]] * 40, 1], ensure_ascii=False))
    got = scan.elements(spark, str(tmp_path), block)
    assert moved(got) and not any("value#" in x for x in moved(got))  # texts are moved as collected shares only
    of = {}
    for r in got.orderBy("file", "pos").collect():
        of.setdefault(r.file[-6:], []).append(json.loads(r.value))
    assert of == {"a.json": rows, "b.json": rows[:2], "c.json": [rows[0], "y" * 5000, [rows[1]] * 40, 1]}


def test_questions_are_made_without_a_join(spark):  # F10, F14
    p = spark.createDataFrame([(1, 2, 3, 4)], "id bigint, a bigint, b bigint, k bigint")
    assert "Join" not in plan(io_queries._nested(p))


def test_lines_are_read_without_a_sort(spark):  # F14
    got = QUERIES["s1_json_lines"](spark, "/root/testdata/sf0.001")
    assert moved(got) == [] and got.count() == 1500


def held(spark, group: str) -> int:
    """Most bytes of execution memory that a task of a job group held."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    tracker, most = spark.sparkContext.statusTracker(), [0]
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = sc.statusStore().taskList(stage, 0, 10000)
            most += [tasks.apply(k).taskMetrics().get().peakExecutionMemory() for k in range(tasks.size())]
    return max(most)


def test_no_task_of_lines_holds_more_of_a_larger_table(spark):  # F14
    peaks = []
    for sf in ("0.01", "0.1"):
        spark.sparkContext.setJobGroup(f"lines {sf}", "")
        QUERIES["s1_json_lines"](spark, f"/root/testdata/sf{sf}").write.format("noop").mode("overwrite").save()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        peaks.append(held(spark, f"lines {sf}"))
    assert 0 < peaks[1] <= 1.1 * peaks[0]


def test_files_are_sorted_in_parts_of_a_size(spark, tmp_path, monkeypatch):  # F14
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": str(k)}) + "\n" for k in range(200)))
    monkeypatch.setattr(io, "SORTED", 100)
    got = io.load_file(spark, str(tmp_path / "a.jsonl"))
    assert [r.id for r in got.collect()] == [str(k) for k in range(200)] and got.rdd.getNumPartitions() >= io.size(spark, str(tmp_path)) // 100 > 20


def test_a_runs_ranges_grow_with_its_questions(spark, monkeypatch):  # F12, F13
    monkeypatch.setattr(scratch, "TASK", 10)
    rows = runs._in_order(spark.range(95).repartition(3).select("id", F.lit("q").alias("question"), F.lit("").alias("context")), ("id",), 95)
    assert len(rows.inputFiles()) >= 8 and all(r.id == r._no for r in rows.collect()) and rows.count() == 95
    asked = runs.run(spark.range(95).select("id", F.lit("q").alias("question"), F.lit("").alias("context")), lambda q, c: {"text": q})
    assert sorted(r.id for r in asked.collect()) == list(range(95))


def test_predictions_are_bound_in_parts(spark):  # F9
    q = spark.createDataFrame([(str(k), "s", "1") for k in range(50)], "id string, subtask string, gold string")
    p = spark.createDataFrame([(k, str(k % 40), str(k)) for k in range(80)], "pos bigint, id string, predicted string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = E.bind(q, p, 23)
    n = got.rdd.getNumPartitions()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n == 23
    assert {r.id: r.predicted for r in got.collect()} == {str(k): str(k + 40) if k < 40 else "" for k in range(50)}
