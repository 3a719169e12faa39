"""Stored runs: progress, resuming, one streak of errors over all streams."""

import os
from collections import Counter
from pathlib import Path

import pytest

from ledgerlark.operators import runs
from ledgerlark.sources import io


def asking(spark, n):
    return spark.createDataFrame([(k, f"q{k}", "ctx") for k in range(n)], "id bigint, question string, context string")


def calls(folder) -> Counter:
    return Counter(p.name.split("-")[0] for p in Path(folder).iterdir())


def recorded(folder, die_at=None, fail_from=None, fail_to=1 << 60):
    folder = str(folder)

    def provider(question, context):
        k = int(question[1:])
        open(os.path.join(folder, f"{k}-{os.urandom(4).hex()}"), "w").close()
        if k == die_at and not os.path.exists(os.path.join(folder, "died-0")):
            open(os.path.join(folder, "died-0"), "w").close()
            os._exit(1)
        if fail_from is not None and fail_from <= k < fail_to:
            raise RuntimeError("down")
        return {"text": question}

    return provider


@pytest.mark.parametrize(("parallel", "lost"), [(1, 9), (3, 29)])
def test_a_killed_run_goes_on(spark, tmp_path, parallel, lost):
    seen, path = tmp_path / "seen", str(tmp_path / "attempts")
    seen.mkdir()
    q = asking(spark, 60)
    with pytest.raises(Exception):  # noqa: B017 - the worker dies
        runs.run_stored(q, recorded(seen, die_at=48), path, parallel=parallel)
    stored = {r.id for r in io.load_attempts(spark, path).select("id").collect()}
    assert stored == set(range(48 // (10 * parallel) * 10 * parallel))
    told = runs.run_stored(q, recorded(seen, die_at=48), path, parallel=parallel)
    assert told == {"to_ask": 60 - len(stored), "stored": 60 - len(stored), "stopped": False}
    attempts = io.load_attempts(spark, path)
    assert sorted(r.id for r in attempts.collect()) == list(range(60))
    again = calls(seen)
    again.pop("died")
    assert sum(n - 1 for n in again.values()) <= lost + 1  # and the question at which it died
    assert runs.run_stored(q, recorded(seen), path) == {"to_ask": 0, "stored": 0, "stopped": False}


def test_nothing_committed_reads_as_no_attempts(spark, tmp_path):
    path = tmp_path / "attempts"
    assert io.load_attempts(spark, str(path)) is None
    (path / "_temporary").mkdir(parents=True)
    assert io.load_attempts(spark, str(path)) is None


@pytest.mark.parametrize("parallel", [1, 3, 8])
def test_one_streak_over_all_streams(spark, tmp_path, parallel):
    seen = tmp_path / "seen"
    seen.mkdir()
    got = sorted((r.id, r.error is not None) for r in runs.run(asking(spark, 40), recorded(seen, fail_from=11), parallel=parallel).collect())
    assert got == [(k, k >= 11) for k in range(15)]
    assert max(int(k) for k in calls(seen)) < -(-16 // parallel) * parallel  # nothing after the round of the fifth error
    # four errors in a row end nothing, wherever the rounds lie
    got = runs.run(asking(spark, 40), recorded(seen, fail_from=11, fail_to=15), parallel=parallel).collect()
    assert sorted(r.id for r in got) == list(range(40)) and sum(r.error is not None for r in got) == 4


def test_one_streak_over_tasks(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    got = sorted((r.id, r.error is not None) for r in runs.run(asking(spark, 24), recorded(seen, fail_from=9), parallel=8, threads=2).collect())
    assert got == [(k, k >= 9) for k in range(13)]
    assert max(int(k) for k in calls(seen)) < 16


def test_a_streak_goes_on_over_waves(spark, tmp_path):
    seen, path = tmp_path / "seen", str(tmp_path / "attempts")
    seen.mkdir()
    told = runs.run_stored(asking(spark, 40), recorded(seen, fail_from=17), path)
    assert told == {"to_ask": 40, "stored": 21, "stopped": True}  # 17, 18, 19 in one wave, the fourth in the next
    told = runs.run_stored(asking(spark, 40), recorded(seen), path)
    assert told == {"to_ask": 19, "stored": 19, "stopped": False}
    got = {r.id: r.error for r in io.load_attempts(spark, path).collect()}
    assert len(got) == 40 and sorted(k for k, e in got.items() if e) == [17, 18, 19, 20]


def test_runs_of_nothing(spark, tmp_path):
    assert runs.run(asking(spark, 0), recorded(tmp_path)).count() == 0
    assert runs.run_stored(asking(spark, 0), recorded(tmp_path), str(tmp_path / "a")) == {"to_ask": 0, "stored": 0, "stopped": False}


def test_a_run_without_a_possible_streak_asks_each_question_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    got = runs.run(asking(spark, 50).repartition(7), recorded(seen, fail_from=20, fail_to=30), most_errors=1 << 30, parallel=3)
    assert sorted((r.id, r.error is not None) for r in got.collect()) == [(k, 20 <= k < 30) for k in range(50)]
    assert got.where("error IS NULL").count() == 40 and set(calls(seen).values()) == {1}  # read twice, asked once


def test_a_wave_is_read_by_one_task_without_a_shuffle(spark, tmp_path):
    rows = asking(spark, 40).withColumnRenamed("id", "_no").repartition(5)
    got = runs.asked(rows, recorded(tmp_path), 8, 24, parallel=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" in plan and plan.count("Exchange") == 1  # this test's own repartition
    assert sorted(r._no for r in got.collect()) == list(range(8, 24))


def test_unstored_runs_go_in_waves_with_one_streak(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    got = runs.run(asking(spark, 40), recorded(seen, fail_from=17), wave=6)  # waves end before 18: one error in one wave, four in the next
    assert sorted((r.id, r.error is not None) for r in got.collect()) == [(k, k >= 17) for k in range(21)]
    assert max(int(k) for k in calls(seen)) == 21


def test_waves_of_parallel_streams_end_with_whole_rounds(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    got = runs.run(asking(spark, 60), recorded(seen, fail_from=22), parallel=8, wave=20)  # 24 a wave
    assert sorted((r.id, r.error is not None) for r in got.collect()) == [(k, k >= 22) for k in range(26)]
    assert max(int(k) for k in calls(seen)) < 32


def test_waves_of_a_stretch_are_committed_by_one_job(spark, tmp_path):
    seen, path = tmp_path / "seen", str(tmp_path / "attempts")
    seen.mkdir()
    spark.sparkContext.setJobGroup("stretch", "", False)
    told = runs.run_stored(asking(spark, 400), recorded(seen, fail_from=357, fail_to=361), path)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stretch"))
    spark.sparkContext._jsc.clearJobGroup()
    assert told == {"to_ask": 400, "stored": 400, "stopped": False} and jobs < 30  # 40 waves
    assert len(list(Path(path).glob("part-*.parquet"))) == 40 and set(calls(seen).values()) == {1}
    got = io.load_attempts(spark, path)
    assert got.columns == ["id", "question", "context", *(n for n, _ in runs.REPLY_TYPES)]
    assert sorted((r.id, r.error is not None) for r in got.collect()) == [(k, 357 <= k < 361) for k in range(400)]
