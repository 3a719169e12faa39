"""The parallel scan of JSON arrays and objects against whole reads."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.sources import io, scan

ODD = ["", ",", "a,b", '"', '\\', '\\",', "[{", "}]", "],[", '{"a": 1}', "売上高、,△1", "\n, \t", "\\\\\",\"[", "é,ü", "x" * 500 + ","]


def value(r, deep=0):
    kind = r.randrange(8 if deep < 4 else 5)
    if kind < 3:
        return r.choice(ODD)
    if kind == 3:
        return r.choice([1, -2.5, 10**12, 0])
    if kind == 4:
        return r.choice([None, True, False])
    if kind < 7:
        return [value(r, deep + 1) for _ in range(r.randrange(4))]
    return {f"{k}{r.choice(ODD)}": value(r, deep + 1) for k in range(r.randrange(4))}


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in zip(names, ("700", "1", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("block", [3, 64, scan.BLOCK])
def test_arrays_are_as_read_whole(spark, tmp_path, small_splits, block):
    r = random.Random(block)
    want = {}
    for n, indent in enumerate((None, 2, None, None)):
        rows = [value(r) for _ in range((60, 40, 1, 0)[n])]
        body = json.dumps(rows, ensure_ascii=n == 2, indent=indent)
        (tmp_path / f"f{n}.json").write_text(("﻿" if n == 1 else "") + f" \n{body}\n ", encoding="utf-8")
        want[f"f{n}.json"] = rows
    read = scan.elements(spark, str(tmp_path), block)
    got = {k: [] for k in want}
    for x in read.orderBy("file", "pos").collect():
        got[x.file.rsplit("/", 1)[1]].append(json.loads(x.value))
    assert got == want
    if block == 3:
        pieces = scan._pieces(spark, str(tmp_path), block)
        assert pieces.rdd.getNumPartitions() > 4  # one file is cut by several tasks


def test_predictions_of_one_object(spark, tmp_path, small_splits):
    r = random.Random(5)
    pairs = [(f"{r.randrange(60)}{r.choice(ODD)}", r.choice(ODD)) for _ in range(300)]
    body = ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v)}" for k, v in pairs)
    (tmp_path / "p.json").write_text("{" + body + "}\n")
    got = [(x.id, x.predicted) for x in io.load_predictions(spark, str(tmp_path / "p.json")).orderBy("pos").collect()]
    assert got == pairs
    (tmp_path / "none.json").write_text(" { } ")
    assert io.load_predictions(spark, str(tmp_path / "none.json")).collect() == []


@pytest.mark.parametrize("body", ['[{"a": 1}, {"b": "x', '[{"a": 1}, {"b": 2}', '[{"a": 1}, {"b": 2}]]', '[{"a": 1}, , {"b": 2}]', '[{"a": 1}, {"b" 2}]'])
def test_files_that_are_not_json_fail(spark, tmp_path, body):
    (tmp_path / "a.json").write_text(body)
    with pytest.raises(Exception, match="not one whole JSON value|MALFORMED|empty"):
        io.json_rows(spark, str(tmp_path / "a.json")).collect()


def test_predictions_that_are_not_json_fail(spark, tmp_path):
    for body in ('{"a": "1", "b"}', '{"a": "1"', '{"a": "1", "b": "2'):
        (tmp_path / "p.json").write_text(body)
        with pytest.raises(Exception):
            io.load_predictions(spark, str(tmp_path / "p.json")).collect()


def test_no_window_over_a_files_pieces(spark, tmp_path):
    """Pieces are summed by block; only rows of blocks are summed by file."""
    (tmp_path / "a.json").write_text(json.dumps([{"a": [1, 2]}] * 50))
    read = scan.elements(spark, str(tmp_path), 8)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert any("[place#" in x for x in windows)
    assert all(re.search(r"\], \[file#\d+, block#\d+L?\], \[place#", x) for x in windows if "[place#" in x)
    assert read.where(F.col("value") == '{"a": [1, 2]}').count() == 50
