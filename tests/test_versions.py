"""Publishing and stage sinks: what was there stays until the next version is whole."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.schema import FLAT
from ledgerlark.sources import io, versions


def flat(spark, n, subtask="numerical_reasoning"):
    own = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(subtask).alias("subtask"))
    kinds = {"pre_text": "array<string>", "post_text": "array<string>", "table_headers": "array<string>", "table_rows": "array<array<string>>", "program": "array<string>", "gold_evidence": "array<bigint>"}
    return own.select("id", "subtask", *(F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in FLAT if c not in ("id", "subtask")))


def test_a_failed_publish_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "set")
    assert io.publish(flat(spark, 5), root) == {"numerical_reasoning": 5, "all": 5}
    broken = flat(spark, 9).withColumn("id", F.when(F.col("id") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        io.publish(broken, root)
    assert io.load_table(spark, root, "all").count() == 5 and [p.name for p in (tmp_path / "set").iterdir() if p.name.startswith("_new")] == []
    # a driver that died between writing and naming leaves a folder that nobody reads, and the next publish removes it
    flat(spark, 3).write.parquet(f"{root}/_new-version-x")
    assert io.load_table(spark, root, "all").count() == 5 and spark.read.parquet(root).count() == 5
    assert io.publish(flat(spark, 2, "temporal_reasoning"), root) == {"temporal_reasoning": 2, "all": 2}
    assert io.load_table(spark, root, "all").count() == 2 and spark.read.parquet(root).count() == 2
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "set").iterdir() if not p.name.startswith(".")) == ["_current", "version"]


def test_an_incomplete_set_is_not_published(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    io.publish(flat(spark, 4), root)
    with pytest.raises(ValueError, match="wrong"):
        versions.replace(spark, root, lambda f: flat(spark, 9).write.parquet(f), lambda f: (_ for _ in ()).throw(ValueError("wrong")))
    assert io.load_table(spark, root, "all").count() == 4


def test_stages_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "rejected")
    rows = spark.createDataFrame([("r1", "q"), ("r2", None)], "reason string, id string").drop("id")
    io.write_rows(rows, path)
    assert sorted(r.reason for r in io.load_rejected(spark, path).collect()) == ["r1", "r2"]
    with pytest.raises(Exception, match="gone"):
        io.write_rows(rows.withColumn("reason", F.raise_error(F.lit("gone"))), path)
    assert sorted(r.reason for r in io.load_rejected(spark, path).collect()) == ["r1", "r2"]
    io.write_rows(io.load_rejected(spark, path).select("reason").where("reason = 'r1'"), path)  # from itself
    assert [r.reason for r in io.load_rejected(spark, path).collect()] == ["r1"]


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"reason": "x"}\n')
    assert versions.current(spark, str(tmp_path)) == str(tmp_path)
    assert [r.reason for r in io.load_rejected(spark, str(tmp_path / "*.jsonl")).collect()] == ["x"]
