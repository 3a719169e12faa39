"""Ids that repeat, or are null, very often: nothing of one id goes through one task or the driver."""

from collections import Counter

from pyspark.sql import functions as F

from ledgerlark.llm import language_id, mixing, packing


def test_language_sample_is_bounded_where_an_id_repeats(spark, monkeypatch):
    docs = spark.range(10_000, numPartitions=4).select(F.lit(885).cast("bigint").alias("doc_id"), F.concat(F.lit("some words of text number "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 5 == 0, "fr").otherwise("en").alias("lang"))
    monkeypatch.setattr(language_id, "DOCS_PER_LANGUAGE", 30)
    seen = []
    monkeypatch.setattr(language_id.BiGru, "train", lambda net, bytes_, labels: seen.append(Counter(labels.tolist())))
    frame = type(docs)
    collect, came = frame.collect, []
    monkeypatch.setattr(frame, "collect", lambda df: came.append(collect(df)) or came[-1])
    net = language_id.train_on(docs)
    assert net.labels == ["en", "fr"] and max(map(len, came)) <= 60
    assert seen[0][0] == seen[0][1] > 0


def ranges(spark, docs, monkeypatch, size):
    monkeypatch.setattr(mixing, "RANGE", size)
    kept = {}
    split = mixing.split_hot
    monkeypatch.setattr(mixing, "split_hot", lambda rows, size: kept.setdefault("out", split(rows, size)))
    out = mixing.mix_sources(docs, block=4).collect()
    return out, kept["out"][1]


def test_null_ids_have_many_ranges(spark, monkeypatch):
    docs = spark.range(6000, numPartitions=4).select(F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("other"))
    out, cells = ranges(spark, docs, monkeypatch, 50)
    assert sum(n for *_, n in cells) == 6000 and max(n for *_, n in cells) <= 4 * 50
    assert sorted(r.position for r in out) == list(range(6000))
    # rows that are alike are interchangeable: everything else is the same in each run
    again = mixing.mix_sources(docs.repartition(3), block=4).collect()
    assert Counter(map(str, out)) == Counter(map(str, again))
    blocks = Counter((r.source, r.block_no) for r in out)
    assert set(blocks.values()) == {4} and Counter(s for s, _ in blocks) == {"a": 1000, "b": 500}


def test_an_id_that_repeats_has_many_ranges(spark, monkeypatch):
    docs = spark.range(5000, numPartitions=4).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.col("id").alias("other"))
    out, cells = ranges(spark, docs, monkeypatch, 100)
    assert max(n for *_, n in cells) <= 4 * 100 and sorted(r.position for r in out) == list(range(5000))
    again = mixing.mix_sources(docs.repartition(3), block=4).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_part_files_follow_their_numbers():
    names = [f"file:/x/part-{n:05d}-u-c{c:03d}.snappy.parquet" for n in (0, 9, 99_999, 100_000, 1_000_000) for c in (0, 2, 1000)]
    assert sorted(sorted(names), key=packing.file_order) == names
    assert sorted(["b.parquet", "a.parquet"], key=packing.file_order) == ["a.parquet", "b.parquet"]
