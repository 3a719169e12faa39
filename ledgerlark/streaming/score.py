"""Verdicts and running accuracy for a stream of predictions, joined to a static table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.operators.evaluate import verdicts


def stream_verdicts(predictions: DataFrame, questions: DataFrame, mode: str = "numerical", tolerance: float = 0.01) -> DataFrame:
    """Verdicts of a streaming ``(id, predicted)`` against static ``(id, subtask, gold)``; unknown ids are ignored.

    Stateless: a row's verdict needs no other row, so the stream may run in append mode without a watermark.
    """
    return verdicts(predictions.select("id", F.coalesce("predicted", F.lit("")).alias("predicted")).join(questions.select("id", "subtask", "gold"), "id"), mode, tolerance)


def running_accuracy(scored: DataFrame) -> DataFrame:
    """Totals by subtask so far (complete or update mode); the state is one row a subtask."""
    by = scored.groupBy("subtask").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"))
    return by.withColumn("accuracy", F.col("correct") / F.col("total"))


def append_verdicts(scored: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write verdicts as Parquet; a restart goes on where it stopped. ``once``: what is there now, then stop."""
    out = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
