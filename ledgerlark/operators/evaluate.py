"""Scoring: questions with predictions, a verdict for each, accuracy overall and by subtask."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.ship import by_value

by_value(__name__)

MODES = ("numerical", "exact")


def bind(questions: DataFrame, predictions: DataFrame, parts: int | None = None) -> DataFrame:
    """Questions ``(id, subtask, gold, ...)`` with ``predicted`` from ``(id, predicted)``; a missing one is empty, an extra one ignored.

    Of predictions with the same id the last one counts: by ``pos`` where that column is there, as in ``load_predictions``;
    without it the greatest. Both sides are sorted by id, in ``parts`` parts where that is given (``scratch.parts``).
    """
    last = F.max_by("predicted", "pos") if "pos" in predictions.columns else F.max("predicted")
    predictions = predictions if parts is None else predictions.repartition(parts, "id")
    once = predictions.groupBy("id").agg(last.alias("predicted"))
    return questions.join(once, "id", "left").withColumn("predicted", F.coalesce("predicted", F.lit("")))


def ask(questions: DataFrame, model: Callable[[str, str], str]) -> DataFrame:
    """Questions ``(id, question, context, ...)`` with ``predicted`` from a model function, called once a row in Arrow batches."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            yield rows.assign(predicted=[model(q, c) for q, c in zip(rows["question"], rows["context"], strict=True)])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema if f.name != "predicted")
    return questions.drop("predicted").mapInPandas(batches, f"{columns}, predicted string")


def verdicts(bound: DataFrame, mode: str = "numerical", tolerance: float = 0.01) -> DataFrame:
    """``question_id, subtask, predicted, gold, correct``."""
    if mode not in MODES:
        raise ValueError(f"unknown match mode {mode!r}: one of {', '.join(MODES)}")
    # each answer is normalised once and read as a number once, in projections of their own
    own = bound.select(F.col("id").alias("question_id"), "subtask", "predicted", "gold", text.normalize_answer("predicted").alias("_p"), text.normalize_answer("gold").alias("_g"))
    p, g = F.col("_p"), F.col("_g")
    if mode == "exact":
        return own.select("question_id", "subtask", "predicted", "gold", (p == g).alias("correct"))
    own = own.select("*", text.number_of(p).alias("_x"), text.number_of(g).alias("_y"))
    return own.select("question_id", "subtask", "predicted", "gold", text.match_numbers(p, g, F.col("_x"), F.col("_y"), tolerance).alias("correct"))


def evaluate(questions: DataFrame, *, predictions: DataFrame | None = None, model: Callable[[str, str], str] | None = None, mode: str = "numerical", tolerance: float = 0.01) -> DataFrame:
    """Verdicts from exactly one of predictions and a model function."""
    if (predictions is None) == (model is None):
        raise ValueError("give either predictions or a model function")
    return verdicts(bind(questions, predictions) if model is None else ask(questions, model), mode, tolerance)


def _with_whole(by: DataFrame, *sums: str) -> DataFrame:
    """The grouped rows (a few) and one more with a null subtask that adds them up, also where there are none: in one pass."""
    rows = by.agg(F.collect_list(F.struct("subtask", *sums)).alias("l"))

    def added(name):
        return F.aggregate("l", F.lit(0.0) if dict(by.dtypes)[name] == "double" else F.lit(0).cast("bigint"), lambda acc, x: acc + x[name])

    whole = F.struct(F.lit(None).cast("string").alias("subtask"), *(added(n).alias(n) for n in sums))
    return rows.select(F.explode(F.concat(F.array(whole), "l")).alias("x")).select("x.*")


def accuracy(rows: DataFrame) -> DataFrame:
    """``subtask`` (null: overall), ``total, correct, accuracy``. Without rows the overall row stands alone with zeros."""
    by = rows.groupBy("subtask").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"))
    return _with_whole(by, "total", "correct").withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def harness(rows: DataFrame) -> DataFrame:
    """Means of exact and numerical scores of ``(subtask, response, gold)`` by subtask and, weighted by size, for the group (null)."""
    scored = text.with_harness_score(rows.select("subtask", "response", "gold"), "response", "gold")
    by = scored.groupBy("subtask").agg(F.sum("exact_match").alias("e"), F.sum("numerical_match").alias("n"), F.count(F.lit(1)).alias("size"))
    return _with_whole(by, "e", "n", "size").where("size > 0").select("subtask", (F.col("e") / F.col("size")).alias("exact_match"), (F.col("n") / F.col("size")).alias("numerical_match"), "size")


def summary_lines(result: DataFrame) -> DataFrame:
    """``pos, line`` of a result of ``accuracy``: title, rule, overall, an empty line, then the subtasks by name."""
    share = F.concat(F.replace(F.format_number(F.col("accuracy") * 100, 1), F.lit(","), F.lit("")), F.lit("% ("), F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))
    head = result.where("subtask IS NULL").select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("Benchmark results").alias("line")), F.struct(F.lit(1).alias("k"), F.lit("=" * 40).alias("line")), F.struct(F.lit(2).alias("k"), F.concat(F.lit("Overall: "), share).alias("line")), F.struct(F.lit(3).alias("k"), F.lit("").alias("line")))).alias("x")).select("x.k", "x.line", F.lit("").alias("subtask"))
    rest = result.where("subtask IS NOT NULL").select(F.lit(4).alias("k"), F.concat(F.lit("  "), F.col("subtask"), F.lit(": "), share).alias("line"), "subtask")
    return head.unionByName(rest).orderBy("k", "subtask").select("k", "line")


def summary(result: DataFrame) -> str:
    """The lines as one text: a handful of rows, whatever was scored."""
    return "\n".join(r.line for r in summary_lines(result).collect())
