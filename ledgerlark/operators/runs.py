"""Bookkeeping of model runs: cost, resuming, rates and distributions by subtask and accounting standard."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.functions.numbers import plain
from ledgerlark.functions.render import RUN_PROMPT, SYSTEM_PROMPT
from ledgerlark.operators.build import numbered
from ledgerlark.schema import PRICES, REGIMES, UNKNOWN_PRICE
from ledgerlark.scratch import discard, new_folder, parts, store
from ledgerlark.ship import by_value
from ledgerlark.sources import io

by_value(__name__)

MOST_ERRORS = 5
#: Attempts of a stream between two commits of a stored run.
EVERY = 10
#: Questions that a task asks at a time. A round over several tasks ends with a barrier, which takes up to a second.
THREADS = 32
#: Questions that a job of an unstored run asks: they are sorted in one task.
WAVE = 1 << 16
#: Questions of a folder of stored ones: a wave reads its own folders only.
FOLDER = 1 << 17
#: Questions whose waves one job asks and commits, about.
STRETCH = 1 << 18
#: Seconds of a round below which threads would take longer to change than answers take to come.
QUICK = 1e-3
REPLY_TYPES = [("raw_response", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("thinking_tokens", pa.int64()), ("latency_s", pa.float64()), ("truncated", pa.bool_()), ("error", pa.string())]
REPLY = "raw_response string, input_tokens bigint, output_tokens bigint, thinking_tokens bigint, latency_s double, truncated boolean, error string"


def price_dim(spark):
    return spark.createDataFrame([(m, *p) for m, p in sorted(PRICES.items())], "model string, input_price double, output_price double, thinking_price double")


def with_cost(attempts: DataFrame) -> DataFrame:
    """``cost_usd`` from token counts and the model's prices (a seed of some 20 rows); unknown models have a moderate price."""
    priced = attempts.join(F.broadcast(price_dim(attempts.sparkSession)), "model", "left")
    part = [F.col(f"{k}_tokens") * F.coalesce(F.col(f"{k}_price"), F.lit(p)) / 1_000_000 for k, p in zip(("input", "output", "thinking"), UNKNOWN_PRICE, strict=True)]
    return priced.select(*attempts.columns, (part[0] + part[1] + part[2]).alias("cost_usd"))


def to_do(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Questions without a stored attempt; one that ended in an error counts as done."""
    return questions.join(attempts.select("id").distinct(), "id", "left_anti")


def for_regime(model: str, regime: str, call: Callable[..., dict]) -> Callable[[str, str], dict]:
    """A provider for ``run`` from ``call(model, system, prompt, settings)``: the fixed system prompt, the run prompt, and
    the regime's limits (``max_output``, ``effort``, ``budget``, ``own_budget``)."""
    settings, system, prompt = dict(REGIMES[regime]), SYSTEM_PROMPT, RUN_PROMPT

    def provider(question: str, context: str) -> dict:
        return call(model, system, prompt.replace("{context}", context).replace("{question}", question), settings)

    return provider


def attempt(provider: Callable[[str, str], dict], row: dict) -> dict:
    """One question asked: the row and what came of it."""
    got = {"raw_response": None, "input_tokens": 0, "output_tokens": 0, "thinking_tokens": 0, "latency_s": 0.0, "truncated": False, "error": None}
    try:
        reply = provider(row["question"], row["context"])
        got |= {"raw_response": reply["text"]} | {k: reply.get(k, got[k]) for k in ("input_tokens", "output_tokens", "thinking_tokens", "latency_s", "truncated")}
    except Exception as e:  # a provider may fail in any way; the row records it
        got["error"] = f"{type(e).__name__}: {e}"
    return row | got


def _types(batch: pa.RecordBatch) -> list[pa.Field]:
    return [*batch.schema, *(pa.field(name, kind) for name, kind in REPLY_TYPES)]


def asked(rows: DataFrame, provider: Callable[[str, str], dict], first: int, last: int, bad: int = 0, most_errors: int = MOST_ERRORS, parallel: int = 1, threads: int = THREADS) -> DataFrame:
    """Attempts of rows numbered ``_no`` from ``first`` to before ``last``, in rounds of ``parallel`` questions at a time.

    The streams are dealt to tasks of ``threads`` each, of which no more are made than run at once. After a round all tasks of the
    barrier stage tell each other what failed, so that all count the same streak, in the order of the numbers; ``bad`` errors
    precede the first question. The error that completes a streak of ``most_errors`` and those after it are left out, answers of
    its round stay, and nothing more is asked. All rows of a stream pass through one task, sorted: callers hand over waves.
    """
    tasks = max(1, min(-(-parallel // threads), rows.sparkSession.sparkContext.defaultParallelism))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_folder"), REPLY])
    width = -(-parallel // tasks)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = (lambda said: [x for own in BarrierTaskContext.get().allGather(json.dumps(said)) for x in json.loads(own)]) if tasks > 1 else lambda said: said
        with ThreadPoolExecutor(max_workers=width) as pool:
            yield from Rounds(it, provider, pool, bad, most_errors, parallel, tell).ask(first, last)

    own = _between(rows, first, last)
    if tasks == 1:  # stored rows of a wave: one task reads them, nothing is shuffled
        return own.coalesce(1).sortWithinPartitions("_no").mapInArrow(batches, schema)
    return own.repartitionById(tasks, (F.col("_no") % parallel % tasks).cast("int")).sortWithinPartitions("_no").mapInArrow(batches, schema, barrier=True)


class Rounds:
    """Sorted rows of a task, asked in rounds of ``parallel`` questions at a time; ``streak`` goes on from one ``ask`` to the next."""

    def __init__(self, it: Iterator[pa.RecordBatch], provider: Callable[[str, str], dict], pool: ThreadPoolExecutor, streak: int, most_errors: int, parallel: int, tell: Callable[[list], list] = lambda said: said):
        self.waiting = ((r, batch, k) for batch in it for k, r in enumerate(asking(batch)))
        self.ahead, self.took, self.streak, self.stopped = next(self.waiting, None), QUICK, streak, False
        self.provider, self.pool, self.most_errors, self.parallel, self.tell = provider, pool, most_errors, parallel, tell

    def upto(self, last: int) -> list[tuple]:
        own = []
        while self.ahead is not None and self.ahead[0]["_no"] < last:
            own.append(self.ahead)
            self.ahead = next(self.waiting, None)
        return own

    def ask(self, first: int, last: int) -> Iterator[pa.RecordBatch]:
        kept, provider = Kept(), self.provider
        for at in range(first, last, self.parallel):
            own = self.upto(min(last, at + self.parallel))
            began = time.perf_counter()
            # while rounds are that quick their questions go one by one, the first slow round brings the threads back
            got = list(self.pool.map(lambda x: attempt(provider, x[0]), own)) if len(own) > 1 and self.took >= QUICK else [attempt(provider, x[0]) for x in own]
            self.took = time.perf_counter() - began
            stop = None
            for no, failed in sorted(self.tell([[r["_no"], r["error"] is not None] for r in got])):
                self.streak = self.streak + 1 if failed else 0
                if self.streak >= self.most_errors:
                    stop = no
                    break
            for (_, batch, k), r in zip(own, got, strict=True):
                if stop is None or r["_no"] < stop or r["error"] is None:
                    yield from kept.add(batch, k, r)
            if stop is not None:
                self.stopped = True
                break
        yield from kept.flush()


def _between(rows: DataFrame, first: int, last: int) -> DataFrame:
    own = rows.where((F.col("_no") >= first) & (F.col("_no") < last))
    if "_folder" in rows.columns:
        own = own.where((F.col("_folder") >= first // FOLDER) & (F.col("_folder") <= (last - 1) // FOLDER)).drop("_folder")
    return own


def asking(batch: pa.RecordBatch) -> list[dict]:
    return batch.select([n for n in ("_no", "question", "context") if n in batch.schema.names]).to_pylist()


class Kept:
    """Rows of batches with their replies, given out as batches again: a small one for each round would cost more than the round."""

    def __init__(self, most: int = 4096):
        self.most, self.batch, self.places, self.replies = most, None, [], []

    def add(self, batch: pa.RecordBatch, place: int, reply: dict) -> Iterator[pa.RecordBatch]:
        if batch is not self.batch or len(self.places) >= self.most:
            yield from self.flush()
            self.batch = batch
        self.places.append(place)
        self.replies.append(reply)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.places:
            told = [pa.array([r[name] for r in self.replies], kind) for name, kind in REPLY_TYPES]
            yield pa.RecordBatch.from_arrays([*self.batch.take(pa.array(self.places)).columns, *told], schema=pa.schema(_types(self.batch)))
        self.places, self.replies = [], []


def asked_freely(rows: DataFrame, provider: Callable[[str, str], dict], parallel: int = 1) -> DataFrame:
    """Attempts of all rows where no streak can end the run: ``parallel`` questions at a time, each stream through a part of its own,
    in as many tasks as there are streams or as run at once. Nothing is sorted or shuffled, and a task holds a batch."""
    tasks = max(1, min(parallel, rows.sparkSession.sparkContext.defaultParallelism))
    width = parallel // tasks
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), REPLY])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_workers=width) as pool:
            for batch in it:
                kept, own = Kept(), asking(batch)
                for k, r in enumerate(pool.map(lambda x: attempt(provider, x), own) if width > 1 else (attempt(provider, x) for x in own)):
                    yield from kept.add(batch, k, r)
                yield from kept.flush()

    return rows.coalesce(tasks).mapInArrow(batches, schema)


def run(questions: DataFrame, provider: Callable[[str, str], dict], most_errors: int = MOST_ERRORS, parallel: int = 1, order: tuple[str, ...] = ("id",), threads: int = THREADS, wave: int = WAVE) -> DataFrame:
    """Attempts of questions ``(id, question, context, ...)`` by a provider function that returns ``text, input_tokens,
    output_tokens, thinking_tokens, latency_s, truncated``; a raised exception is stored as ``error``.

    ``parallel`` questions are asked at a time, in the given order. So many errors in a row, in that order and over all
    streams, end the run before the last of them is stored; where there are fewer questions than that, each stream takes a part
    of them. Attempts are kept in a scratch folder, so that no question is asked again when the result is read twice; about ``wave``
    questions are sorted and asked by one job. Nothing is kept of a run that dies: see ``run_stored``.
    """
    spark = questions.sparkSession
    if (n := questions.count()) < most_errors:
        return store(asked_freely(questions, provider, parallel))
    rows = _in_order(questions, order, n)
    path, got = new_folder(spark), asked(rows, provider, 0, 0, 0, most_errors, parallel, threads).drop("_no")
    _waves(rows, provider, path, None, n, -(-wave // parallel) * parallel, most_errors, parallel, threads)
    discard(rows)
    return spark.read.schema(got.schema).parquet(path)


def _in_order(questions: DataFrame, order: tuple[str, ...], n: int = 0) -> DataFrame:
    """Stored questions with their number ``_no``, in folders of ``FOLDER`` each; of ``n`` questions no task sorts more for a larger input."""
    ranges = parts(questions.sparkSession, n)
    rows = numbered(questions, order, "_no", ranges).withColumn("_folder", F.floor(F.col("_no") / FOLDER))
    return store(rows.repartitionByRange(ranges, "_no").sortWithinPartitions("_no"), "_folder")


def _waves(rows: DataFrame, provider: Callable[[str, str], dict], path: str, finish: Callable[[DataFrame], DataFrame] | None, n: int, wave: int, most_errors: int, parallel: int, threads: int) -> tuple[int, bool]:
    """Waves of ``wave`` questions of stored rows, each committed to ``path`` as a whole: how many were stored, and whether a streak ended them."""
    streak, stored = 0, 0
    for first in range(0, n, wave):
        last, seen = min(n, first + wave), Observation()
        got = asked(rows, provider, first, last, streak, most_errors, parallel, threads)
        got = got.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("error").isNull(), F.col("_no"))).alias("right"))
        io.append_attempts((finish(got) if finish else got).drop("_no"), path)
        count, right = seen.get["n"], seen.get["right"]
        stored += count
        if count < last - first:
            return stored, True
        streak = streak + count if right is None else last - 1 - right
    return stored, False


def _uri(spark, path: str) -> str | None:
    """A folder's address for the executors' own writer, None where it doesn't know such a store."""
    from pyarrow.fs import FileSystem

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    full = f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full
    try:
        FileSystem.from_uri(full)
    except Exception:  # unknown or unreachable from here
        return None
    return full


def _stretches(rows: DataFrame, provider: Callable[[str, str], dict], uri: str, n: int, wave: int, most_errors: int, parallel: int) -> tuple[int, bool]:
    """As ``_waves`` where one task asks and nothing is added to attempts: a job goes through the waves of a stretch of questions and
    its task commits each itself, as one file that is renamed when it is whole. A task that is run again goes on after its last one."""
    stored, streak, own_id = 0, 0, uuid.uuid4().hex

    def committed(first: int, last: int, bad: int):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq
            from pyarrow.fs import FileSystem, FileType

            fs, root = FileSystem.from_uri(uri)
            fs.create_dir(root, recursive=True)
            count = 0
            with ThreadPoolExecutor(max_workers=parallel) as pool:
                asks = Rounds(it, provider, pool, bad, most_errors, parallel)
                for at in range(first, last, wave):
                    end, name = min(last, at + wave), f"part-{own_id}-{at:015d}.parquet"
                    if fs.get_file_info(f"{root}/{name}").type == FileType.File:  # of an attempt of this task that died
                        wrong = [e is not None for e in pq.read_table(f"{root}/{name}", filesystem=fs, columns=["error"], partitioning=None).column("error").to_pylist()]
                        asks.upto(end)
                        count += len(wrong)
                        right = max((k for k, x in enumerate(wrong) if not x), default=None)
                        asks.streak = asks.streak + len(wrong) if right is None else len(wrong) - 1 - right
                        asks.stopped = len(wrong) < end - at
                    elif made := list(asks.ask(at, end)):
                        table = pa.Table.from_batches(made).drop_columns(["_no"])
                        passing = f"{root}/_{name}-{uuid.uuid4().hex}"
                        pq.write_table(table, passing, filesystem=fs)
                        fs.move(passing, f"{root}/{name}")
                        count += table.num_rows
                    if asks.stopped:
                        break
            yield pa.RecordBatch.from_pydict({"count": pa.array([count]), "streak": pa.array([asks.streak]), "stopped": pa.array([asks.stopped])})

        return batches

    stretch = wave * max(1, STRETCH // wave)
    for first in range(0, n, stretch):
        last = min(n, first + stretch)
        told = _between(rows, first, last).coalesce(1).sortWithinPartitions("_no").mapInArrow(committed(first, last, streak), "count bigint, streak bigint, stopped boolean").first()
        stored, streak = stored + told["count"], told["streak"]
        if told["stopped"]:
            return stored, True
    return stored, False


def run_stored(questions: DataFrame, provider: Callable[[str, str], dict], path: str, finish: Callable[[DataFrame], DataFrame] | None = None, most_errors: int = MOST_ERRORS, parallel: int = 1, every: int = EVERY, order: tuple[str, ...] = ("id",)) -> dict:
    """A run whose attempts are appended to ``path`` as it goes: ``to_ask, stored, stopped``.

    Questions with a stored attempt are not asked. The others go in waves of ``every`` questions a stream, each committed as a
    whole, so a run that dies loses less than a wave and the next call goes on from there. The streak of errors carries over
    from wave to wave, not from call to call. ``finish`` turns attempts into what is stored (as ``scored`` does) and keeps ``_no``.
    """
    done = io.load_attempts(questions.sparkSession, path)
    left = questions if done is None else to_do(questions, done)
    rows = _in_order(left, order, n := left.count())
    if finish is None and parallel <= THREADS and (uri := _uri(questions.sparkSession, path)) is not None:
        stored, stopped = _stretches(rows, provider, uri, n, every * parallel, most_errors, parallel)
    else:
        stored, stopped = _waves(rows, provider, path, finish, n, every * parallel, most_errors, parallel, THREADS)
    discard(rows)
    return {"to_ask": n, "stored": stored, "stopped": stopped}


def scored(attempts: DataFrame, model: str) -> DataFrame:
    """Attempts with ``model, predicted, parse_success, correct, cost_usd``: the tagged answer of the response against ``gold``.

    An answer counts only where it was tagged; latency has three decimals, the cost six. An error predicts nothing.
    """
    own = attempts.withColumn("_a", T.tagged_answer("raw_response")).withColumn("model", F.lit(model))
    ok = F.coalesce("error", F.lit("")) == ""
    own = own.withColumn("predicted", F.when(ok, F.col("_a.predicted")).otherwise("")).withColumn("parse_success", ok & F.col("_a.parsed"))
    own = own.withColumn("correct", F.col("parse_success") & T.numerical_match("predicted", "gold"))
    own = own.withColumn("latency_s", F.round("latency_s", 3)).drop("_a")
    return with_cost(own).withColumn("cost_usd", F.round("cost_usd", 6))


def metrics(attempts: DataFrame, model: str, regime: str, data: str) -> dict:
    """A run's metrics as JSON would hold them: rates, costs and distributions, by subtask and by standard."""
    rows = summary(attempts).collect()  # a few rows

    def shown(r) -> dict:
        return {k: r[k] for k in r.asDict() if k not in ("grouping", "key")}

    whole = next((shown(r) for r in rows if r["grouping"] == "all"), {"total": 0})
    for name, column in (("output_tokens", "output_tokens"), ("latency_s", "latency_s")):
        got = spread(attempts, column).first()
        whole[name] = got.asDict() if got is not None else {}
    for name in ("subtask", "accounting_standard"):
        whole[f"by_{name}"] = {r["key"]: shown(r) for r in sorted(rows, key=lambda r: r["key"]) if r["grouping"] == name}
    return {"model": model, "regime": regime, "data": data, "n": whole["total"], "summary": whole}


def exclusive_quantile(values: Column, p: float) -> Column:
    """Quantile by the exclusive method of a sorted array of doubles: position ``p * (n + 1)``, its index clamped to the
    array, between two values by straight line, also beyond the ends; a single value is itself."""
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor(p * (n + 1)).cast("int"), n - 1))
    a, b = F.get(values, j - 1), F.get(values, j)
    return F.when(n == 1, F.get(values, F.lit(0))).when(n > 1, a + (b - a) * (p * (n + 1) - j))


def spread(rows: DataFrame, value: str) -> DataFrame:
    """``mean, median, p90, p95, max`` of a column over all rows, three decimals; exact at any size.

    Only four order statistics are needed, so the values are counted by value with map-side combining and the cumulative
    counts give the ranks: nothing is sorted into one array.
    """
    by = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # cumulative counts in ranges of the value, then over the ranges, so that no task holds all values
    parts = by.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    parts = parts.select("x", "n", "part")
    parts = store(parts)
    sums = parts.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.join(F.broadcast(before.select("part", "before")), "part").withColumn("hi", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x")))
    whole = parts.agg(F.sum("n").alias("total"), F.sum(F.col("x") * F.col("n")).alias("sum"), F.max("x").alias("max")).first()
    names = "mean double, median double, p90 double, p95 double, max double"
    if not whole["total"]:
        return rows.sparkSession.createDataFrame([], names)
    n, lo = whole["total"], F.col("hi") - F.col("n")

    def pick(rank: int) -> Column:
        return F.max(F.when((lo < rank) & (rank <= F.col("hi")), F.col("x")))

    def spot(p: float) -> int:  # in twentieths, whole numbers throughout
        return max(1, min(round(p * 20) * (n + 1) // 20, n - 1))

    got = ranked.agg(pick((n + 1) // 2).alias("m1"), pick(n // 2 + 1).alias("m2"), *(pick(spot(p) + k).alias(f"q{int(p * 100)}_{k}") for p in (0.9, 0.95) for k in (0, 1)))

    def quantile(p: float) -> Column:
        a, b = F.col(f"q{int(p * 100)}_0"), F.col(f"q{int(p * 100)}_1")
        part = round(p * 20) * (n + 1) - spot(p) * 20
        return a if n == 1 else (a * (20 - part) + b * part) / 20

    third = (F.lit(whole["sum"] / n), (F.col("m1") + F.col("m2")) / 2, quantile(0.9), quantile(0.95), F.lit(whole["max"]))
    # rounded half to even on the exact value
    return got.select(*(plain(v, 3).cast("double").alias(k) for k, v in zip(("mean", "median", "p90", "p95", "max"), third, strict=True)))


def summary(attempts: DataFrame) -> DataFrame:
    """``grouping, key, total, accuracy_pct, parse_success_pct, truncation_rate_pct, error_rate_pct, cost_total_usd,
    cost_per_correct_usd`` for all rows, by subtask and by accounting standard, in one pass over the attempts.

    Rates are percentages with two decimals, costs have four; no cost per correct answer where none is correct. No rows
    where there are no attempts.
    """
    def pct(test):
        return F.round(100 * F.count_if(test) / F.count(F.lit(1)), 2)

    sets = attempts.groupingSets([[], ["subtask"], ["accounting_standard"]], "subtask", "accounting_standard").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("total"), pct(F.col("correct")).alias("accuracy_pct"), pct(F.col("parse_success")).alias("parse_success_pct"), pct(F.col("truncated")).alias("truncation_rate_pct"),
        pct(F.coalesce("error", F.lit("")) != "").alias("error_rate_pct"), F.sum("cost_usd").alias("cost"), F.count_if("correct").alias("right"),
    )
    name = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "subtask").otherwise("accounting_standard")
    return sets.where("total > 0").select(
        name.alias("grouping"), F.coalesce("subtask", "accounting_standard", F.lit("")).alias("key"), "total", "accuracy_pct", "parse_success_pct", "truncation_rate_pct", "error_rate_pct",
        F.round("cost", 4).alias("cost_total_usd"), F.round(F.try_divide("cost", "right"), 4).alias("cost_per_correct_usd"),
    )
