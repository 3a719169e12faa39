"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash, are cut into blocks. While all sources last, a source of weight w is due
w * t blocks after t slots; when one ends, the weights of the others are taken to 1 again. Block k of a source may start at
the slot in which its due passes k and must end by the slot in which it reaches k + 1; the earliest deadline first among the
released blocks gives a sequence in which, at every slot, every source is less than one block away from its due, and no
document is left out.

Release slots and deadlines have a closed form in whole numbers, so weights are exact and no block is ever enumerated
outside of a task. Time is cut into chunks that are scheduled in parallel: a chunk begins from the state that a short run
before it ends with; where the chunk before it turns out to end differently, it is scheduled again from that state, until
all states agree. Then the whole is the schedule that a single run from slot 0 gives. The driver sees counts by source and
the chunks' states, one byte a source, never blocks or documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ledgerlark.llm.common import MOST_BROADCAST, Scratch, by_value, table

by_value(__name__)

BLOCK = 16
#: Documents of a source in one range of the hash, about: ranges are ranked in parallel. There are about so many ranges in all
#: sources at most, beyond which ranges grow with the input.
RANGE, RANGES = 1 << 11, 1 << 17
#: A range with so many times the documents meant for it holds an id that repeats, and is parted.
HOT = 4
#: Documents in a partition of the stored mix, at most, where the session's number of partitions would give more.
ROWS = 1 << 14
#: Slots in a chunk of the schedule, at least; with many sources, so many slots a source.
SLOTS, SLOTS_A_SOURCE = 1 << 17, 64


def whole(weights: list[float | Fraction]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    least = math.lcm(*(w.denominator for w in exact)) if exact else 1
    return [int(w * least) for w in exact]


class Plan:
    """Windows of all blocks of sources 0, 1, ... with whole weights ``a`` and ``b`` blocks each, none of them 0.

    All sources advance at rates in proportion to their weights, so in a time v that runs faster when a source has ended
    source s is due min(a[s] * v, b[s]) blocks, and slot t is the sum of that over all sources: a line between two ends.
    """

    def __init__(self, a: list[int], b: list[int]):
        self.a, self.b, self.total = a, b, sum(b)
        order = sorted(range(len(a)), key=lambda s: Fraction(b[s], a[s]))
        self.num, self.den = [b[s] for s in order], [a[s] for s in order]  # ends of sources in time v
        self.at, self.rate = [], []  # slot = at + rate * v up to each end
        done, rate = 0, sum(a)
        for s in order:
            self.at.append(done)
            self.rate.append(rate)
            done, rate = done + b[s], rate - a[s]

    def line(self, s: int, k: int) -> int:
        """The first line that holds where source ``s`` is due ``k`` blocks."""
        lo, hi, a = 0, len(self.num) - 1, self.a[s]
        while lo < hi:
            mid = (lo + hi) // 2
            if k * self.den[mid] <= self.num[mid] * a:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def slot(self, s: int, k: int) -> Fraction:
        """The time at which source ``s`` is due ``k`` blocks: block k is released in its slot, block k - 1 due by its end."""
        i = self.line(s, k)
        return self.at[i] + Fraction(self.rate[i] * k, self.a[s])

    def due(self, t: int) -> list[Fraction]:
        """What every source is due after ``t`` slots."""
        lo, hi = 0, len(self.num) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if (t - self.at[mid]) * self.den[mid] <= self.rate[mid] * self.num[mid]:
                hi = mid
            else:
                lo = mid + 1
        v = Fraction(t - self.at[lo], self.rate[lo])
        return [min(a * v, Fraction(b)) for a, b in zip(self.a, self.b, strict=True)]

    def guess(self, t: int) -> list[int]:
        """Blocks done after ``t`` slots, about: what is due as a whole, and the earliest deadlines among those begun."""
        due = self.due(t)
        done = [math.floor(d) for d in due]
        begun = sorted((self.slot(s, k + 1), s) for s, (k, d) in enumerate(zip(done, due, strict=True)) if d > k)
        for _, s in begun[: t - sum(done)]:
            done[s] += 1
        return done

    def run(self, first: int, end: int, done: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Source and block of every slot from ``first`` to before ``end``, from blocks ``done`` before, and those done then."""
        a, b, k = self.a, self.b, list(done)
        ready, wait, line = [], [], [0] * len(k)
        for s, n in enumerate(k):
            if n < b[s]:
                line[s] = i = self.line(s, n)
                release = self.at[i] + self.rate[i] * n // a[s]
                (wait if release > first else ready).append((release, s))
        heapq.heapify(wait)

        def deadline(s: int) -> tuple[int, int]:
            """Deadline of the source's next block, and the release slot of the one after it."""
            n, i = k[s] + 1, line[s]
            while n * self.den[i] > self.num[i] * a[s]:
                i += 1
            line[s] = i
            x = self.rate[i] * n
            return self.at[i] - (-x // a[s]), self.at[i] + x // a[s]

        ready = [(*deadline(s)[:1], s, deadline(s)[1]) for _, s in ready]
        heapq.heapify(ready)
        source, block = np.empty(end - first, np.int32), np.empty(end - first, np.int64)
        for t in range(first, end):
            while wait and (wait[0][0] <= t or not ready):
                _, s = heapq.heappop(wait)
                d, after = deadline(s)
                heapq.heappush(ready, (d, s, after))
            _, s, after = heapq.heappop(ready)
            source[t - first], block[t - first] = s, k[s]
            k[s] += 1
            if k[s] < b[s]:
                heapq.heappush(wait, (after, s))
        return source, block, k

    def state(self, t: int, done: list[int]) -> bytes:
        """Blocks done after ``t`` slots against the whole ones due: a byte a source."""
        return np.array([n - math.floor(d) for n, d in zip(done, self.due(t), strict=True)], np.int8).tobytes()

    def done(self, t: int, state: bytes) -> list[int]:
        return [math.floor(d) + int(x) for d, x in zip(self.due(t), np.frombuffer(state, np.int8), strict=True)]


def state_batches(plan: Plan, size: int, before: int):
    """Runs chunks from their states (null: from a run of ``before`` slots) and tells their first and last states and ends of sources."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for c, state in zip(batch.column("chunk").to_pylist(), batch.column("state").to_pylist(), strict=True):
                first, end = c * size, min((c + 1) * size, plan.total)
                if state is None:
                    early = max(0, first - before)
                    done = plan.run(early, first, plan.guess(early))[2]
                else:
                    done = plan.done(first, state)
                source, block, after = plan.run(first, end, done)
                last = np.flatnonzero(block == np.array(plan.b, np.int64)[source] - 1)
                rows.append((c, plan.state(first, done), plan.state(end, after), source[last].tolist(), (last + first).tolist()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], ["chunk", "first", "last", "sources", "slots"])

    return run


def slot_batches(plan: Plan, size: int, block: int, ends: np.ndarray, short: np.ndarray):
    """Source, block, slot and first position of every block; ``short[i]`` documents fewer than ``block`` a slot after slot ``ends[i]``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for c, state in zip(batch.column("chunk").to_pylist(), batch.column("state").to_pylist(), strict=True):
                first, end = c * size, min((c + 1) * size, plan.total)
                source, number, _ = plan.run(first, end, plan.done(first, state))
                slot = np.arange(first, end)
                start = slot * block - np.concatenate([[0], np.cumsum(short)])[np.searchsorted(ends, slot, side="left")]
                for at in range(0, len(slot), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(source[part]), pa.array(number[part]), pa.array(slot[part]), pa.array(start[part])], ["mix__n", "mix__k", "mix__slot", "mix__start"])

    return run


def chunk_states(spark, plan: Plan, size: int, before: int) -> tuple[list[bytes], dict[int, int]]:
    """The state that every chunk begins with, and the slot in which every source ends."""
    n = -(-plan.total // size)
    states: list[bytes | None] = [bytes(len(plan.a)) if c == 0 else None for c in range(n)]
    found, todo = {}, list(range(n))
    while todo:
        rows = spark.createDataFrame([(c, states[c]) for c in todo], "chunk bigint, state binary")
        rows = rows.repartition(len(todo), "chunk") if len(todo) > 1 else rows
        for r in rows.mapInArrow(state_batches(plan, size, before), "chunk bigint, first binary, last binary, sources array<int>, slots array<bigint>").collect():
            found[r["chunk"]] = r
            states[r["chunk"]] = bytes(r["first"])
        todo = [c for c in range(1, n) if bytes(found[c - 1]["last"]) != states[c]]
        for c in todo:
            states[c] = bytes(found[c - 1]["last"])
    return states, {s: t for r in found.values() for s, t in zip(r["sources"], r["slots"], strict=True)}


def schedule(spark, counts: list[int], weights: list[float | Fraction], block: int, size: int | None = None, before: int | None = None) -> DataFrame:
    """``mix__n, mix__k, mix__slot, mix__start``: for every block of every source (by number) its slot and its first document's position."""
    blocks = [-(-n // block) for n in counts]
    plan = Plan(whole(weights), blocks)
    size = size or max(SLOTS, SLOTS_A_SOURCE * len(counts))
    states, ends = chunk_states(spark, plan, size, before if before is not None else 256 + 8 * len(counts))
    short = sorted((t, blocks[s] * block - counts[s]) for s, t in ends.items() if blocks[s] * block != counts[s])
    rows = spark.createDataFrame(list(enumerate(states)), "chunk bigint, state binary")
    rows = rows.repartition(len(states), "chunk") if len(states) > 1 else rows
    return rows.mapInArrow(slot_batches(plan, size, block, np.array([t for t, _ in short], np.int64), np.array([n for _, n in short], np.int64)), "mix__n int, mix__k bigint, mix__slot bigint, mix__start bigint")


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to the documents' number to ``power``: large sources come less often than they are large."""
    total = sum(n**power for n in counts.values())
    return {s: n**power / total for s, n in counts.items()}


def split_hot(rows: DataFrame, size: int) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """``rows`` with ``mix__p``, their part of a range, and ``mix__s, mix__r, mix__p`` with the rows in each, in order.

    Ids that repeat, or are null, share a range. One of more than HOT * ``size`` rows is parted by a hash of the row; rows
    alike in all columns, if so many, have parts of their own after these, dealt at random, since they are interchangeable.
    They are stored before they are counted, so that each part holds what was counted.
    """
    spark = rows.sparkSession
    counts = sorted(tuple(c) for c in rows.groupBy("mix__s", "mix__r").count().collect())
    hot = [(s, r, -(-n // size)) for s, r, n in counts if n > HOT * size]
    if not hot:
        return rows.withColumn("mix__p", F.lit(0).cast("bigint")), [(s, r, 0, n) for s, r, n in counts]
    # both tables have fewer rows than there are ranges
    parts = F.broadcast(spark.createDataFrame(hot, "mix__s int, mix__r bigint, mix__parts bigint"))
    rows = rows.join(parts, ["mix__s", "mix__r"], "left")
    key = ["mix__s", "mix__r", "h", "tie"]
    alike = [tuple(c) for c in rows.where("mix__parts IS NOT NULL").groupBy(*key).count().where(F.col("count") > HOT * size).sort(*key).collect()]
    part = F.coalesce(F.pmod(F.xxhash64("tie"), F.col("mix__parts")), F.lit(0).cast("bigint"))
    if alike:
        after, own = dict(((s, r), n) for s, r, n in hot), []
        for s, r, h, tie, n in alike:
            own.append((s, r, h, tie, after[s, r], -(-n // size)))
            after[s, r] += -(-n // size)
        groups = F.broadcast(spark.createDataFrame(own, "mix__s int, mix__r bigint, h bigint, tie bigint, mix__from bigint, mix__own bigint"))
        dealt = (F.col("mix__from") + F.floor(F.rand(7) * F.col("mix__own"))).cast("bigint")
        rows = Scratch(spark).put(rows.join(groups, key, "left").withColumn("mix__p", F.coalesce(dealt, part)).drop("mix__from", "mix__own"))
    else:
        rows = rows.withColumn("mix__p", part)
    return rows, sorted(tuple(c) for c in rows.groupBy("mix__s", "mix__r", "mix__p").count().collect())


def placed(docs: DataFrame, weights: dict[str, float] | None, block: int, id_col: str, source_col: str, size: int | None, before: int | None) -> DataFrame:
    """Every row as the struct ``own``, with ``block_no, slot, position``."""
    spark = docs.sparkSession
    all_ = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("src"), F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 40)).alias("h"), F.xxhash64(*all_).alias("tie"))
    counts = dict(sorted(tuple(r) for r in rows.groupBy("src").count().collect()))  # one row a source
    if not counts:
        return rows.select("own", *(F.lit(None).cast("bigint").alias(c) for c in ("block_no", "slot", "position")))
    if weights is None:
        weights = tempered(counts)
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights are positive")
    low = min(weights.values(), default=1.0)
    size_of = max(RANGE, sum(counts.values()) // RANGES)
    names = [(s, k, -(-n // size_of)) for k, (s, n) in enumerate(counts.items())]
    named = spark.createDataFrame(names, "mix__src string, mix__s int, mix__ranges bigint")
    named = F.broadcast(named) if len(names) <= MOST_BROADCAST else named
    rows = rows.join(named, F.col("src") == F.col("mix__src")).withColumn("mix__r", F.shiftright(F.col("h") * F.col("mix__ranges"), 40))
    rows, counted = split_hot(rows, size_of)
    cells, seen = [], dict.fromkeys(range(len(names)), 0)  # a row a range
    for s, r, sub, n in counted:
        cells.append((s, r, sub, seen[s]))
        seen[s] += n
    cell = spark.createDataFrame(cells, "mix__cs int, mix__cr bigint, mix__cp bigint, mix__before bigint")
    cell = F.broadcast(cell) if len(cells) <= MOST_BROADCAST else cell
    rank = F.row_number().over(Window.partitionBy("mix__s", "mix__r", "mix__p").orderBy("h", "id", "tie")) - 1
    on = (F.col("mix__s") == F.col("mix__cs")) & (F.col("mix__r") == F.col("mix__cr")) & (F.col("mix__p") == F.col("mix__cp"))
    rows = rows.withColumn("mix__rank", rank).join(cell, on).withColumn("mix__rank", F.col("mix__rank") + F.col("mix__before"))
    rows = rows.withColumn("block_no", F.floor(F.col("mix__rank") / block).cast("bigint"))
    slots = schedule(spark, list(counts.values()), [weights.get(s, low) for s in counts], block, size, before)
    few = sum(-(-n // block) for n in counts.values()) <= MOST_BROADCAST
    slots = F.broadcast(slots) if few else slots.hint("merge")
    out = rows.join(slots, (F.col("mix__s") == F.col("mix__n")) & (F.col("block_no") == F.col("mix__k")))
    return out.select("own", "block_no", F.col("mix__slot").alias("slot"), (F.col("mix__start") + F.pmod(F.col("mix__rank"), F.lit(block))).alias("position"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", size: int | None = None, before: int | None = None) -> DataFrame:
    """``docs`` with ``block_no`` (within its source), ``slot`` (of its block) and ``position`` (from 0, without gaps).

    ``weights`` are positive numbers by source (null: the source ``""``); sources that they don't name get the smallest
    of them; default: ``tempered``. Weights are exact. Within a source the order is that of a hash of the id (ties by the
    id and a hash of the row; where very many rows share an id, or have none, by a hash of the row first; rows alike in all
    columns are interchangeable). Every row gets one position, rows with null
    ids and repeated rows too. Columns named like the new ones are replaced. An empty table gives no rows. ``docs`` must
    give the same rows each time it is read. ``size`` and ``before`` are the slots of a chunk and of the run before it;
    they don't change the result.
    """
    out = placed(docs, weights, block, id_col, source_col, size, before)
    return out.select(*(F.col(f"own.`{c}`") for c in docs.columns if c not in ("block_no", "slot", "position")), "block_no", "slot", "position")


def in_mix_order(docs: DataFrame, partitions: int | None = None, weights: dict[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in partitions that follow each other in the mix, each in its order.

    Nulls, repeated rows and empty tables as in ``mix_sources``; columns named ``slot`` or ``position`` stay what they are.
    """
    mixed = placed(docs, weights, block, id_col, source_col, None, None)
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS))
    return mixed.repartitionByRange(n, "position").sortWithinPartitions("position").select(*(F.col(f"own.`{c}`") for c in docs.columns))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, block_no, slot, position of every document under tempered weights; an empty table gives no rows."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
