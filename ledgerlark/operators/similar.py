"""Similar texts of a block: all pairs over a Jaccard similarity of character 3-grams, and who stays when rows go in turn.

Sets of 3-grams of one language overlap by half whatever the texts say, so rare grams or signatures hardly thin out the
pairs of a block. The pairs are counted exactly instead, many at a time: a task holds one tile of a block (or two), grams are
numbers made of three code points, frequent ones are counted by a matrix product, rare ones by their own few pairs. Blocks of
more rows than a tile are cut by size classes, of which only neighbours can hold a pair, and each class into tiles. Texts move
once, to their tile in a folder that all executors reach; what is dealt to tasks is pairs of tile numbers.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.scratch import discard, new_folder, parts, store
from ledgerlark.ship import by_value

by_value(__name__)

#: Rows of a tile, and of the parts in which a task compares tiles.
TILE = 2048
PART = 2048
#: Pairs that one task decides at a time.
MOST_PAIRS = 1 << 20
#: Bytes of a row group of stored tiles, row groups and files that a task holds, and pairs of tiles that it compares, about.
GROUP, HELD, DEALT = 4 << 20, 8, 64


def grams_of(text: str, n: int = 3) -> np.ndarray:
    """The distinct runs of three characters of a text as sorted numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) >= n else np.zeros(0, np.uint64)


def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``n``, the number of their grams."""
    for batch in it:
        n = [len(grams_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], [*batch.schema.names, "n"])


def shared(rows: list[np.ndarray], cut: int) -> np.ndarray:
    """How many grams each of the first ``cut`` sets shares with each of the others (``cut`` 0: all with all)."""
    size = len(rows)
    owner = np.repeat(np.arange(size), [len(g) for g in rows])
    gram, place, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    left, right = (slice(cut), slice(cut, size)) if cut else (slice(size), slice(size))
    out = np.zeros((cut, size - cut) if cut else (size, size), np.float32)
    dense = often >= max(2, size // 64)
    column = np.cumsum(dense) - 1
    wide = dense[place]
    for at in range(0, int(dense.sum()), 4096):
        mine = wide & (column[place] >= at) & (column[place] < at + 4096)
        m = np.zeros((size, min(4096, int(dense.sum()) - at)), np.float32)
        m[owner[mine], column[place[mine]] - at] = 1
        out += m[left] @ m[right].T  # of two sides only what lies across
    rare = ~wide & (often[place] > 1)
    order = np.lexsort((owner[rare], place[rare]))
    o, p = owner[rare][order], place[rare][order]
    for step in range(1, int(often[~dense].max(initial=0))):
        same = np.flatnonzero(p[step:] == p[:-step])
        x, y = o[same], o[same + step]  # x < y
        if cut:
            across = (x < cut) & (y >= cut)
            np.add.at(out, (x[across], y[across] - cut), 1)
        else:
            np.add.at(out, (x, y), 1)
            np.add.at(out, (y, x), 1)
    return out


def pairs_of(threshold: float):
    """Similar pairs of a task's rows: of side 0 with each other, or, where there is a side 1, of side 0 with side 1."""

    def run(rows: pa.Table) -> pa.Table:
        side, pos = rows.column("side").to_numpy(), rows.column("pos").to_numpy()
        order = np.argsort(side, kind="stable")
        sets = [grams_of(t) for t in rows.column("text").to_pylist()]
        left, right = ([k for k in order if side[k] == s] for s in (0, 1))
        names = [f for f in rows.schema.names if f.startswith("_k")]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # a tile may be empty
        for x in range(0, len(left), PART):
            for y in range(0, len(right), PART) if right else range(x, len(left), PART):
                one, two = left[x : x + PART], (right or left)[y : y + PART]
                itself = not right and x == y
                both = shared([sets[k] for k in (one if itself else one + two)], 0 if itself else len(one)).astype(float)
                n, m = (np.array([len(sets[k]) for k in own], float) for own in (one, two))
                near = both / (n[:, None] + m[None, :] - both) > threshold
                i, j = np.nonzero(np.triu(near, 1) if itself else near)
                i, j = pos[np.array(one, int)[i]], pos[np.array(two, int)[j]]
                a.append(np.minimum(i, j))
                b.append(np.maximum(i, j))
        a, b = np.concatenate(a), np.concatenate(b)
        keys = [pa.array([rows.column(k)[0].as_py()] * len(a), pa.string()) for k in names]
        return pa.table([*keys, pa.array(a, pa.int64()), pa.array(b, pa.int64())], [*names, "a", "b"])

    return run


class Tiles:
    """Tiles in a folder of Parquet files sorted by ``_no``; ``files``: ``(first _no, name)``, sorted. The row groups last read are held."""

    def __init__(self, path: str, files: list[tuple[int, str]]):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(path)
        self.first, self.names = [f[0] for f in files], [f[1] for f in files]
        self.open, self.groups = OrderedDict(), OrderedDict()

    @staticmethod
    def held(own: OrderedDict, key, make):
        if key in own:
            own.move_to_end(key)
        else:
            own[key] = make()
            if len(own) > HELD:
                own.popitem(last=False)
        return own[key]

    def file(self, name: str):
        import pyarrow.parquet as pq

        own = pq.ParquetFile(self.fs.open_input_file(f"{self.root.rstrip('/')}/{name}"))
        kinds = [own.metadata.row_group(k).column(0).statistics for k in range(own.metadata.num_row_groups)]
        return own, [x.min for x in kinds], [x.max for x in kinds]

    def rows(self, no: int) -> pa.Table | None:
        """``pos, text`` of a tile; None for an empty one."""
        if (at := bisect_right(self.first, no) - 1) < 0:
            return None
        own, low, high = self.held(self.open, at, lambda: self.file(self.names[at]))
        found = []
        for k in range(len(low)):
            if low[k] <= no <= high[k]:
                numbers, table = self.held(self.groups, (at, k), lambda: self.group(own, k))
                lo, hi = np.searchsorted(numbers, [no, no + 1])
                found.append(table.slice(lo, hi - lo))
        out = pa.concat_tables(found) if found else None
        return out if out is not None and out.num_rows else None

    @staticmethod
    def group(own, k: int) -> tuple[np.ndarray, pa.Table]:
        table = own.read_row_group(k, columns=["_no", "pos", "text"])
        return table.column("_no").to_numpy(), table.select(["pos", "text"])


def in_tiles(rows: DataFrame, names: list[str], step: float, tile: int, run, result: str) -> DataFrame:
    """``run`` over stored rows ``(names..., pos, text, n)``, names ``_k0, _k1, ...``, so that any two rows of a block whose sizes
    ``n`` differ by a factor of ``step`` at most meet exactly once; its results are stored.

    A block of up to ``tile`` rows is one tile. Others are cut by size classes, each ``step`` times the size of the one before,
    and a class into tiles by a hash. One tile (side 0), or two of a class or of neighbouring ones (sides 0 and 1), are compared at
    a time. Rows are stored once, sorted by tile; a block of m rows makes about (m / tile) squared pairs of numbers, and a task reads the
    tiles of its pairs.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"))
    own = rows.join(sizes, names).withColumn("_class", F.when(F.col("_rows") <= tile, -1).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(step))).cast("int"))
    kinds = own.groupBy(*names, "_class").agg(F.count(F.lit(1)).alias("_own"))
    kinds = store(kinds.withColumn("_tiles", F.ceil(F.col("_own") / tile).cast("bigint")).withColumn("_part", F.spark_partition_id()))
    before = kinds.groupBy("_part").agg(F.sum("_tiles").alias("_sum"))  # a row a part
    before = before.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_tiles").over(Window.partitionBy("_part").orderBy(*names, "_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = store(kinds.join(F.broadcast(before), "_part").select(*names, "_class", "_own", "_tiles", (F.col("_before") + inside).alias("_first")))
    dealt = own.join(placed, [*names, "_class"]).select((F.col("_first") + F.pmod(F.xxhash64("pos"), F.col("_tiles"))).alias("_no"), "pos", "text")
    path, n = new_folder(spark), placed.agg(F.sum("_own")).first()[0] or 0
    dealt.repartitionByRange(parts(spark, n), "_no").sortWithinPartitions("_no").write.option("parquet.block.size", GROUP).parquet(path)
    stored = spark.read.schema("_no bigint, pos bigint, text string").parquet(path)
    stored._scratch_path = path
    files = sorted((r["lo"], r["name"]) for r in stored.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min("_no").alias("lo")).collect())  # a row a file

    def upto(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    lower = placed.where("_own > 1").select(*names, "_first", "_tiles", upto(F.col("_tiles")).alias("_t"))
    within = lower.select(*names, (F.col("_first") + F.col("_t")).alias("i"), F.explode(F.sequence(F.col("_first") + F.col("_t"), F.col("_first") + F.col("_tiles") - 1)).alias("j"))
    above = placed.select(*names, (F.col("_class") - 1).alias("_class"), F.col("_tiles").alias("_above"), F.col("_first").alias("_next"))
    up = placed.where("_class >= 0").join(above, [*names, "_class"]).select(*names, "_first", "_next", "_above", upto(F.col("_tiles")).alias("_t"))
    up = up.select(*names, (F.col("_first") + F.col("_t")).alias("i"), F.explode(F.sequence(F.col("_next"), F.col("_next") + F.col("_above") - 1)).alias("j"))
    pairs = store(within.unionByName(up))

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(path, files)
        for batch in it:
            for r in batch.to_pylist():
                both = [tiles.rows(k) for k in ((r["i"],) if r["i"] == r["j"] else (r["i"], r["j"]))]
                if any(x is None for x in both):
                    continue
                side = pa.array(np.repeat(np.arange(len(both), dtype=np.int32), [x.num_rows for x in both]))
                own = pa.concat_tables(both).append_column("side", side)
                for k in names:
                    own = own.append_column(k, pa.repeat(pa.scalar(r[k], pa.string()), own.num_rows))
                yield from run(own).to_batches()

    count = pairs.count()
    tasks = max(1, min(count, max(parts(spark, 0), 4 * spark.sparkContext.defaultParallelism, -(-count // DEALT))))
    found = store(pairs.repartitionByRange(tasks, "i", "j").sortWithinPartitions("i", "j").mapInArrow(compared, result))
    discard(kinds, placed, stored, pairs)
    return found


def gram_pairs(texts: DataFrame, names: list[str], threshold: float, tile: int = TILE) -> DataFrame:
    """``names..., a, b`` with a < b of stored rows ``(names..., pos, text)`` that are similar within one block, stored."""
    keys = ", ".join(f"{k} string" for k in names)
    rows = store(texts.mapInArrow(measured, f"{keys}, pos bigint, text string, n int").where("n > 0"))
    found = in_tiles(rows, names, 1 / threshold, tile, pairs_of(threshold), f"{keys}, a bigint, b bigint")
    discard(rows)
    return found


def taken_in_turn(rows: pa.Table) -> pa.Table:
    """``v``: what goes when rows are gone through in turn and go if an earlier one that stays is similar to them."""
    a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
    order = np.lexsort((a, b))
    gone: set = set()
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if x not in gone:
            gone.add(y)
    return pa.table([pa.array(sorted(gone), pa.int64())], ["v"])


def dropped(edges: DataFrame, names: list[str], most: int = MOST_PAIRS) -> DataFrame | None:
    """``v``: the rows that go, of stored pairs ``(names..., a, b)``; None where there are no pairs.

    Rows of a block are gone through in turn by one task. Of a block with more than ``most`` pairs that task takes those whose
    later row comes first, about as many as that; what it decides leaves fewer pairs for the next turn. So there are as many
    turns as the largest block has times ``most`` pairs, however long a chain of similar rows is.
    """
    gone = None
    halves = [2.0**-k for k in range(1, 31)]
    while True:
        counts = edges.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.max("b").alias("_last"), F.percentile_approx("b", halves, 1000).alias("_cuts"))
        depth = F.greatest(F.lit(1), F.least(F.lit(30), F.ceil(F.log2(F.col("_n") / most)).cast("int")))
        counts = store(counts.select(*names, "_n", F.when(F.col("_n") <= most, F.col("_last")).otherwise(F.element_at("_cuts", depth)).alias("_cut"), "_last"))
        whole = counts.agg(F.max("_n").alias("n"), F.max((F.col("_cut") < F.col("_last")).cast("int")).alias("more")).first()
        if whole["n"] is None:
            return gone
        own = edges.join(counts.select(*names, "_cut"), names)
        first = store(own.where("b <= _cut").select(*names, "a", "b").groupBy(*names).applyInArrow(taken_in_turn, "v bigint"))
        if not whole["more"]:
            return first if gone is None else gone.unionByName(first)
        # the rest: a later row goes if a decided row that stays is similar to it, else its decided pairs tell nothing more
        rest = own.where("b > _cut")
        stays = rest.where("a <= _cut").join(first, F.col("a") == F.col("v"), "left_anti")
        also = store(stays.select(F.col("b").alias("v")).distinct())
        lost = first.unionByName(also)
        gone = lost if gone is None else gone.unionByName(lost)
        left = rest.where("a > _cut").join(also.withColumnRenamed("v", "w"), F.col("a") == F.col("w"), "left_anti").join(also, F.col("b") == F.col("v"), "left_anti")
        edges = store(left.select(*names, "a", "b"))
