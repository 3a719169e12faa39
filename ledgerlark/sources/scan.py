"""Elements of one JSON array or object of any size, cut by many tasks.

A file is read in splits at its commas (``lineSep``), whatever its lines are. A piece between two commas changes what is
known before it in a way that depends only on whether it starts inside a text: it flips that, and it goes up or down some
levels. Such changes add up over a run of pieces, those of runs over a block, and those of blocks over the file, so the state
at each split's start follows from prefix sums over a few numbers. Then each task cuts its own split, at the commas at level 1
outside texts; only what a split holds of an element that others hold too moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.ship import by_value

by_value(__name__)

#: Pieces of a block: one row a block is summed over a file by one task.
BLOCK = 1 << 16
_KIND = np.zeros(256, np.int8)
_KIND[list(b'"\\[{]}')] = (1, 2, 3, 3, 4, 4)
_RUN = "file string, start bigint, block bigint, place bigint, n bigint, flips bigint, up0 bigint, up1 bigint, low0 bigint, at0 bigint, low1 bigint, at1 bigint"


def place() -> Column:
    """A number that rises with the place in the file, of a row of text: a split has no more rows than bytes."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _pieces(spark: SparkSession, paths: str | list[str], block: int) -> DataFrame:
    """``file, start, place, block, value`` of every piece; ``start``: that of its split."""
    rows = spark.read.text(paths, lineSep=",").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place().alias("place"), "value")
    return rows.withColumn("block", F.floor(F.col("place") / block))


class Marks:
    """Where the pieces of a batch begin and end (``n + 1`` places): ``odd``, whether an odd number of quotes precedes; ``up[s]``, the
    levels gone up before by brackets with an even (0) or odd (1) number of quotes before them."""

    def __init__(self, values: pa.Array):
        values = values.cast(pa.large_binary())
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        text = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
        ends = ends - ends[0]
        kind = _KIND[text]
        spots = np.flatnonzero(kind)
        kind = kind[spots]
        quotes, slashes = spots[kind == 1], spots[kind == 2]
        if len(slashes):  # a quote after an odd number of backslashes is text; a comma never follows a lone one, so none is cut off
            last = np.flatnonzero(np.append(np.diff(slashes) != 1, True))
            odd = np.diff(last, prepend=-1) % 2 == 1
            quotes = quotes[~np.isin(quotes, slashes[last[odd]] + 1)]
        brackets, kind = spots[kind > 2], kind[kind > 2]
        sign = np.where(kind == 3, 1, -1)
        within, before = np.searchsorted(quotes, brackets) % 2, np.searchsorted(brackets, ends)
        self.odd = np.searchsorted(quotes, ends) % 2
        self.up = [np.append(0, np.cumsum(np.where(within == s, sign, 0)))[before] for s in (0, 1)]


def _changes(file: pa.Array, *numbers: np.ndarray) -> np.ndarray:
    """Where a batch's rows differ from the row before in any of these, the first row included, and their number at the end."""
    new = np.append(True, pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) if len(file) else np.empty(0, bool)
    for x in numbers:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(file))


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the pieces of a batch that share file, split and block: what they change, and for a start outside and inside a text
    the lowest level at a comma outside texts and the last such comma."""
    names = [x.split()[0] for x in _RUN.split(", ")]
    for batch in it:
        own = {k: batch.column(k).to_numpy() for k in ("start", "place", "block")}
        marks, edges, out = Marks(batch.column("value")), _changes(batch.column("file"), own["start"], own["block"]), []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            odd, lows, ups = marks.odd[i], [], []
            for s in (0, 1):
                up = marks.up[odd ^ s]
                ups.append(int(up[j] - up[i]))
                at = np.flatnonzero(marks.odd[i + 1 : j + 1] ^ odd == s)
                levels = up[i + 1 : j + 1][at] - up[i]
                low = int(levels.min()) if len(at) else None
                lows += [low, None if low is None else int(own["place"][i + at[np.flatnonzero(levels == low)[-1]]])]
            out.append((batch.column("file")[int(i)].as_py(), *(int(own[k][i]) for k in ("start", "block", "place")), int(j - i), int(marks.odd[j] ^ odd), *ups, *lows))
        kinds = [pa.string(), *[pa.int64()] * (len(names) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)


def _starts(runs: DataFrame) -> DataFrame:
    """One row a split: ``file, start, first, n``, its first piece's place and how many it has, ``in_text, level`` there, ``open``, the place of the
    last comma at level 1 before it, and ``parted``, whether its file has other splits.

    A file that ends inside a text, or at another level than it began with, is an error.
    """
    earlier = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("inside", F.pmod(F.coalesce(F.sum("flips").over(earlier), F.lit(0)), F.lit(2)))
    for s in (0, 1):  # as if the block began outside and inside a text
        def own(name, s=s):
            return F.when(F.col("inside") == s, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

        rows = rows.withColumn(f"own{s}", own("up")).withColumn(f"rel{s}", F.coalesce(F.sum(own("up")).over(earlier), F.lit(0)))
        # within the outer brackets no level is below 1, so commas at level 1 are those at the lowest level, if any
        rows = rows.withColumn(f"bottom{s}", F.when(own("low").isNotNull(), F.struct((-F.col(f"rel{s}") - own("low")).alias("down"), own("at").alias("at"))))
    rows = rows.select("*", *(F.max(f"bottom{s}").over(earlier).alias(f"before{s}") for s in (0, 1)))
    own = F.collect_list(F.struct("start", "place", "n", "inside", "rel0", "rel1", "before0", "before1")).alias("runs")
    blocks = rows.groupBy("file", "block").agg(F.pmod(F.sum("flips"), F.lit(2)).alias("flips"), *(F.sum(f"own{s}").alias(f"up{s}") for s in (0, 1)), *(F.max(f"bottom{s}").alias(f"low{s}") for s in (0, 1)), own)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("file")
    blocks = blocks.withColumn("in_text", F.pmod(F.coalesce(F.sum("flips").over(before), F.lit(0)), F.lit(2)))
    of = {c: F.when(F.col("in_text") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("up", "low")}
    blocks = blocks.select("file", "block", "flips", "runs", "in_text", of["up"].alias("up"), of["low"].alias("low"))
    blocks = blocks.withColumn("level", F.coalesce(F.sum("up").over(before), F.lit(0)))
    comma = F.when(F.col("level") - F.col("low.down") == 1, F.col("low.at"))
    whole = (F.pmod(F.sum("flips").over(all_), F.lit(2)) == 0) & (F.sum("up").over(all_) == 0)
    level = F.when(whole, F.col("level")).otherwise(F.raise_error(F.concat(F.lit("not one whole JSON value: "), F.col("file"))).cast("bigint"))
    rows = blocks.select("file", "in_text", level.alias("level"), F.coalesce(F.max(comma).over(before), F.lit(-1)).alias("open"), "runs")
    # the sums above are over blocks: runs are parted only after them
    rows = rows.select("file", "in_text", "level", "open", F.explode("runs").alias("r")).select("file", "in_text", "level", "open", "r.*")
    # the state where a run starts: its block's, and what the runs before it in the block change
    rel, low = (F.when(F.col("in_text") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("rel", "before"))
    here = F.struct(F.col("inside").bitwiseXOR(F.col("in_text")).alias("in_text"), (F.col("level") + rel).alias("level"), F.when(F.col("level") - low["down"] == 1, low["at"]).otherwise(F.col("open")).alias("open"))
    rows = rows.select("file", "start", "place", "n", here.alias("here"))
    splits = rows.groupBy("file", "start").agg(F.min("place").alias("first"), F.sum("n").alias("n"), F.min_by("here", "place").alias("s"))
    return splits.select("file", "start", "first", "n", "s.*", (F.count(F.lit(1)).over(all_) > 1).alias("parted"))


class Cut:
    """The elements of one split, as rows of position, place, text and whether the file ends with it; texts of a split in a file of several
    that lie at its ends are shares of elements."""

    def __init__(self, split: dict):
        self.split, self.inside, self.level, self.open = split, split["in_text"], split["level"], split["open"]
        self.seen, self.held, self.head = 0, [], split["parted"]

    def _row(self, ends: bool) -> tuple:
        return self.open, self.split["first"], ",".join(self.held), ends

    def add(self, marks: Marks, values: pa.Array, places: np.ndarray, i: int, j: int) -> tuple[list, list, pa.Array | None, np.ndarray | None]:
        """Pieces i to before j of a batch: rows of shares and of wholes; texts and positions of further whole elements."""
        side = marks.odd[i] ^ self.inside
        levels = self.level + marks.up[side][i + 1 : j + 1] - marks.up[side][i]
        cuts = i + np.flatnonzero((marks.odd[i + 1 : j + 1] == side) & (levels == 1))
        self.seen, self.level, self.inside = self.seen + j - i, int(levels[-1]), int(marks.odd[j] ^ side)
        if not len(cuts):
            self.held.append(_joined(values, [i, j])[0].as_py())
            return [], [], None, None
        self.held.append(_joined(values, [i, cuts[0] + 1])[0].as_py())
        first = [self._row(False)]
        shares, wholes = (first, []) if self.head else ([], first)
        self.held, self.head, self.open = [], False, int(places[cuts[-1]])
        if cuts[-1] + 1 < j:
            self.held.append(_joined(values, [cuts[-1] + 1, j])[0].as_py())
        return shares, wholes, _joined(values, cuts + 1), places[cuts[:-1]]

    def end(self) -> tuple[list, list]:
        if self.seen != self.split["n"]:
            raise ValueError(f"splits differ between two reads: {self.split['file']}")
        rest = [self._row(self.level == 0 and not self.inside)] if self.held else []
        return (rest, []) if self.split["parted"] else ([], rest)


def _joined(values: pa.Array, edges) -> pa.Array:
    """Texts of the pieces between edges, their commas back in place."""
    edges = np.asarray(edges, np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), values), ",")


def _cutter(shares: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the pieces of splits in order. With ``shares`` only the shares of elements that a split doesn't hold whole are given, else only whole ones."""

    names, kinds = ("file", "pos", "place", "value", "ends"), (pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def given(file: str, rows: list, texts: pa.Array | None = None, pos: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)
        if texts is not None and len(texts) and not shares:
            n = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(pos), pa.array(pos), texts, pa.array([False] * n)], names)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in it:
            split, values, places = batch.column("split"), batch.column("value"), batch.column("place").to_numpy()
            marks, heads = Marks(values), np.flatnonzero(split.is_valid().to_numpy(zero_copy_only=False))
            edges = np.unique(np.concatenate([[0], heads, [batch.num_rows]]))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if split[int(i)].is_valid:
                    if now is not None:
                        yield from given(now.split["file"], now.end()[0 if shares else 1])
                    now = Cut(split[int(i)].as_py())
                if now is None:
                    raise ValueError("splits differ between two reads")
                parts, wholes, texts, pos = now.add(marks, values, places, int(i), int(j))
                yield from given(now.split["file"], parts if shares else wholes, texts, pos)
        if now is not None:
            yield from given(now.split["file"], now.end()[0 if shares else 1])

    return cut


def elements(spark: SparkSession, paths: str | list[str], block: int = BLOCK) -> DataFrame:
    """``file, pos, value``: the elements of the array that each file is, or the pairs of the object, as text; ``pos`` rises in a file.

    Blanks and a byte order mark around the outer brackets don't count. A file without any element gives no rows, a file
    that is cut off fails. Files are expected to be JSON; what is wrong within an element shows when it is parsed. Files are read
    twice, those of several splits three times; only shares of elements at the splits' ends move; the driver passes on a row a split.
    """
    pieces = _pieces(spark, paths, block)
    starts = _starts(pieces.mapInArrow(_runs, _RUN))
    # the broadcast row of a split comes with its first piece only
    names = ("file", "n", "in_text", "level", "open", "parted", "first")
    split = F.when(F.col("place") == F.col("first"), F.struct(*names)).alias("split")
    schema = "file string, pos bigint, place bigint, value string, ends boolean"
    whole = pieces.join(F.broadcast(starts), ["file", "start"], "left").select("place", "value", split).mapInArrow(_cutter(False), schema).select("file", "pos", "value", "ends")
    shares = pieces.join(F.broadcast(starts), ["file", "start"]).where("parted").select("place", "value", split).mapInArrow(_cutter(True), schema)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), ",", "")
    out = whole.unionByName(shares.groupBy("file", "pos").agg(text.alias("value"), F.max("ends").alias("ends")))
    value = F.when(F.col("pos") == -1, F.regexp_replace("value", r"^[\s\x{FEFF}]*[\[{]", "")).otherwise(F.col("value"))
    out = out.withColumn("value", value)
    value = F.when(F.col("ends"), F.regexp_replace("value", r"[\]}]\s*\z", "")).otherwise(F.col("value"))
    return out.select("file", "pos", F.regexp_replace(value, r"^\s+|\s+\z", "").alias("value")).where("value <> '' OR pos >= 0")
