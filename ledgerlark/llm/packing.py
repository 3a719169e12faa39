"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous supersteps.

Pieces and gaps (open sequences) are range-sorted together by size. In a superstep every range sweeps for successors: its
pieces, largest first, take the smallest gaps of the range that hold them, and gaps shrink. What a range can't match is left:
pieces larger than all of its left gaps. Ranks then resolve the conflicts between ranges: the left gaps of a range go to the
largest left pieces of the ranges below that no nearer gap took, by rank, as many to a gap as surely fit. Gaps are updated, all
that is left is sorted again, and the step repeats. Where gaps no longer take much, as many sequences are opened as the
pieces left need at least. Supersteps end when what is left fits one range, which packs it by itself.

The driver sees one line a range and superstep (how many are left, the largest piece, the smallest gap), never pieces,
gaps or lengths. Pieces that fill a sequence alone take no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import Scratch, by_value, small_side, table
from ledgerlark.llm.tokens import token_pieces

by_value(__name__)

CAPACITY = 2048
#: Pieces and gaps in one range, about.
RANGE = 1 << 17
#: Places of the stored order in a range of ``pack_in_order``, at least, and about how many ranges there are at most.
ORDER_RANGE, ORDER_RANGES = 1 << 11, 1 << 17


def supersteps(counts: dict[int, int], capacity: int, open_gaps: list[tuple[int, int, int]] = (), opens: bool = True) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces, pieces a sequence, first sequence, offset)`` of best fit in decreasing order.

    ``open_gaps`` are runs ``(gap, first sequence, sequences)`` numbered from 0; with ``opens`` further sequences are opened
    behind them, else pieces that no gap holds are left out.
    """
    runs, gaps, sizes, fresh = [], {}, [], sum(n for _, _, n in open_gaps)

    def open_gap(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, many))

    for run in open_gaps:
        open_gap(*run)
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            elif opens:
                gap, first, many = capacity, fresh, -(-left // (capacity // length))
                fresh += many
            else:
                break
            each = gap // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - gap))
                open_gap(gap - each * length, first, full)
                rank, left, first, many = rank + full * each, left - full * each, first + full, many - full
            if left and many:
                runs.append((length, rank, left, left, first, capacity - gap))
                open_gap(gap - left * length, first, 1)
                first, many, left = first + 1, many - 1, 0
            open_gap(gap, first, many)
    return runs


#: What a sweep says of a row: a piece in its place, a piece that is left, a gap that no piece took, a gap that shrank.
PLACED, LEFT, UNTOUCHED, SHRUNK = range(4)
SWEPT = "part int, state int, size int, num bigint, at bigint, rank bigint, seq bigint, offset int"


def sweep_batches(capacity: int, fresh: int | None):
    """Best fit inside a range, from rows sorted by size, pieces (kind 0) before gaps (kind 1), later places first.

    With ``fresh`` sequences are opened from that number on and no piece is left. ``rank`` counts left pieces from the largest
    and untouched gaps from the smallest.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)  # one range
        kind, size, num, at = (rows.column(c).to_numpy() for c in ("kind", "size", "num", "at"))
        pieces, gaps = np.flatnonzero(kind == 0)[::-1], np.flatnonzero(kind == 1)
        own, first, many = (x.tolist() for x in np.unique(-size[pieces], return_index=True, return_counts=True))
        begin = {-s: f for s, f in zip(own, first, strict=True)}
        runs = supersteps({-s: n for s, n in zip(own, many, strict=True)}, capacity, [(s, f, n) for s, f, n in zip(*(x.tolist() for x in np.unique(size[gaps], return_index=True, return_counts=True)), strict=True)], fresh is not None)
        where, offset = np.full(len(pieces), -1, np.int64), np.zeros(len(pieces), np.int64)
        for length, rank, n, each, to, base in runs:
            k = np.arange(n)
            where[begin[length] + rank + k] = to + k // each
            offset[begin[length] + rank + k] = base + k % each * length
        taken = np.zeros(len(gaps) + int(max(where.max(initial=-1) + 1 - len(gaps), 0)), np.int64)
        put = where >= 0
        np.add.at(taken, where[put], size[pieces][put])
        sequence = np.concatenate([num[gaps], (fresh or 0) + np.arange(len(taken) - len(gaps))])
        untouched = taken[: len(gaps)] == 0
        cols = {
            "state": np.concatenate([np.where(put, PLACED, LEFT), np.where(untouched, UNTOUCHED, SHRUNK)]), "size": np.concatenate([size[pieces], size[gaps] - taken[: len(gaps)]]), "num": np.concatenate([num[pieces], num[gaps]]), "at": np.concatenate([at[pieces], at[gaps]]),
            "rank": np.concatenate([np.cumsum(~put) - 1, np.cumsum(untouched) - 1]), "seq": np.concatenate([np.where(put, sequence[where] if len(sequence) else -1, -1), num[gaps]]), "offset": np.concatenate([offset, capacity - size[gaps]]),
        }
        part = TaskContext.get().partitionId()
        kinds = {"state": pa.int32(), "size": pa.int32(), "offset": pa.int32()}
        for a in range(0, len(kind), 1 << 16):
            cut = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind[cut]), part), pa.int32()), *(pa.array(v[cut], kinds.get(c, pa.int64())) for c, v in cols.items())], ["part", *cols])

    return run


def match_ranges(left: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which left pieces go to which untouched gaps, from ``(range, left pieces, largest, untouched gaps, smallest)`` in order of size.

    Runs ``(range of the pieces, first rank, pieces, range of the gaps, first rank, pieces a gap)``. Gaps take from the
    nearest range below that has pieces left, so a gap's pieces are the largest that no smaller gap took.
    """
    stack: list[list[int]] = []  # range, first rank, pieces, largest
    out = []
    for part, pieces, largest, gaps, smallest in sorted(left):
        at = 0
        while at < gaps and stack:
            below, rank, n, most = stack[-1]
            each = max(1, smallest // most)
            used = min(gaps - at, -(-n // each))
            take = min(n, used * each)
            out.append((below, rank, take, part, at, each))
            at += used
            if take == n:
                stack.pop()
            else:
                stack[-1][1:3] = [rank + take, n - take]
        if pieces:
            stack.append([part, 0, pieces, largest])
    return out


def places(items: DataFrame, store: Scratch, capacity: int, rows_a_range: int) -> DataFrame:
    """``num, seq, offset`` of every piece of ``items (num, size, at)``, all shorter than ``capacity``."""
    spark = items.sparkSession

    def state(items: DataFrame):
        return items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("volume"), F.count_if(2 * F.col("size") > capacity).alias("large"), F.min("size").alias("least")).first()

    now = state(items)
    found, fresh, gaps, n_gaps, opens = [], 0, None, 0, True
    while now["n"]:
        rows = items.select(F.lit(0).alias("kind"), "size", "num", "at")
        if gaps is not None:
            rows = rows.unionByName(gaps.where(F.col("size") >= now["least"]))
        if now["n"] + n_gaps <= rows_a_range:
            last = rows.coalesce(1).sortWithinPartitions("size", "kind", F.desc("at"), "num").mapInArrow(sweep_batches(capacity, fresh), SWEPT)
            found.append(last.where(F.col("state") == PLACED).select("num", "seq", "offset"))
            break
        if opens:
            many = max(-(-now["volume"] // capacity), now["large"])
            rows = rows.unionByName(spark.range(fresh, fresh + many).select(F.lit(1).alias("kind"), F.lit(capacity).alias("size"), F.col("id").alias("num"), F.col("id").alias("at")))
            fresh, n_gaps = fresh + many, n_gaps + many
        ranges = -(-(now["n"] + n_gaps) // rows_a_range)
        dealt = rows.repartitionByRange(ranges, "size", "kind", F.desc("at"), "num").sortWithinPartitions("size", "kind", F.desc("at"), "num")
        swept = store.put(dealt.mapInArrow(sweep_batches(capacity, None), SWEPT))
        is_left, is_gap = F.col("state") == LEFT, F.col("state") == UNTOUCHED
        lines = swept.groupBy("part").agg(F.count_if(is_left), F.max(F.when(is_left, F.col("size"))), F.count_if(is_gap), F.min(F.when(is_gap, F.col("size")))).collect()  # a line a range
        runs = match_ranges([tuple(x or 0 for x in r) for r in lines]) or [(-1, 0, 0, -1, 0, 1)]
        run = F.broadcast(spark.createDataFrame(runs, "below int, piece_rank bigint, pieces bigint, above int, gap_rank bigint, each int"))  # two lines a range at most
        to = F.col("gap_rank") + F.floor((F.col("rank") - F.col("piece_rank")) / F.col("each")).cast("bigint")
        pieces = swept.where(is_left).join(run, (F.col("part") == F.col("below")) & (F.col("rank") >= F.col("piece_rank")) & (F.col("rank") < F.col("piece_rank") + F.col("pieces")), "left")
        pieces = pieces.select("num", "size", "at", F.col("rank").alias("piece_rank"), "above", F.when(F.col("above").isNotNull(), to).alias("to"))
        holds = swept.where(is_gap).select(F.col("part").alias("above"), F.col("rank").alias("to"), F.col("num").alias("seq"), F.col("size").alias("gap"))
        own = Window.partitionBy("above", "to").orderBy("piece_rank").rowsBetween(Window.unboundedPreceding, -1)  # `capacity` pieces at most
        matched = pieces.where("above IS NOT NULL").join(holds, ["above", "to"]).withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0)))
        matched = store.put(matched.select("num", "size", "seq", "gap", (capacity - F.col("gap") + F.col("before")).cast("int").alias("offset")))
        found += [swept.where(F.col("state") == PLACED).select("num", "seq", "offset"), matched.select("num", "seq", "offset")]
        items = pieces.where("above IS NULL").select("num", "size", "at")
        shrunk = matched.groupBy("seq").agg((F.min("gap") - F.sum("size")).cast("int").alias("size")).select("size", F.col("seq").alias("num"))
        idle = swept.where(is_gap).select("size", "num").join(matched.select(F.col("seq").alias("num")).distinct(), "num", "left_anti")
        gaps = shrunk.unionByName(swept.where(F.col("state") == SHRUNK).select("size", "num")).unionByName(idle.select("size", "num")).select(F.lit(1).alias("kind"), "size", "num", F.col("num").alias("at"))
        items, gaps = store.put(items), store.put(gaps.where("size > 0"))
        before = now["n"]
        now = state(items)
        n_gaps = gaps.where(F.col("size") >= (now["least"] or 0)).count()
        opens = before - now["n"] < before / 8
    out = spark.createDataFrame([], "num bigint, seq bigint, offset int")
    for part in found:
        out = out.unionByName(part)
    return out


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece"), order: Column | None = None, rows_a_range: int = RANGE) -> DataFrame:
    """``pieces`` (any columns, among them ``length``) with ``sequence_id`` and ``offset``.

    Every row is placed once, repeated rows too (they are alike, so either takes either place). Lengths lie between 1 and
    ``capacity``; others, and null ones, raise an error. Nulls in the key are a key like any other. No rows in, no rows
    out. Pieces of equal length are ranked by ``order``, a whole number, by default a hash of the key. Columns named
    ``sequence_id`` or ``offset`` are replaced. ``rows_a_range`` is how many rows a task sorts; it changes which of many
    equally good packings comes out.
    """
    store = Scratch(pieces.sparkSession)
    at = F.coalesce(F.xxhash64(*key) if order is None else order, F.lit(0)).cast("bigint")
    rows = store.put(pieces.select(F.struct(*(F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset"))).alias("own"), F.col("length").alias("size"), at.alias("at"), F.monotonically_increasing_id().alias("num")))
    odd = rows.where(F.col("size").isNull() | ~F.col("size").between(1, capacity)).select("size").first()
    if odd is not None:
        raise ValueError(f"a piece of length {odd[0]} fits no sequence of {capacity}")
    out = [F.col("own.*")]
    full = rows.where(F.col("size") == capacity).select(*out, (-1 - F.col("num")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = rows.where(F.col("size") < capacity)
    found = store.put(places(rest.select("num", F.col("size").cast("int").alias("size"), "at"), store, capacity, rows_a_range)).withColumnsRenamed({"num": "pack__num", "offset": "pack__offset"})
    placed = rest.join(small_side(found), F.col("num") == F.col("pack__num")).select(*out, F.col("seq").alias("sequence_id"), F.col("pack__offset").cast("bigint").alias("offset"))
    return full.unionByName(placed)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_pieces, ids, doc_ids, offsets``: the packed sequences themselves, ids as little-endian 32-bit values.

    Null doc ids are entries like others; no rows give no sequences.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(own.alias("own"))  # a sequence holds `capacity` pieces at most
    return grouped.select("sequence_id", F.size("own").alias("n_pieces"), F.expr("unhex(array_join(transform(own, x -> hex(x.ids)), ''))").alias("ids"), F.col("own.doc_id").alias("doc_ids"), F.col("own.offset").alias("offsets"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (or ``ids_crc32``), ``sequence_id, offset`` for every piece of every document.

    A null or empty text is one piece of one token; rows with null or repeated ids each give their own pieces; an empty
    table gives no rows; other columns are ignored.
    """
    pieces = token_pieces(docs, capacity)
    if digest:
        pieces = pieces.selectExpr("doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32")
    return best_fit(pieces, capacity)


def file_order(name: str) -> tuple:
    """Sort key of a written file: its folder, the numbers of its part and of the file in it, then its name."""
    folder, _, own = name.rpartition("/")
    part, file = (re.search(pattern, own) for pattern in (r"part-(\d+)", r"-c(\d+)\."))
    return folder, int(part[1]) if part else -1, int(file[1]) if file else -1, own


def stored_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs``, read from Parquet files, with ``pack__at``: the place of each row, from 0 without gaps, in the files' order; and
    how many rows there are."""
    placed = docs.select("*", F.col("_metadata.file_path").alias("pack__file"), F.col("_metadata.row_index").alias("pack__row"))
    files, total = [], 0
    for name, n in sorted((tuple(r) for r in placed.groupBy("pack__file").count().collect()), key=lambda r: file_order(r[0])):  # one row a file
        files.append((name, total))
        total += n
    first = F.broadcast(docs.sparkSession.createDataFrame(files or [("", 0)], "pack__name string, pack__before bigint"))
    out = placed.join(first, F.col("pack__file") == F.col("pack__name"))
    return out.select(*docs.columns, (F.col("pack__before") + F.col("pack__row")).alias("pack__at")), total


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Digest columns as of ``pack_documents``, for documents read from Parquet files whose order decides.

    Pieces of one length are ranked in the stored order, and sequences are numbered by the piece in them that is stored
    first. Null texts and ids, repeated rows and empty tables as in ``pack_documents``.
    """
    store = Scratch(docs.sparkSession)
    rows, total = stored_order(docs)
    size = max(ORDER_RANGE, total // ORDER_RANGES)
    rows = rows.select(F.struct("doc_id", "pack__at").alias("own"), "text")
    pieces = token_pieces(rows, capacity, id_col="own").selectExpr("own.doc_id AS doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32", "own.pack__at AS pack__at")
    packed = store.put(best_fit(pieces, capacity, order=F.col("pack__at")))
    # sequences ranked by their first piece, in ranges of the order
    firsts = store.put(packed.groupBy("sequence_id").agg(F.min(F.struct("pack__at", "piece")).alias("first")).withColumn("part", F.floor(F.col("first.pack__at") / size)))
    before, n = [], 0
    for k, own in sorted(tuple(r) for r in firsts.groupBy("part").count().collect()):
        before.append((k, n))
        n += own
    start = F.broadcast(docs.sparkSession.createDataFrame(before or [(0, 0)], "part bigint, before bigint"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    numbered = store.put(firsts.join(start, "part").select(F.col("sequence_id").alias("pack__old"), number.cast("bigint").alias("pack__new")))
    out = packed.join(small_side(numbered), F.col("sequence_id") == F.col("pack__old"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("pack__new").alias("sequence_id"), "offset")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; null texts are one token, no rows give none."""
    return pack_documents(table(spark, sf_dir, "documents"), digest=True)
