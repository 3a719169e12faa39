"""Phrase collocations from compressed position bitmaps, in the manner of SPAM.

A shard is a run of texts of one language. For every word it holds the positions of the word as a bitmap, compressed to the
16-bit blocks that aren't zero; a hole in the positions stands between pieces. Shifting a phrase's bitmap by one and joining it
by AND with those of its continuations gives the bitmaps of all longer phrases, none of which crosses a hole, and popcounts
are their numbers.

A phrase can be frequent overall and rare in every shard, so popcounts are summed over shards after each step, and only
phrases that are frequent overall are extended. A phrase of k words is the pair of its first and its last k - 1 words, both
frequent, so what moves are pairs of numbers. The frequent ones travel to the shards' tasks up to a counted number; beyond it
joins bring each shard those that it holds, as sorted rows: a task has those of one shard at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import MOST_BROADCAST, Scratch, by_value, table

by_value(__name__)

LEAST = 100
LONGEST = 5
TOP = 2000
#: Words of a shard, and words that a task holds for all its languages together.
SHARD_WORDS = 1 << 19
HELD_WORDS = 1 << 21
#: Positions of a block of a bitmap.
BITS = 16
#: Pairs of blocks that are joined at a time.
PAIRS = 1 << 21

#: Lower case for A-Z, a full stop for every end of a piece.
_FOLD = bytearray(range(256))
_FOLD[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 46
FOLD = bytes(_FOLD)
HOLE = b"."

STATE = "shard bigint, skip int, ids array<bigint>, sizes binary, block binary, mask binary"


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text in order, HOLE where a piece ends."""
    return text.translate(FOLD).replace(HOLE, b" . ").split()


def bitmaps(owner: np.ndarray, position: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks that aren't zero, sorted by owner and block: how many each of ``n`` owners has, their numbers and bits."""
    block = position // BITS
    order = np.lexsort((block, owner))
    o, b, bit = owner[order], block[order], np.left_shift(1, position[order] % BITS).astype(np.uint16)
    if not len(o):
        return np.zeros(n, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.uint16)
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (b[1:] != b[:-1])]))
    return np.bincount(o[first], minlength=n).astype(np.int32), b[first].astype(np.uint32), np.bitwise_or.reduceat(bit, first)


class Buffer:
    """Tokens of one language that wait for a shard, and how many words before them are only context."""

    def __init__(self):
        self.vocabulary: defaultdict = defaultdict(count().__next__)
        self.vocabulary[HOLE]  # number 0
        self.parts, self.size, self.skip = [], 0, 0

    def add(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def shard(self) -> tuple | None:
        """Words, their counts, and the bitmaps of what waits; the buffer starts afresh."""
        own = np.concatenate([*self.parts, [0]])
        own = own[(own != 0) | (np.concatenate([[1], own[:-1]]) != 0)]  # one hole is enough
        words, skip = list(self.vocabulary)[1:], self.skip
        at = np.flatnonzero(own)
        if not len(at):
            return None
        counted = np.bincount(own[at[skip:]], minlength=len(words) + 1)[1:]
        return skip, words, counted, *bitmaps(own[at] - 1, at, len(words))


def shards(most: int = SHARD_WORDS, held: int = HELD_WORDS, longest: int = LONGEST):
    """Shards of the texts ``(lang, text)`` of a partition. A piece that goes on into the next shard starts there with its last
    words as context: they are in the bitmaps, so phrases go on, but what ends within them is not counted again."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = count((TaskContext.get().partitionId() << 32) if TaskContext.get() else 0)
        waiting: dict[str, Buffer] = {}

        def flush(lang: str, context: list[bytes]) -> Iterator[pa.RecordBatch]:
            made = waiting.pop(lang).shard()
            if context:
                nxt = waiting[lang] = Buffer()
                nxt.add(context)
                nxt.skip = len(context)
            if made is not None:
                skip, words, counted, sizes, block, mask = made
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(number)]), pa.array([lang]), pa.array([skip], pa.int32()), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counted.tolist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, block, mask))],
                    ["shard", "lang", "skip", "words", "counts", "sizes", "block", "mask"],
                )

        for batch in it:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = tokens_of(text)
                at = 0
                while at < len(tokens):
                    own = waiting.setdefault(lang, Buffer())
                    part = tokens[at : at + most - own.size + own.skip]
                    own.add(part)
                    at += len(part)
                    if own.size - own.skip >= most:
                        tail = tokens[max(0, at - longest + 1) : at] if at < len(tokens) else []
                        while HOLE in tail:
                            tail = tail[tail.index(HOLE) + 1 :]
                        yield from flush(lang, tail)
                if lang in waiting:
                    waiting[lang].add([HOLE])
            while sum(b.size for b in waiting.values()) > held:
                yield from flush(max(waiting, key=lambda k: waiting[k].size), [])
        for lang in list(waiting):
            yield from flush(lang, [])

    return run


def shifted(owner: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bitmaps moved on by one position: bits that leave a block enter the next one."""
    within, over = (mask.astype(np.uint32) << 1).astype(np.uint16), mask >> (BITS - 1)
    a, b = np.flatnonzero(within), np.flatnonzero(over)
    return np.concatenate([owner[a], owner[b]]), np.concatenate([block[a], block[b] + 1]), np.concatenate([within[a], over[b]])


def joined(left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``left owner, right owner, block, bits`` wherever bitmaps of both sides have a bit in common, some blocks at a time."""
    lo, lb, lm = left
    order = np.argsort(right[1], kind="stable")
    ro, rb, rm = (x[order] for x in right)
    order = np.argsort(lb, kind="stable")
    lo, lb, lm = lo[order], lb[order], lm[order]
    first, last = np.searchsorted(rb, lb, "left"), np.searchsorted(rb, lb, "right")
    ends = np.cumsum(last - first)
    at = 0
    while at < len(lo):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        many = (last - first)[at:stop]
        mine = np.repeat(np.arange(at, stop), many)
        other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at:stop], many)
        bits = lm[mine] & rm[other]
        hit = np.flatnonzero(bits)
        yield lo[mine[hit]], ro[other[hit]], lb[mine[hit]], bits[hit]
        at = stop


def read_state(batch: pa.RecordBatch, row: int) -> tuple:
    """``ids, (owner, block, mask)`` of a stored shard; owners count from 0 in the order of ids."""
    ids = batch.column("ids")[row].values.to_numpy(zero_copy_only=False)
    sizes, block, mask = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in (("sizes", np.int32), ("block", np.uint32), ("mask", np.uint16)))
    return ids, (np.repeat(np.arange(len(sizes)), sizes), block, mask)


def state_batch(shard: int, skip: int, ids: np.ndarray, sizes: np.ndarray, block: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([skip], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([sizes.tobytes()], pa.binary()), pa.array([block.tobytes()], pa.binary()), pa.array([mask.tobytes()], pa.binary())],
        ["shard", "skip", "ids", "sizes", "block", "mask"],
    )


def taken(batch: pa.RecordBatch, row: int, place: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The bitmaps of a shard's words at some places of its vocabulary, as those of ``ids``."""
    if not len(ids):
        return
    sizes, block, mask = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in (("sizes", np.int32), ("block", np.uint32), ("mask", np.uint16)))
    order = np.argsort(place)
    place, ids = place[order], ids[order]
    keep = np.zeros(len(sizes), bool)
    keep[place] = True
    own = np.repeat(keep, sizes)
    yield state_batch(batch.column("shard")[row].as_py(), batch.column("skip")[row].as_py(), ids, sizes[place], block[own], mask[own])


def own_words(known: dict[str, dict[str, int]]):
    """The bitmaps of a shard's frequent words: those of its language in ``known`` (word to id)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in range(batch.num_rows):
                own = known.get(batch.column("lang")[row].as_py(), {})
                pairs = [(k, own[w]) for k, w in enumerate(batch.column("words")[row].as_py()) if w in own]
                yield from taken(batch, row, *(np.array([p[k] for p in pairs], np.int64) for k in range(2)))

    return run


def one_state(made: Iterator[pa.RecordBatch]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_batches(list(made), pa.schema(list(zip(("shard", "skip", "ids", "sizes", "block", "mask"), kinds, strict=True))))


def own_words_found(shard: pa.Table, found: pa.Table) -> pa.Table:
    """The same of one shard, whose frequent words are rows ``at, id``."""
    place, ids = (found.column(c).to_numpy() for c in ("at", "id"))
    return one_state(x for batch in shard.to_batches() for row in range(batch.num_rows) for x in taken(batch, row, place, ids))


def popcounts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard, a, b, c``: how often phrase ``b`` ends a position after phrase ``a`` in a shard. Ends within the context of the
    shard aren't counted, but their pairs are there, with 0 where there are no others."""
    for batch in it:
        for row in range(batch.num_rows):
            ids, maps = read_state(batch, row)
            context = np.uint16((1 << batch.column("skip")[row].as_py()) - 1)
            keys, sums = [], []
            for a, b, block, bits in joined(shifted(*maps), maps):
                keys.append(a * len(ids) + b)
                sums.append(np.bitwise_count(np.where(block == 0, bits & ~context, bits)).astype(np.int64))
            if not keys:
                continue
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, np.concatenate(sums), minlength=len(key)).astype(np.int64)
            shard = np.full(len(key), batch.column("shard")[row].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids[key // len(ids)]), pa.array(ids[key % len(ids)]), pa.array(total)], ["shard", "a", "b", "c"])


def extended(known: np.ndarray):
    """The bitmaps of a shard's frequent pairs, one word longer than those that it holds: those of ``known`` (rows a, b, id)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in range(batch.num_rows):
                ids, (owner, block, mask) = read_state(batch, row)
                a, b, new = known
                by_id = np.argsort(ids)
                at = [np.minimum(np.searchsorted(ids, x, sorter=by_id), len(ids) - 1) for x in (a, b)]
                have = (ids[by_id[at[0]]] == a) & (ids[by_id[at[1]]] == b)
                a, b, new = by_id[at[0]][have], by_id[at[1]][have], new[have]
                key = a * len(ids) + b
                order = np.argsort(key)
                key, new = key[order], new[order]
                firsts, lasts = np.isin(owner, a), np.isin(owner, b)
                out = [[np.zeros(0, kind)] for kind in (np.int64, np.uint32, np.uint16)]
                for x, y, at, bits in joined(shifted(owner[firsts], block[firsts], mask[firsts]), (owner[lasts], block[lasts], mask[lasts])):
                    k = x * len(ids) + y
                    place = np.minimum(np.searchsorted(key, k), len(key) - 1)
                    hit = np.flatnonzero(key[place] == k)
                    for parts, more in zip(out, (place[hit], at[hit], bits[hit]), strict=True):
                        parts.append(more)
                place, at, bits = (np.concatenate(x) for x in out)
                if not len(place):
                    continue
                order = np.lexsort((at, place))
                place, at, bits = place[order], at[order], bits[order]
                first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1])]))
                sizes = np.bincount(place[first], minlength=len(new)).astype(np.int32)
                yield state_batch(batch.column("shard")[row].as_py(), batch.column("skip")[row].as_py(), new[sizes > 0], sizes[sizes > 0], at[first], np.bitwise_or.reduceat(bits, first))

    return run


def extended_found(shard: pa.Table, found: pa.Table) -> pa.Table:
    """The same of one shard, whose frequent pairs are rows ``a, b, id``."""
    if not found.num_rows:
        return one_state(iter(()))
    return one_state(extended(np.stack([found.column(c).to_numpy() for c in ("a", "b", "id")]))(iter(shard.to_batches())))


def of_shards(shards: DataFrame, found: DataFrame, run) -> DataFrame:
    """``run`` of each shard and the rows found for it. Both are sorted by shard, so a task holds one; lists made by an
    aggregate would be held for 128 shards at a time."""
    return shards.groupBy("shard").cogroup(found.withColumnRenamed("shard", "_of").groupBy("_of")).applyInArrow(run, STATE)


def scored(phrases: DataFrame, totals: DataFrame, words: int) -> DataFrame:
    """The lowest-scoring cut of each phrase: ``lang, phrase, a, l, r, n, score``. Products are decimals of 38 digits."""
    wide = "decimal(19,0)"

    def cut(k: Column) -> Column:
        left, right = F.get("pre", k - 1), F.get("suf", F.lit(words - 1) - k)
        top = F.lit(1000).cast("decimal(4,0)") * (F.col("f").cast(wide) * F.col("n").cast(wide))
        return F.struct(F.call_function("div", top, left.cast(wide) * right.cast(wide)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    own = phrases.join(totals, "lang").withColumn("cut", F.array_min(F.array(*(cut(F.lit(k)) for k in range(1, words)))))
    return own.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_words: int = SHARD_WORDS, most_sent: int = MOST_BROADCAST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. A null text is empty, a null
    language ``und``. A phrase counts wherever its words follow each other within a piece, overlaps included; repeated rows
    count each time. Phrases of fewer than ``least`` places, and those within a longer candidate of as many places, are left
    out. Ties in the score go to the higher count, then by the bytes of the phrase. No texts give no rows; other columns are
    ignored. Up to ``most_sent`` frequent phrases of a length travel to all tasks; with more of them the shards are joined with theirs.
    """
    if not 2 <= longest <= BITS - 1:
        raise ValueError(f"longest must be from 2 to {BITS - 1}")
    store = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text")).where("text IS NOT NULL")
    maps = store.put(texts.mapInArrow(shards(shard_words, HELD_WORDS, longest), "shard bigint, lang string, skip int, words array<string>, counts array<bigint>, sizes binary, block binary, mask binary"), wide=True)
    words = maps.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("shard", "lang", "at", F.col("w.words").alias("phrase"), F.col("w.counts").alias("c"))
    totals = store.put(maps.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("c")).groupBy("lang").agg(F.sum("c").alias("n")))
    none = F.array().cast("array<bigint>")
    level = words.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    level = store.put(level.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase", F.col("phrase").alias("last"), "f", none.alias("pre"), none.alias("suf")))
    if level.count() <= most_sent:
        known: dict[str, dict[str, int]] = {}
        for r in level.select("lang", "phrase", "id").collect():
            known.setdefault(r["lang"], {})[r["phrase"]] = r["id"]
        state = maps.select("shard", "lang", "skip", "words", "sizes", "block", "mask").mapInArrow(own_words(known), STATE)
    else:
        here = words.join(level.select("lang", "phrase", "id").hint("merge"), ["lang", "phrase"]).select("shard", "at", "id")
        state = of_shards(maps.select("shard", "skip", "sizes", "block", "mask"), here, own_words_found)
    state = store.put(state, wide=True)
    store.drop(maps)
    out = None
    for size in range(2, longest + 1):
        pairs = state.mapInArrow(popcounts, "shard bigint, a bigint, b bigint, c bigint")
        often = pairs.groupBy("a", "b").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        often = store.put(often.withColumn("id", F.monotonically_increasing_id()))
        first = level.select(F.col("id").alias("a"), "lang", "phrase", F.concat("pre", F.array("f")).alias("pre"))
        second = level.select(F.col("id").alias("b"), "last", F.concat("suf", F.array("f")).alias("suf"))
        longer = store.put(often.join(first, "a").join(second, "b").select("id", "a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "pre", "suf"))
        if size > 2:
            out = within(level, longer, totals, size - 1, out)
        level = longer
        if size == longest or level.isEmpty():
            out = scored(level, totals, size) if out is None else out.unionByName(scored(level, totals, size))
            break
        if often.count() <= most_sent:
            known = np.array([[r["a"], r["b"], r["id"]] for r in often.select("a", "b", "id").collect()], np.int64).T
            nxt = store.put(state.mapInArrow(extended(known), STATE), wide=True)
        else:
            here = pairs.join(often.drop("f").hint("merge"), ["a", "b"]).select("shard", "a", "b", "id")
            nxt = store.put(of_shards(state, here, extended_found), wide=True)
        store.drop(state)
        state = nxt
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of a language are among the first of each of its parts, so that no task ranks a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = out.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def within(level: DataFrame, longer: DataFrame, totals: DataFrame, words: int, out: DataFrame | None) -> DataFrame:
    """The level's scored phrases added to ``out``, without those that a phrase one word longer covers everywhere. (A still
    longer one with as many places has one between them that has as many.)"""
    around = longer.select(F.col("a").alias("id"), F.col("f").alias("g")).unionByName(longer.select(F.col("b").alias("id"), F.col("f").alias("g"))).groupBy("id").agg(F.max("g").alias("g"))
    own = scored(level.join(around, "id", "left").where("g IS NULL OR g < f"), totals, words)
    return own if out is None else out.unionByName(own)


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, doc_id,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS MATERIALIZED (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
s AS MATERIALIZED (SELECT lang, pid, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p),
t AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM s WINDOW o AS (PARTITION BY pid ORDER BY i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (
  SELECT lang, unnest([1, 2, 3, 4, 5]) AS k, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5]) AS phrase FROM t)
  WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
n AS MATERIALIZED (SELECT lang, count(*) AS n FROM t GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1),
parts AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(v[1:j], ' ') AS lp, array_to_string(v[j + 1:k], ' ') AS rp
         FROM (SELECT *, string_split(phrase, ' ') AS v, unnest([1, 2, 3, 4]) AS j FROM c) WHERE j < k),
cuts AS MATERIALIZED (SELECT p.lang, p.k, p.phrase, p.a, j, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * p.a * n.n // (l.a::HUGEINT * r.a))::BIGINT AS score
         FROM parts p JOIN n ON n.lang = p.lang JOIN f l ON l.lang = p.lang AND l.phrase = lp JOIN f r ON r.lang = p.lang AND r.phrase = rp),
best AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS MATERIALIZED (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.a >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM kept
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER o <= 2000
"""
