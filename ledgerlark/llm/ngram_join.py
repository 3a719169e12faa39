"""N-gram Jaccard self-join by chosen paths.

Documents become sets of hashes of five consecutive words. A run splits them recursively: at each level a document follows
the one token of its set that comes first in that run's and level's random order, so two documents stay together with the
probability of their Jaccard similarity. A node with few documents is compared by brute force, a large one is split
again; what is still large at the last level is compared in pairs of blocks. Runs repeat until a pair at the threshold has
met, at whatever level, with probability ``recall``.

Equal sets are collapsed first. Brute force in a node compares min-hash sketches and keeps a spanning forest of the pairs
that may be similar, so a node yields fewer rows than it has documents. The forests' components are then verified exactly
on whole sets: every pair inside a component whose sizes allow the threshold is compared (in blocks of sets of about one
size, each pair of blocks being a task of its own), so a pair counts once and also pairs that no run brought together are
found. Only counts and a spanning forest leave a block; neither pairs nor copies are ever expanded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import WIDE_SPACE, Scratch, by_value, lower_ascii, mix, small_side, table, words_of
from ledgerlark.llm.components import connected

by_value(__name__)

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999999
LEVELS = 3
#: Nodes up to this many documents are compared by brute force; larger ones are split again, and at the last level
#: compared in blocks: of this many documents, or more where a node would have over NODE_BLOCKS of them, up to NODE_MOST.
NODE, NODE_BLOCKS, NODE_MOST = 400, 16, 8192
#: Sets in a block of verification, or more where a class would have over BLOCKS of them, up to BLOCK_MOST; and shingles in it.
BLOCK, BLOCKS, BLOCK_MOST, BLOCK_SHINGLES = 128, 32, 1024, 1 << 20
#: Pairs whose sketches agree in fewer places than threshold - SLACK are not candidates.
SLACK = 0.3


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met in one node of the first level with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))


def runs_planned(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold is a candidate with probability ``recall``.

    Counted at the last level, where a pair that stays in large nodes has to agree in all tokens of a run, and with the
    chance that the pair's sketch, of all runs' tokens, agrees in too few places.
    """
    runs = runs_for(threshold**LEVELS, recall)
    while (1 - threshold**LEVELS) ** runs + sketch_miss(threshold, runs * LEVELS) > 1 - recall:
        runs += 1
    return runs


def sketch_miss(threshold: float, places: int) -> float:
    """The chance that a pair at the threshold agrees in less than a part ``threshold - SLACK`` of its sketch's places."""
    return sum(math.comb(places, k) * threshold**k * (1 - threshold) ** (places - k) for k in range(places + 1) if k / places < threshold - SLACK)


def normal_text(text: str) -> bytes:
    """Lower case, all white space alike; words are what is left between other ASCII characters."""
    if not text.isascii():
        text = WIDE_SPACE.sub(" ", text.lower())
    return lower_ascii(text.encode())


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of every ``n`` consecutive words of each text. A shorter text is one shingle; no word, none."""
    words, counts = words_of(texts)
    out, at = [], 0
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(n)]
    if len(words) >= n:
        rolled = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            rolled += words[k : len(words) - n + 1 + k] * factor[k]
        rolled = mix(rolled)
    for c in counts.tolist():
        if c >= n:
            s = np.sort(rolled[at : at + c - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(mix((words[at : at + c] * np.array(factor[:c])).sum(keepdims=True) ^ np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def key_of(own: np.ndarray) -> bytes | None:
    """The key of a set; equal sets, equal keys. None for the empty one."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def order_seeds(count: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature_batches(n: int, orders: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = order_seeds(orders)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets([normal_text(t or "") for t in part.column("text").to_pylist()], n)
                sizes = np.array([len(s) for s in sets])
                keys = [key_of(s) for s in sets]
                some = np.flatnonzero(sizes)
                firsts = np.zeros((len(sets), orders), np.uint64)
                # whole sets in groups, so that the scrambled copy stays small
                group: list[int] = []
                for k in [*some.tolist(), -1]:
                    if group and (k < 0 or sizes[group].sum() + sizes[k] > 1 << 17):
                        flat = np.concatenate([sets[g] for g in group])
                        cuts = np.cumsum([0, *sizes[group][:-1]])
                        for o in range(orders):
                            h = flat * seeds[o]
                            firsts[group, o] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), cuts)
                        group = []
                    group.append(k)
                tokens = pa.FixedSizeListArray.from_arrays(pa.array(firsts.reshape(-1).view(np.int64)), orders).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), tokens], ["id", "text_hash", "key", "n", "tokens"])

    return run


def set_batches(n: int):
    """The sets of texts whose key is the wanted one, each once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fresh = []
                for k, r in enumerate(part.column("rid").to_pylist()):
                    if r not in seen:
                        seen.add(r)
                        fresh.append(k)
                part = part.take(pa.array(fresh, pa.int64()))
                sets = shingle_sets([normal_text(t or "") for t in part.column("text").to_pylist()], n)
                own = [k for k, (s, key) in enumerate(zip(sets, part.column("key").to_pylist(), strict=True)) if key_of(s) == key]
                yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(own, pa.int64())), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["rid", "set"])

    return run


class Groups:
    """A partition of 0..n-1 that pairs are merged in; ``of`` holds each one's smallest mate."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> None:
        met = np.unique(self.of[others])
        met = met[met != self.of[x]]
        if len(met):
            met = np.append(met, self.of[x])
            self.of[np.isin(self.of, met)] = met.min()

    def one(self) -> bool:
        return not self.of.any()


def groups_in(it: Iterator[pa.RecordBatch], key: str, once: str | None = None) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches that are sorted by it (and by ``once``, of which repeats are left out)."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1).tolist(), len(col)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[-1].as_py() != col[a]:
                yield pa.Table.from_batches(held)
                held = []
            if once is not None:
                own = part.column(once).to_numpy(zero_copy_only=False)
                new = np.append(not held or held[-1].column(once)[-1].as_py() != own[0], own[1:] != own[:-1])
                part = part if new.all() else part.filter(pa.array(new))
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def node_batches(least: float):
    """Brute force in a node or a pair of its blocks: a spanning forest of the pairs whose sketches agree in a part ``least`` or more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out, n_out = [], [], 0
        for node in groups_in(it, "task"):
            rid, high = node.column("rid").to_numpy(), node.column("high").to_numpy(zero_copy_only=False)
            sk = np.stack([np.frombuffer(x, np.uint16) for x in node.column("sketch").to_pylist()])
            need = least * sk.shape[1] - 1e-9
            groups = Groups(len(rid))
            cross = np.flatnonzero(high)  # rows of the second block; without any, all pairs of the first are compared
            two = node.column("two")[0].as_py()
            for x in range(len(rid)):
                if two and high[x]:
                    continue
                to = cross if two else np.arange(x + 1, len(rid))
                if not len(to) or groups.one():
                    break
                groups.join(x, to[(sk[to] == sk[x]).sum(axis=1) >= need])
            out = np.flatnonzero(groups.of != np.arange(len(rid)))
            a_out.append(rid[out])
            b_out.append(rid[groups.of[out]])
            n_out += len(out)
            if n_out > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])
                a_out, b_out, n_out = [], [], 0
        if n_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])

    return run


def similar(rows: list[np.ndarray], cols: list[np.ndarray], threshold: float) -> Iterator[np.ndarray]:
    """For each of ``rows``, which of ``cols`` have a Jaccard similarity of at least ``threshold``, exactly."""
    sizes = np.array([len(c) for c in cols])
    flat = np.concatenate(cols)
    owner = np.repeat(np.arange(len(cols)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for r in rows:
        lo, hi = np.searchsorted(flat, r, "left"), np.searchsorted(flat, r, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(cols))
        union = len(r) + sizes - both
        yield np.flatnonzero(both >= threshold * union - 1e-9)


def verify_batches(threshold: float):
    """Exact similarities within a pair of blocks: how many links each set has here, and a spanning forest of the links."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in groups_in(it, "task", once="rid"):
            rid, high = task.column("rid").to_numpy(), task.column("high").to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x, np.uint64) for x in task.column("set").to_pylist()]
            copies = task.column("copies").to_numpy()
            two = task.column("two")[0].as_py()
            rows = np.flatnonzero(~high) if two else np.arange(len(rid))
            cols = np.flatnonzero(high) if two else rows
            texts, docs = np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)
            groups = Groups(len(rid))
            if len(rows) and len(cols):
                for x, found in zip(rows.tolist(), similar([sets[k] for k in rows], [sets[k] for k in cols], threshold), strict=True):
                    y = cols[found]
                    y = y[y != x]
                    texts[x] += len(y)
                    docs[x] += copies[y].sum()
                    if two:
                        texts[y] += 1
                        docs[y] += copies[x]
                    groups.join(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rid[groups.of]), pa.array(texts), pa.array(docs)], ["rid", "root", "texts", "docs"])

    return run


def in_blocks(rows: DataFrame, blocks: str, key: str) -> DataFrame:
    """``rows`` of ``rid`` once for every pair of blocks of their ``key`` that they belong to: ``rid, task, high, two``.

    ``two`` tells that a task compares two blocks, ``high`` that the row is in its second one.
    """
    own = rows.withColumn("blocks", F.expr(blocks).cast("int")).withColumn("block", F.expr("pmod(xxhash64(rid), blocks)").cast("int"))
    pairs = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return pairs.select("rid", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") > F.col("other")).alias("high"), (F.col("block") != F.col("other")).alias("two"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, class_id, copy_id, n_links, n_texts``.

    Words are runs of ASCII digits, letters in lower case and characters beyond ASCII. Two documents link when the Jaccard
    similarity of their sets of ``n`` words in a row is at least ``threshold``. ``class_id`` is the smallest id that links
    lead to, ``copy_id`` the smallest id with the same set, ``n_links`` the number of other documents it links to and
    ``n_texts`` the number of other sets. A text of fewer than ``n`` words is one shingle; one without words (null, empty)
    links to none and is its own class. A row with a null id links to none and has null class and copy ids. Rows that
    repeat id and text are copies of each other; rows that share an id but not the text are documents of their own, and the
    id stands for each. An empty table gives no rows.
    """
    out = classes_of_rows(docs, threshold, n, recall, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links", "n_texts")


def classes_of_rows(docs: DataFrame, threshold: float, n: int, recall: float, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, class_id, copy_id, n_links, n_texts`` of every row."""
    spark = docs.sparkSession
    store = Scratch(spark)
    runs = runs_planned(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").withColumn("text_hash", F.xxhash64("text"))
    made = rows.mapInArrow(signature_batches(n, runs * LEVELS), f"id {kind}, text_hash bigint, key binary, n int, tokens array<bigint>")
    sig = store.put(made.withColumn("rid", F.monotonically_increasing_id()).withColumn("key", F.when(F.col("id").isNotNull(), F.col("key"))))
    classes = store.put(sig.where("key IS NOT NULL").groupBy("key").agg(F.min("rid").alias("rep"), F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("copies")))
    reps = sig.join(classes.select("rep", "copies"), F.col("rid") == F.col("rep")).select("rid", "id", "text_hash", "key", "n", "copies", "tokens")
    reps = store.put(reps)

    # paths: one node a run for each representative, split again where a node is large
    own = F.expr(f"transform(sequence(0, {runs - 1}), r -> struct(xxhash64(r, tokens[r * {LEVELS}]) AS path, slice(tokens, r * {LEVELS} + 2, {LEVELS - 1}) AS more))")
    nodes = reps.select("rid", F.explode(own).alias("x")).select("rid", "x.path", "x.more")
    leaves = []
    for level in range(LEVELS):
        # stored, so that both sides of the merge join are plain exchanges: adaptive execution splits a large node
        sizes = store.put(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")).hint("merge")
        met = store.put(nodes.join(sizes.withColumnRenamed("path", "p"), F.col("path") == F.col("p")).select("rid", "path", "more", "size"))
        last = level == LEVELS - 1
        leaves.append((met if last else met.where(F.col("size") <= NODE)).select("rid", "path", "size"))
        large = met.where(F.col("size") > NODE)
        if last or large.isEmpty():
            break
        nodes = large.select("rid", F.xxhash64("path", F.col("more")[0]).alias("path"), F.expr("slice(more, 2, size(more))").alias("more"))
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    bytes_of = "unhex(array_join(transform(tokens, t -> lpad(hex(shiftrightunsigned(t, 8) & 65535), 4, '0')), ''))"
    leaf = in_blocks(leaf, f"greatest(least({NODE_BLOCKS}, ceil(size / {NODE})), ceil(size / {NODE_MOST}))", "path")
    sketched = leaf.join(reps.selectExpr("rid", f"{bytes_of} AS sketch"), "rid")
    dealt = sketched.repartition("task").sortWithinPartitions("task", "high")
    comp = store.put(connected(dealt.mapInArrow(node_batches(threshold - SLACK), "a bigint, b bigint"), store))

    # exact verification inside candidate components, in blocks of sets of about one size: sets link only within one class
    # of sizes or with the next one
    cands = comp.join(reps.select("rid", "id", "text_hash", "key", "n", "copies"), F.col("v") == F.col("rid"))
    cands = store.put(cands.select("rid", "id", "text_hash", "key", F.col("root").alias("comp"), "copies", F.floor(F.log(F.col("n")) / F.lit(-math.log(max(threshold, 0.01)))).cast("int").alias("class"), "n"))
    shares = cands.groupBy("comp", "class").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    shares = store.put(shares.selectExpr("comp", "class", f"greatest(least({BLOCKS}, ceil(size / {BLOCK})), ceil(size / {BLOCK_MOST}), ceil(shingles / {BLOCK_SHINGLES})) AS blocks"))
    near = shares.select("comp", F.explode(F.array(F.struct(F.col("class").alias("class"), F.col("blocks").alias("own")), F.struct((F.col("class") - 1).alias("class"), F.lit(0).cast("bigint").alias("own")), F.struct((F.col("class") + 1).alias("class"), F.lit(0).cast("bigint").alias("own")))).alias("x"), "blocks", F.col("class").alias("of"))
    # for each class: its own number of blocks, that of the class below and that of the class above
    near = near.groupBy("comp", F.col("x.class").alias("class")).agg(F.max("x.own").alias("own"), F.max(F.when(F.col("of") < F.col("x.class"), F.col("blocks"))).alias("below"), F.max(F.when(F.col("of") > F.col("x.class"), F.col("blocks"))).alias("above")).where("own > 0")
    placed = cands.join(near, ["comp", "class"]).withColumn("block", F.expr("pmod(xxhash64(rid), own)"))
    side = "transform(sequence(0, {n} - 1), o -> struct({c} AS class, o AS block))"
    others = f"concat({side.format(n='own', c='class')}, if(below IS NULL, array(), {side.format(n='below', c='class - 1')}), if(above IS NULL, array(), {side.format(n='above', c='class + 1')}))"
    placed = placed.select("rid", "id", "text_hash", "key", "copies", F.struct("comp", "class", "block").alias("at"), F.expr(others).alias("others"))
    texts = rows.join(small_side(store.put(placed.select("rid", "id", "text_hash", "key"))), ["id", "text_hash"])
    sets = texts.select("rid", "key", "text").mapInArrow(set_batches(n), "rid bigint, set binary")
    tasks = placed.select("rid", "copies", "at", F.explode("others").alias("o"))
    own, other = F.struct("at.class", "at.block"), F.struct("o.class", "o.block")
    tasks = tasks.select("rid", "copies", (own > other).alias("high"), (own != other).alias("two"), F.xxhash64("at.comp", F.least(own, other), F.greatest(own, other)).alias("task"))
    dealt = sets.join(small_side(store.put(tasks)), "rid")
    found = dealt.repartition("task").sortWithinPartitions("task", "rid").mapInArrow(verify_batches(threshold), "rid bigint, root bigint, texts bigint, docs bigint")
    found = store.put(found)
    link = found.groupBy("rid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    final = connected(found.selectExpr("rid AS a", "root AS b"), store)
    ids = final.join(reps.selectExpr("rid AS v", "id"), "v")
    # the smallest id among all copies of a class's members
    low = final.join(classes.selectExpr("rep AS v", "copy_id"), "v").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    of_rep = ids.join(low, "root").select(F.col("v").alias("rep"), "class_id")
    of_class = classes.join(of_rep, "rep", "left").join(link.withColumnRenamed("rid", "rep"), "rep", "left")
    of_class = of_class.selectExpr("key AS k", "copy_id", "coalesce(class_id, copy_id) AS class_id", "copies - 1 + coalesce(docs, 0) AS n_links", "coalesce(texts, 0) AS n_texts")
    out = sig.select("id", "text_hash", "key").join(of_class, F.col("key") == F.col("k"), "left")
    return out.select(
        "id", "text_hash", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.when(F.col("id").isNotNull(), F.coalesce("copy_id", "id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each class of linked documents those with the class's smallest id.

    Rows with a null id, without words or without links stay. Where rows share an id, each goes or stays by its own text.
    """
    found = classes_of_rows(docs, THRESHOLD, WORDS, RECALL, id_col, text_col)
    gone = Scratch(docs.sparkSession).put(found.where(F.col("id") != F.col("class_id")).select(F.col("id").alias("near__id"), F.col("text_hash").alias("near__hash")).distinct())
    return docs.join(small_side(gone), (docs[id_col] == gone["near__id"]) & (F.xxhash64(docs[text_col]) == gone["near__hash"]), "left_anti")


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, copy_id, n_links, n_texts of every document; null and empty texts link to none, no rows give none."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
