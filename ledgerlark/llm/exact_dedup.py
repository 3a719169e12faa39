"""Exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by successive runs of bytes until a group holds one document or has ended. The first digit is 512
bytes wide and each next one eight times wider, so a text of n bytes needs about log8(n / 512) rounds. Equality is decided
by the bytes alone; the SHA-256 in the result is a report, never a key.

Texts are stored once with a row number. A round moves row numbers and digits only: it counts the documents of every
(group, digit) with map-side combining, so a group of copies of any size costs one row a task, and hands each document the
number of its new group by a join whose hot side adaptive execution splits. Documents alone in their group leave at once;
the next digits are fetched for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import Scratch, small_side, table

FIRST_DIGIT = 512
WIDENING = 8


def equal_rows(base: DataFrame, store: Scratch) -> DataFrame:
    """``rid, id, sha, keep, n, kept`` of stored rows ``(rid, id, sha, t)``: each row's group of equal bytes ``t``.

    ``keep`` is the group's largest id, ``n`` its size; of the rows with that id the one with the smallest ``rid`` is kept.
    """
    width, at, done, todo = FIRST_DIGIT, 0, [], None
    while True:
        own = base.withColumn("grp", F.lit(0).cast("long")) if todo is None else base.join(small_side(todo), "rid")
        state = own.select("rid", "id", "sha", "grp", F.substring("t", at + 1, width).alias("digit"))
        nodes = state.groupBy(F.col("grp").alias("g"), F.col("digit").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).where("n > 1")
        # one plan at every size: small inputs would broadcast it
        nodes = store.put(nodes.withColumn("child", F.monotonically_increasing_id() + 1)).hint("merge")
        split = state.join(nodes, (F.col("grp") == F.col("g")) & (F.col("digit") == F.col("d")), "left")
        split = store.put(split.select("rid", "id", "sha", "n", "keep", "child", (F.col("n").isNotNull() & (F.length("digit") == width)).alias("more")))
        done.append(split.where("not more").select("rid", "id", "sha", "n", "keep", "child", F.lit(len(done)).alias("round")))
        todo = split.where("more").select("rid", F.col("child").alias("grp"))
        if todo.isEmpty():
            break
        todo = store.put(todo)
        at, width = at + width, width * WIDENING
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    # Rows that repeat the winning id and its text: one of them stays.
    first = rows.where(F.col("n").isNotNull() & F.col("id").eqNullSafe(F.col("keep"))).groupBy("round", "child").agg(F.min("rid").alias("stays"))
    marked = rows.join(first.select(F.col("round").alias("r2"), "stays"), (F.col("round") == F.col("r2")) & (F.col("rid") == F.col("stays")), "left")
    alone = F.col("n").isNull()
    return marked.select("rid", "id", "sha", F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), (alone | F.col("stays").isNotNull()).alias("kept"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    ``normal`` is the normalised text (default: the text as it is). A null text counts as empty. Of equal texts the row
    with the largest id stays; a null id is smaller than any other; of rows that repeat the winning id one stays (any,
    they are alike). Other columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    store = Scratch(docs.sparkSession)
    text = F.coalesce(normal if normal is not None else F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.monotonically_increasing_id().alias("rid"))
    found = equal_rows(store.put(base.select("rid", "id", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("t"))), store)
    return found.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the row with the largest id, of rows alike in id and text one.

    Null texts count as empty, a null id is smaller than any other; an empty table gives no rows.
    """
    store = Scratch(docs.sparkSession)
    rows = store.put(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")))
    base = rows.select("rid", F.col(f"own.`{id_col}`").alias("id"), F.lit("").alias("sha"), F.coalesce(F.col(f"own.`{text_col}`"), F.lit("")).cast("binary").alias("t"))
    gone = store.put(equal_rows(base, store).where("not kept").select("rid"))
    return rows.join(small_side(gone), "rid", "left_anti").select(*(F.col(f"own.`{c}`") for c in docs.columns))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; null texts count as empty, no rows give none."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
