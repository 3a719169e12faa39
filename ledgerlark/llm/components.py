"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import Scratch, small_side


def connected(edges: DataFrame, store: Scratch, most_rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges (a, b)`` of type bigint; the root is the component's smallest vertex.

    Every step only aggregates (with map-side combining) and joins on vertices, writes its edges to the shared folder and
    stops when they no longer change, so neither a vertex with many neighbours nor a lost executor is a problem. Edges with
    a null end and loops are ignored; repeated edges are harmless; no edges give no rows.
    """
    cur = store.put(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    before = None
    for _ in range(most_rounds):
        now = tuple(cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
        # large star: larger neighbours of u go to the smallest vertex around u
        both = cur.union(cur.selectExpr("b AS a", "a AS b"))
        # (stored: a few vertices are broadcast by their count, so that edges don't move; with many, both sides of the join are
        # plain exchanges and adaptive execution splits a vertex with many edges)
        low = store.put(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(small_side(low), F.col("a") == F.col("u")).where("b > a").selectExpr("b AS a", "m AS b")
        large = store.put(large.where("a <> b").distinct())
        store.drop(low)
        # small star: u and its smaller neighbours go to the smallest of them
        low = store.put(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(small_side(low), F.col("a") == F.col("u"))
        small = small.where("b <> m").selectExpr("b AS a", "m AS b").union(low.selectExpr("u AS a", "m AS b"))
        nxt = store.put(small.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
        store.drop(large)
        store.drop(low)
        store.drop(cur)
        cur = nxt
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return cur.selectExpr("a AS v", "b AS root").union(cur.selectExpr("b AS v", "b AS root").distinct())
