"""Embedding whitening from an exact scatter matrix in residue numbers.

Entries become whole numbers, so sums and products can be exact: every partition multiplies its vectors, centred as
``n * x - S``, modulo several primes below 2^20 in float64 matrix products that never round. Residues are added up by Spark,
the Chinese remainder theorem gives the scatter matrix as whole numbers, and only then comes a floating-point step, the
eigendecomposition in double precision. The driver sees sums by dimension and by pair of dimensions, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import Scratch, by_value, table

by_value(__name__)

SCALE = 256
COMPONENTS = 4
#: Primes lie below this; ROWS products of two residues stay below 2^53, so a float64 matrix product is exact.
BELOW = 1 << 20
ROWS = 1 << 13
#: Entries of larger magnitude are held at this one.
FARTHEST = 1 << 62


def primes_for(bound: int) -> list[int]:
    """The largest primes below BELOW whose product exceeds twice ``bound``: they tell whole numbers up to it apart, signs included."""
    out, p = [], BELOW
    while not out or prod(out) <= 2 * bound:
        p -= 1
        while any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        out.append(p)
    return out


def remainder_values(residues: list[list[int]], primes: list[int]) -> list[int]:
    """Whole numbers in (-P/2, P/2), P the product of the primes, from their residues, one list a prime."""
    whole = prod(primes)
    weights = [whole // p * pow(whole // p, -1, p) for p in primes]
    out = [sum(w * (int(r) % p) for w, r, p in zip(weights, row, primes, strict=True)) % whole for row in zip(*residues, strict=True)]
    return [v - whole if v > whole // 2 else v for v in out]


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def residue_sums(primes: list[int], d: int):
    """A partition's ``n, most, sums``: how many vectors, the largest magnitude, and sums by prime and dimension."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, sums = 0, 0, np.zeros((len(primes), d), np.int64)
        for batch in it:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n, most = n + len(x), max(most, int(np.abs(x).max()))
                for k, p in enumerate(primes):
                    sums[k] = (sums[k] + (x % p).sum(axis=0)) % p
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([most]), pa.array([sums.reshape(-1).tolist()], pa.list_(pa.int64()))], ["n", "most", "sums"])

    return run


def residue_scatter(primes: list[int], n: int, total: list[int]):
    """A partition's ``at, g``: for every prime and dimension a row of the centred scatter matrix modulo the prime."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, seen = len(total), False
        sums = [np.zeros((d, d)) for _ in primes]
        shift = [np.array([s % p for s in total], np.int64) for p in primes]
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                x, seen = matrix(batch.column(0).slice(at, ROWS)), True
                for k, p in enumerate(primes):
                    y = ((x % p * (n % p) - shift[k]) % p).astype(float)
                    sums[k] = (sums[k] + y.T @ y) % p
        if seen:
            rows = np.concatenate(sums).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), d).cast(pa.list_(pa.int64()))], ["at", "g"])

    return run


class Whitening:
    """What is learned from the distinct vectors: ``n``, sums ``total``, eigenvalues ``e``, unit eigenvectors ``u`` (dimensions,
    components), ``trace`` and the largest magnitude of ``n * x - S``. Components without spread have no scale: their
    whitened values are null."""

    def __init__(self, n: int, total: list[int], scatter: np.ndarray, reach: int, components: int):
        self.n, self.total, self.reach = n, total, reach
        cov = np.array([[v / n**3 for v in row] for row in scatter.tolist()], float)  # whole numbers, divided once
        e, u = np.linalg.eigh(cov)
        order = np.argsort(-e, kind="stable")[:components]
        u = u[:, order]
        self.u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
        self.e, self.trace = np.maximum(e[order], 0), float(np.trace(cov))
        self.flat = self.e <= self.trace * len(total) * np.finfo(float).eps

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.total])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (x - mean) @ self.u / np.sqrt(self.e)
        out[:, self.flat] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``n * x - S``, exact; null where they pass 64 bits."""
        if len(self.total) * self.reach**2 < 1 << 63:
            y = x * self.n - np.array(self.total, np.int64)
            return (y * y).sum(axis=1).tolist()
        own = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in own]


def whitened_sums(model: Whitening):
    """A partition's sums of whitened values and of their products, as one row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.u.shape[1]
        one, two, seen = np.zeros(c), np.zeros((c, c)), False
        for batch in it:
            if batch.num_rows:
                w, seen = np.nan_to_num(model.project(matrix(batch.column(0)))), True
                one, two = one + w.sum(axis=0), two + w.T @ w
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([one, two.reshape(-1)]).tolist()], pa.list_(pa.float64()))], ["s"])

    return run


def whitened_rows(model: Whitening, off: float | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.u.shape[1]
        explained = [float(e / model.trace) if model.trace else None for e in model.e]
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, n = matrix(part.column("x")), part.num_rows
                take = np.repeat(np.arange(n), c)
                w = model.project(x).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(take)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), n)), pa.array(np.full(n * c, model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(take)), pa.array(w, mask=np.isnan(w)), pa.array(explained * n, pa.float64()), pa.array([off] * (n * c), pa.float64())],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whole_vector(vector: Column) -> Column:
    """``floor(256 * entry)`` of every entry as bigint; null where the vector is null or an entry is null or not finite."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    own = F.transform(vector, lambda c: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.floor(c.cast("double") * SCALE).cast("bigint"))))
    return F.when(sound, own)


def summed(stored: DataFrame, name: str, *by: str) -> list:
    """Sums of a column of lists by place (and ``by``): as many rows as there are places."""
    return stored.select(*by, F.posexplode(name).alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v")).collect()


def learn(fit: DataFrame, store: Scratch, components: int) -> tuple[Whitening, float | None]:
    """The model from stored distinct vectors ``(x)`` of one length, and the largest entry of the whitened covariance minus the identity."""
    d = fit.select(F.size("x")).first()[0]
    primes = primes_for(FARTHEST << 63)  # sums of up to 2^63 entries
    sums = store.put(fit.mapInArrow(residue_sums(primes, d), "n bigint, most bigint, sums array<bigint>"))
    n, most = sums.agg(F.sum("n"), F.max("most")).first()
    residues = {r["pos"]: r["v"] for r in summed(sums, "sums")}
    total = remainder_values([[residues[k * d + j] for j in range(d)] for k in range(len(primes))], primes)
    reach = n * most + max(abs(s) for s in total)
    primes = primes_for(n * reach**2)
    parts = store.put(fit.mapInArrow(residue_scatter(primes, n, total), "at bigint, g array<bigint>"))
    residues = [[0] * (d * d) for _ in primes]
    for r in summed(parts, "g", "at"):
        residues[r["at"] // d][r["at"] % d * d + r["pos"]] = r["v"]
    scatter = np.array(remainder_values(residues, primes), object).reshape(d, d)
    model = Whitening(n, total, scatter, reach, components)
    if model.flat.all():
        return model, None
    own = summed(store.put(fit.mapInArrow(whitened_sums(model), "s array<double>")), "s")
    c = model.u.shape[1]
    s = np.array([r["v"] for r in sorted(own, key=lambda r: r["pos"])])
    cov = s[c:].reshape(c, c) / n - np.outer(s[:c], s[:c]) / n**2
    keep = ~model.flat
    return model, float(np.abs(cov - np.eye(c))[np.ix_(keep, keep)].max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error``: a row for each sound vector and component.

    Vectors that are null, empty or hold a null or non-finite entry give no rows. All others must have one length; where they
    have several, those of the length that most distinct vectors have (the longer one if equally many) stay. The model comes
    from each distinct vector once, so copies, however many, don't shift it; every row is projected, copies and repeated or
    null ids too. A component without spread has null as its whitened value, and is left out of ``identity_error``
    (null where all are); ``explained`` is null where nothing varies at all. Entries beyond 2^62 / 256 in magnitude are held
    there; a deviation that passes 64 bits is null. Other columns are ignored; no vectors give no rows.
    """
    store = Scratch(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), whole_vector(F.col(f"`{vector_col}`")).alias("x")).where("size(x) > 0")
    fit = store.put(rows.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    one = F.size("x") == lengths["d"]
    model, off = learn(fit.where(one), store, components)
    return rows.where(one).mapInArrow(whitened_rows(model, off), schema).withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The first four whitened components of every sound row of ``embeddings``, learned from its distinct vectors."""
    return whiten(table(spark, sf_dir, "embeddings"))
