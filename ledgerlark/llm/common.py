"""Shared helpers: table access, scratch tables in the shared folder, byte-level word hashing."""

from __future__ import annotations

import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.scratch import new_folder

#: Text is handed to numpy in buffers of about this many bytes, so memory doesn't grow with a document's length.
SEGMENT = 1 << 20


def by_value(module: str) -> None:
    """Ship a module's functions to the executors by value: they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, read by Spark (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of megabytes each are written in small row groups: Parquet would hold a hundred of them before it looks at their size,
#: and its readers hold what one row group has of 4,096 rows.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


class Scratch:
    """Tables written to cut lineage: a lost executor never makes an earlier round run again.

    ``put`` writes and rereads a table (``wide``: one of rows of megabytes each); ``drop`` removes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, new_folder(spark), 0

    def put(self, df: DataFrame, wide: bool = False) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.options(**(WIDE_ROWS if wide else {})).option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A stored table is broadcast up to this many rows of a few numbers each; a larger one is merge-joined.
MOST_BROADCAST = 500_000


def small_side(stored: DataFrame) -> DataFrame:
    """A stored table of ids as one side of a join with documents: broadcast while its counted size allows it."""
    return F.broadcast(stored) if stored.count() <= MOST_BROADCAST else stored.hint("merge")


#: White space beyond ASCII; its bytes would otherwise count as letters.
WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")

#: 1 for bytes that belong to words: digits, a-z and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = 1

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least ``n`` of each."""
    size = max(SEGMENT * 2, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a byte array."""
    m = np.zeros(len(buf) + 2, np.int8)
    m[1:-1] = WORD_BYTE[buf]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def segments(data: bytes) -> list[tuple[int, int]]:
    """Cuts of ``data`` into pieces of about SEGMENT bytes, never inside a word."""
    cuts, at = [], 0
    while len(data) - at > 2 * SEGMENT:
        end = at + SEGMENT
        while end < len(data) and WORD_BYTE[data[end]]:
            end += 1
        cuts.append((at, end))
        at = end
    return [*cuts, (at, len(data))]


def span_hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of a byte array; equal bytes, equal hash."""
    if not len(lo):
        return np.zeros(0, np.uint64)
    p, q = powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=h[1:])
    return mix((h[hi] - h[lo]) * q[lo] ^ (hi - lo).astype(np.uint64))


def lower_ascii(data: bytes) -> bytes:
    """A-Z become a-z; all other bytes stay."""
    return data.lower()


def batches_of(texts: list[bytes], most: int = SEGMENT) -> list[tuple[int, int]]:
    """Runs of consecutive texts of about ``most`` bytes together; a longer text stands alone."""
    out, first, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((first, k))
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        out.append((first, len(texts)))
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in turn, and how many words each text has. Texts are lower-cased bytes."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for a, b in batches_of(texts):
        if b - a == 1:
            for lo, hi in segments(texts[a]):
                buf = np.frombuffer(texts[a], np.uint8)[lo:hi]
                s, e = word_spans(buf)
                hashes.append(span_hashes(buf, s, e))
                counts[a] += len(s)
            continue
        buf = np.frombuffer(b" ".join(texts[a:b]), np.uint8)
        s, e = word_spans(buf)
        hashes.append(span_hashes(buf, s, e))
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        counts[a:b] = np.diff(np.searchsorted(s, ends), prepend=0)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts
