"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are counted in numpy over buffers of bytes; the trees are grown on a bounded sample of labelled documents, on
histograms of quantile bins, and flattened into arrays, so that all documents of a batch walk a tree together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import SEGMENT, Scratch, batches_of, by_value, span_hashes, table

by_value(__name__)

#: The bound of the training sample, in labelled documents.
MOST_LABELS = 20_000
TREES = 60
DEPTH = 4
BINS = 32
RATE = 0.25
LEAST_LEAF = 10

#: Classes of bytes that are counted: each byte belongs to one.
BYTE_CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "comma", "shout", "bar", "symbol", "wide", "other")
BYTE_CLASS = np.full(256, BYTE_CLASSES.index("other"), np.uint8)
for _name, _chars in (("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("blank", b" \t\r"), ("newline", b"\n"), ("stop", b"."), ("comma", b",;:"), ("shout", b"!?"), ("bar", b"|"), ("symbol", b"#$%&*@^~<>{}[]\\/_=+"), ("wide", bytes(range(128, 256)))):
    BYTE_CLASS[list(_chars)] = BYTE_CLASSES.index(_name)

FEATURES = (
    "log_bytes", "log_words", "log_lines", *(f"share_{c}" for c in BYTE_CLASSES), "word_bytes", "longest_word", "distinct_words", "top_word", "again_word", "marked_words", "capital_words", "line_words", "again_lines", "upper_of_letters",
)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def per_text(owner: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, values, minlength=n).astype(float)


def repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often its most frequent one comes."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]) if len(o) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[first], runs)
    return per_text(o[first], n), top


def measure(texts: list[bytes]) -> np.ndarray:
    """(texts, features) of whole texts. An empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in batches_of(texts, SEGMENT // 2):
        out[a:b] = measure_group(texts[a:b])
    return out


def measure_group(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    gaps = starts[1:] - 1
    kind = BYTE_CLASS[buf]
    counts = np.zeros((n, len(BYTE_CLASSES)))
    step = SEGMENT * 4
    for at in range(0, len(buf), step):  # a very long text is counted piece by piece
        part = kind[at : at + step]
        own = np.searchsorted(starts, np.arange(at, at + len(part)), side="right") - 1 if n > 1 else np.zeros(len(part), np.int64)
        counts += np.bincount(own * len(BYTE_CLASSES) + part, minlength=counts.size).reshape(counts.shape)
    counts[: len(gaps), BYTE_CLASSES.index("newline")] -= 1  # the joints between texts
    lo, hi = spans(~SPACE[buf])
    own = np.searchsorted(starts, lo, side="right") - 1
    words = per_text(own, n)
    w = np.maximum(words, 1)
    hashes = span_hashes_long(buf, lo, hi)
    distinct, top = repeats(own, hashes, n)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])]) if len(lo) else np.zeros(0, bool)
    longest = np.zeros(n)
    np.maximum.at(longest, own, hi - lo)
    cls = BYTE_CLASSES.index
    end_kind = kind[hi - 1] if len(hi) else np.zeros(0, np.uint8)
    marked = (end_kind == cls("symbol")) | (end_kind == cls("shout")) | (end_kind == cls("bar"))
    capital = kind[lo] == cls("upper") if len(lo) else np.zeros(0, bool)
    line_lo, line_hi = spans(buf != 10)
    line_own = np.searchsorted(starts, line_lo, side="right") - 1
    lines = per_text(line_own, n)
    line_distinct, _ = repeats(line_own, span_hashes_long(buf, line_lo, line_hi), n)
    size = np.maximum(sizes, 1)
    letters = counts[:, cls("lower")] + counts[:, cls("upper")]
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), np.log1p(lines), counts / size[:, None], per_text(own, n, (hi - lo).astype(float)) / w, longest, distinct / w, top / w, per_text(own, n, again.astype(float)) / w,
        per_text(own, n, marked.astype(float)) / w, per_text(own, n, capital.astype(float)) / w, words / np.maximum(lines, 1), 1 - line_distinct / np.maximum(lines, 1), counts[:, cls("upper")] / np.maximum(letters, 1),
    ])


def span_hashes_long(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """As span_hashes, in pieces of the buffer that end with a span, so that memory is bounded by the longest span."""
    out, at = [], 0
    while at < len(lo):
        end = max(at + 1, int(np.searchsorted(hi, lo[at] + 2 * SEGMENT, side="right")))
        a = int(lo[at])
        out.append(span_hashes(buf[a : int(hi[end - 1])], lo[at:end] - a, hi[at:end] - a))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Trees:
    """Boosted trees as flat arrays (trees, nodes); a leaf points to itself."""

    def __init__(self, feature, threshold, left, right, value, base: float):
        self.feature, self.threshold, self.left, self.right, self.value, self.base = feature, threshold, left, right, value, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                go = x[rows, self.feature[t][node]] <= self.threshold[t][node]
                node = np.where(go, self.left[t][node], self.right[t][node])
            out += self.value[t][node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with second-order gains on at most BINS quantile bins a feature."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(k)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)])
    base = float(np.log((y.mean() * n + 1) / ((1 - y.mean()) * n + 1)))
    raw, nodes = np.full(n, base), 2 ** (DEPTH + 1) - 1
    feature, threshold = np.zeros((TREES, nodes), np.int64), np.full((TREES, nodes), np.inf)
    left, right, value = np.tile(np.arange(nodes), (TREES, 1)), np.tile(np.arange(nodes), (TREES, 1)), np.zeros((TREES, nodes))
    offset = np.arange(k) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        level = {0: np.arange(n)}
        for depth in range(DEPTH + 1):
            nxt = {}
            for node, rows in level.items():
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, -1)
                if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
                    flat = (binned[rows] + offset).ravel()
                    gh = np.bincount(flat, np.repeat(g[rows], k), k * BINS).reshape(k, BINS).cumsum(1)
                    hh = np.bincount(flat, np.repeat(h[rows], k), k * BINS).reshape(k, BINS).cumsum(1)
                    many = np.bincount(flat, minlength=k * BINS).reshape(k, BINS).cumsum(1)
                    gain = gh**2 / (hh + 1) + (gs - gh) ** 2 / (hs - hh + 1) - gs**2 / (hs + 1)
                    gain[(many < LEAST_LEAF) | (len(rows) - many < LEAST_LEAF)] = 0
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    best = (gain[f, b], int(f), int(b))
                if best[1] >= 0 and best[0] > 1e-6:
                    _, f, b = best
                    feature[t, node], threshold[t, node] = f, edges[f][b]
                    left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
                    go = binned[rows, f] <= b
                    nxt[2 * node + 1], nxt[2 * node + 2] = rows[go], rows[~go]
                else:
                    value[t, node] = -RATE * gs / (hs + 1)
                    at[rows] = node
            level = nxt
        raw += value[t][at]
    return Trees(feature, threshold, left, right, value, base)


def measure_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = measure([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            stats = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("id"), stats], ["id", "stats"])


def score_batches(trees: Trees | None, prior: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            score = trees.probability(x) if trees is not None else np.full(len(x), prior)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.round(np.clip(score, 0, 1), 6))], ["id", "score"])

    return run


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, stats``: FEATURES of every row's whole text (null: empty)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(measure_batches, f"id {kind}, stats array<double>")


def learn(stats: DataFrame, labels: DataFrame) -> tuple[Trees | None, float]:
    """Trees from ``stats (id, stats)`` and ``labels (id, label)`` (0 or 1, others and nulls ignored), and the labels' mean.

    At most MOST_LABELS labels, drawn by a hash of the id. No trees where a label is missing altogether; the mean is 0.5
    where there are no labels.
    """
    known = labels.where("label IN (0, 1) AND id IS NOT NULL")
    n = known.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    rows = known.where(draw < min(1.0, 0.9 * MOST_LABELS / max(n, 1))).join(stats, "id").select("id", "label", "stats").limit(2 * MOST_LABELS).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["label"]))[:MOST_LABELS]
    y = np.array([r["label"] for r in rows], float)
    if not len(y):
        return None, 0.5
    return (boost(np.array([r["stats"] for r in rows]), y) if 0 < y.mean() < 1 else None), float(y.mean())


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``<id_col>, held_out, score, predicted`` of every row by its text alone.

    Learned from labelled rows whose id's CRC-32 modulo 3 is not 1; a null id counts as held out. A null text counts as
    empty and is scored as such. Equal texts get equal scores, and repeated rows stay rows.
    """
    out_of = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    stats = Scratch(docs.sparkSession).put(statistics(docs, id_col, text_col))
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~out_of)
    trees, prior = learn(stats, own)
    kind = docs.schema[id_col].dataType.simpleString()
    out = stats.mapInArrow(score_batches(trees, prior), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), out_of.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; null texts count as empty, no rows give none."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
