"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, forwards and backwards, labels every position with language
probabilities, and a document's probabilities are the mean over its positions that belong to letters. Windows overlap: each
labels its own bytes and reads those around them first, in both directions, so that no position lacks context at a cut. It is
trained here in numpy by backpropagation through time on a bounded sample of labelled windows, and applied to every byte of
every text.

Arrays are held features first, lanes (windows) last, so that each gate is one contiguous block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import by_value, table

by_value(__name__)

#: The bound of the training sample: documents of each language, and windows of each document.
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 6
#: Bytes that a window labels, and bytes on each side of them that it reads for context.
WINDOW, AROUND = 64, 16
READS = WINDOW + 2 * AROUND
HIDDEN = 8
LANES = 2048
STEPS = 300
BATCH = 192
#: A document is rejected where its best language has a smaller probability than so many times that of chance.
LEAST = 1.1

ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes that belong to letters, as far as bytes can tell: ASCII letters and every byte of a character beyond ASCII.
LETTER = np.zeros(256, np.float32)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def to_bytes(text: str) -> bytes:
    return text.lower().encode()


def windows_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into windows: READS bytes each, zeros beyond the text's ends; and how many windows each text has."""
    n = np.array([-(-len(d) // WINDOW) for d in data], np.int64)
    out = np.empty((int(n.sum()), READS), np.uint8)
    at = 0
    for d, k in zip(data, n.tolist(), strict=True):
        if k:
            whole = np.frombuffer(bytes(AROUND) + d + bytes(AROUND + WINDOW - 1 - (len(d) - 1) % WINDOW), np.uint8)
            out[at : at + k] = np.lib.stride_tricks.sliding_window_view(whole, READS)[::WINDOW]
            at += k
    return out, n


class BiGru:
    """Weights as a dict of float32 arrays; direction 0 reads forwards, 1 backwards.

    ``x`` (2, 3H, 256) what each byte adds to the gates; ``u`` (2, 3H, H) what the state adds; ``b`` (2, H, 1) the
    candidate's own bias inside the reset gate; ``v`` (C, 2H) and ``c`` (C, 1) the labels. Gates in order: update, reset,
    candidate. Update and reset arguments are halves: sigmoid(a) = (1 + tanh(a / 2)) / 2.
    """

    def __init__(self, labels: list[str], weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        self.labels, h, c = labels, HIDDEN, len(labels)
        rng = np.random.default_rng(seed)
        self.w = weights or {
            "x": rng.normal(0, 0.3, (2, 3 * h, 256)), "u": rng.normal(0, 0.3, (2, 3 * h, h)), "b": np.zeros((2, h, 1)), "v": rng.normal(0, 0.3, (c, 2 * h)), "c": np.zeros((c, 1)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def read(self, data: np.ndarray, direction: int, keep: bool = False):
        """States (T, H, B) after each byte of (T, B) bytes in reading order; with ``keep`` also what training needs."""
        w, h = self.w, HIDDEN
        x, u, b = w["x"][direction], w["u"][direction], w["b"][direction]
        steps, lanes = data.shape
        out = np.empty((steps, h, lanes), np.float32)
        state, held = np.zeros((h, lanes), np.float32), []
        g, m = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
        for t in range(steps):
            np.take(x, data[t], axis=1, out=g, mode="clip")
            np.matmul(u, state, out=m)
            zr = g[: 2 * h] + m[: 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            own = m[2 * h :] + b
            n = own * zr[h:]
            n += g[2 * h :]
            np.tanh(n, out=n)
            if keep:
                held.append((state, zr, own, n))
            nxt = out[t]
            np.subtract(state, n, out=nxt)
            nxt *= zr[:h]
            nxt += n
            state = nxt
        return (out, held) if keep else out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (T, C, B) of every label at every position of (T, B) bytes."""
        f, b = self.read(data, 0), self.read(data[::-1], 1)[::-1]
        v, h = self.w["v"], HIDDEN
        logits = np.matmul(v[:, :h], f)
        logits += np.matmul(v[:, h:], b)
        logits += self.w["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def documents(self, data: list[bytes]) -> np.ndarray:
        """Pooled probabilities (documents, C); zeros for a text without letters' bytes."""
        win, n = windows_of(data)
        sums = np.zeros((len(win) + 1, len(self.labels) + 1))
        for a in range(0, len(win), LANES):
            part = np.ascontiguousarray(win[a : a + LANES].T)
            p, mask = self.positions(part)[AROUND : AROUND + WINDOW], LETTER[part[AROUND : AROUND + WINDOW]]
            for c in range(len(self.labels)):
                sums[a : a + part.shape[1], c] = np.einsum("tb,tb->b", p[:, c], mask)
            sums[a : a + part.shape[1], -1] = mask.sum(axis=0)
        starts = np.cumsum(n) - n
        out = np.add.reduceat(sums, np.minimum(starts, len(win)), axis=0)
        out[n == 0] = 0
        return out[:, :-1] / np.maximum(out[:, -1:], 1)

    def gradient(self, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over letters' positions and its gradient, by backpropagation through time."""
        w, h = self.w, HIDDEN
        steps, lanes = data.shape
        order = (data, data[::-1])
        (f, keep_f), (b, keep_b) = self.read(order[0], 0, True), self.read(order[1], 1, True)
        states = (f, b)
        both = np.concatenate([f, b[::-1]], axis=1)
        logits = np.matmul(w["v"], both) + w["c"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        mask = LETTER[data]
        total = max(1.0, float(mask.sum()))
        right = p[np.arange(steps)[:, None], label[None, :], np.arange(lanes)[None, :]]
        loss = -float((np.log(right + 1e-9) * mask).sum()) / total
        d = p
        d[np.arange(steps)[:, None], label[None, :], np.arange(lanes)[None, :]] -= 1
        d *= mask[:, None, :] / total
        g = {k: np.zeros_like(a) for k, a in w.items()}
        g["v"] = np.einsum("tcb,thb->ch", d, both)
        g["c"] = d.sum(axis=(0, 2))[:, None]
        back = np.matmul(w["v"].T, d)
        for direction, held in enumerate((keep_f, keep_b)):
            u = w["u"][direction]
            own_d = back[:, :h] if direction == 0 else back[::-1, h:]
            gates = np.zeros((steps, 3 * h, lanes), np.float32)
            flow = np.zeros((h, lanes), np.float32)
            for t in range(steps - 1, -1, -1):
                before, zr, own, n = held[t]
                z, r = zr[:h], zr[h:]
                dh = own_d[t] + flow
                dz = dh * (before - n) * z * (1 - z) * 2  # the argument is a half
                dn = dh * (1 - z) * (1 - n * n)
                dr = dn * own * r * (1 - r) * 2
                gates[t, :h], gates[t, h : 2 * h], gates[t, 2 * h :] = dz, dr, dn
                inner = np.concatenate([dz, dr, dn * r])
                g["u"][direction] += inner @ before.T
                g["b"][direction] += (dn * r).sum(axis=1, keepdims=True)
                flow = dh * z + u.T @ inner
            flat = gates.transpose(1, 0, 2).reshape(3 * h, -1)
            x = order[direction].reshape(-1)
            for k in range(3 * h):
                g["x"][direction][k] = np.bincount(x, flat[k], 256)
        del states
        return loss, g

    def train(self, data: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam on random batches of (windows, READS) bytes; the losses."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(data), BATCH)
            loss, g = self.gradient(np.ascontiguousarray(data[pick].T), label[pick])
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def held_out(id_col: str, parts: int, which: int):
    """Whether a document is never learned from: CRC-32 of its id as text. A null id is held out."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % parts == which, F.lit(True))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGru | None:
    """A network learned from ``docs`` (all of which may be learned from); None where no labelled text has a letter.

    At most DOCS_PER_LANGUAGE documents of each language by a hash of their ids, WINDOWS_PER_DOC windows of each, spread
    evenly over the text, come to the driver, however often an id repeats. Languages are the distinct non-null labels.
    """
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", f"`{lang_col}` AS lang").where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    chance = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * DOCS_PER_LANGUAGE / n))) for k, n in sorted(counts.items())))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    # the draw needs no text: a document that isn't drawn costs no more than its scan
    drawn = rows.where(draw < chance)
    cut = f"transform(sequence(0, {WINDOWS_PER_DOC - 1}), i -> substring(text, cast(i * greatest(char_length(text) - {READS}, 0) / {WINDOWS_PER_DOC - 1} AS int) + 1, {READS}))"
    # rows that repeat an id and a text are drawn together, but count and travel once
    once = drawn.select("lang", "id", F.expr(f"array_distinct({cut})").alias("windows")).distinct()
    # a draw by ids brings all rows of an id: the first ones of a language are kept in each task, then of all tasks
    first = F.row_number().over(Window.partitionBy("lang").orderBy("id", "windows"))
    got = once.withColumn("place", first).where(F.col("place") <= DOCS_PER_LANGUAGE).drop("place").collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["id"], r["windows"])):
        by.setdefault(r["lang"], []).append(r["windows"])
    labels, data, label = sorted(by), [], []
    for number, lang in enumerate(labels):
        # a document's first window is read as in prediction: after nothing
        many = [(k == 0, w) for own in by[lang][:DOCS_PER_LANGUAGE] for k, w in enumerate(own)]
        size = max(len(by[x][:DOCS_PER_LANGUAGE]) for x in labels) * WINDOWS_PER_DOC
        many = (many * -(-size // len(many)))[:size]  # languages with fewer documents count as much
        for first, w in many:
            b = (bytes(AROUND if first else 0) + to_bytes(w))[:READS]
            data.append(b + bytes(READS - len(b)))
            label.append(number)
    if not labels:
        return None
    net = BiGru(labels)
    net.train(np.frombuffer(b"".join(data), np.uint8).reshape(-1, READS), np.array(label))
    return net


def predict_batches(labels: list[str], weights: dict[str, np.ndarray] | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiGru(labels, weights) if weights is not None else None
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                known = np.array([has_letter(t) for t in texts]) & (net is not None)
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if known.any():
                    p = net.documents([to_bytes(t) for t, k in zip(texts, known, strict=True) if k])
                    best[known], score[known] = p.argmax(axis=1), p.max(axis=1)
                lang = [labels[b] if k else "und" for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns - 1)), pa.array(lang, pa.string()), pa.array(np.round(np.clip(score, 0, 1), 6))], [*part.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, held_out, lang_pred, score`` of every row by its text alone.

    A text that is null or has no letter is ``und`` with score 0; so is every text where nothing could be learned. Equal
    texts get equal predictions; repeated rows and null ids stay rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(predict_batches(net.labels if net else [], net.w if net else None), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in a known language, all columns: not ``und``, and with a score that is more than chance.

    Null, empty and letterless texts go. Where nothing can be learned, since no labelled text has a letter, nothing is known
    against any text with a letter, and all of those stay. Rows with null or repeated ids are judged by their texts like
    others; an empty table gives no rows.
    """
    net = train_on(docs.where(~held_out(id_col, 4, 2)), id_col, text_col, lang_col)
    if net is None:
        return docs.where(F.col(text_col).rlike("\\p{L}"))
    names, kinds = docs.columns, [f.dataType for f in docs.schema]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(text_col).alias("text"))
    schema = ", ".join([*(f"c{k} {t.simpleString()}" for k, t in enumerate(kinds)), "lang_pred string", "score double"])
    out = rows.mapInArrow(predict_batches(net.labels if net else [], net.w if net else None), schema)
    least = LEAST / max(2, len(net.labels) if net else 2)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; null and letterless texts are ``und``, no rows give none."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train_on(docs.where(~held_out("doc_id", 4, 2))))
