"""Byte-level BPE token ids of whole texts, and token counts of a document's sections by offset-mapped attribution.

Ids are those of ``tokenizers`` with the vocabulary file ``byte_bpe_50k.json``. ``tiktoken`` holds the same vocabulary as
ranks and finds the same ids several times faster, so it does the work; a text that holds the vocabulary's special string,
and any text that tiktoken refuses, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm.common import by_value, table

by_value(__name__)

JSON_FILE = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Runs of white space from this length on are more than tiktoken's pattern engine takes; only longer texts are looked through.
LONG_BLANK = 100_000
BLANKS = re.compile(r"\s+")


class ByteBpe:
    """Encoder for the vocabulary at ``json_path`` / ``rank_path`` (default: where public_tokenizers keeps them)."""

    def __init__(self, json_path: str | None = None, rank_path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path(JSON_FILE)
        with open(rank_path or public_tokenizers.path(RANK_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None
        self.lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, k in ranks.items():
            self.lengths[k] = len(token)
        self.lengths[-1] = len(SPECIAL)

    def plain(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        """Ids of one text, uint32."""
        if SPECIAL in text or (len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in BLANKS.finditer(text))):
            return np.array(self.plain(text), np.uint32)
        try:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        except BaseException as e:  # a panic of the compiled side isn't an Exception
            if isinstance(e, ValueError) or type(e).__name__ == "PanicException":
                return np.array(self.plain(text), np.uint32)
            raise


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about ``most`` bytes of text (a longer text alone)."""
    sizes = np.array(pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most):
            size += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def piece_batches(capacity: int, end_id: int, json_path: str | None, rank_path: str | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe(json_path, rank_path)
        end = np.array([end_id], np.uint32)
        for whole in it:
            for batch in slices(whole, "text"):
                rows, piece, start, length, ids = [], [], [], [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    own = np.concatenate([encode(text) if text else end[:0], end])
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        ids.append(own[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """``<id_col>, piece, start, length, ids``: each text's ids and then ``end_id``, cut only where longer than ``capacity``.

    The first piece takes the remainder, so that only one piece of a document is ever short. ``ids`` are little-endian
    unsigned 32-bit values. A null text counts as empty: one piece that holds ``end_id``. Every row gives its own pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(piece_batches(capacity, end_id, json_path, rank_path), f"id {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("id", id_col)


def section_batches(fields: list[str], rule: str, json_path: str | None, rank_path: str | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe(json_path, rank_path)
        for whole in it:
            for batch in slices(whole, fields[0]):
                cols: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "field", "section", "char_start", "char_end", "n_tokens", "n_shared")}
                texts = [batch.column(f).to_pylist() for f in fields]
                for k in range(batch.num_rows):
                    parts = [t[k] or "" for t in texts]
                    # fields are encoded as one text, a newline between them; the newline belongs to the field that it ends
                    data = "\n".join(parts)
                    raw = np.frombuffer(data.encode(), np.uint8)
                    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                    if len(starts) > 1 and starts[-1] == len(raw) and len(parts) == 1:
                        starts = starts[:-1]  # a newline at the end opens no section
                    ends = np.append(starts[1:], len(raw))
                    lines = np.array([p.count("\n") + 1 for p in parts])
                    if len(parts) == 1:
                        lines[0] = len(starts)
                    ids = encode(data)
                    hi = np.cumsum(encode.lengths[ids])
                    lo = hi - encode.lengths[ids]
                    a = np.searchsorted(starts, lo, side="right") - 1
                    b = np.searchsorted(starts, hi - 1, side="right") - 1
                    n = len(starts)
                    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    field = np.repeat(np.arange(len(parts)), lines)
                    cols["row"].append(np.full(n, k))
                    cols["field"].append(field)
                    cols["section"].append(np.arange(n) - np.repeat(np.cumsum(lines) - lines, lines))
                    cols["char_start"].append(lead[starts])
                    cols["char_end"].append(lead[ends])
                    cols["n_tokens"].append(np.bincount(a if rule == "first" else b, minlength=n))
                    cols["n_shared"].append(np.bincount(a[a != b], minlength=n))
                flat = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in cols.items()}
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(flat["row"], pa.int64())), pa.array([fields[f] for f in flat["field"]] if len(fields) > 1 else pa.DictionaryArray.from_arrays(pa.array(flat["field"], pa.int32()), pa.array(fields)).cast(pa.string()), pa.string()),
                    pa.array(flat["section"], pa.int32()), *(pa.array(flat[c], pa.int64()) for c in ("char_start", "char_end", "n_tokens", "n_shared")),
                ], ["id", "field", "section", "char_start", "char_end", "n_tokens", "n_shared"])

    return run


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "first", id_col: str = "doc_id", json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """``<id_col>, field, section, char_start, char_end, n_tokens, n_shared`` for every line of every field.

    A row's fields are joined by newlines and encoded once, whole; the tokens' spans are then interval-joined to the
    lines' spans. A line's newline belongs to the line that it ends; spans are in characters of the joined text. A token
    that lies in several lines counts for the one with its first byte (``rule="first"``) or its last (``"last"``) and as
    ``n_shared`` for the one where it begins; so the counts of a row's lines add up to its tokens. A null or empty text is
    one empty section with no tokens. Every row gives its own sections, rows with a null id too.
    """
    if rule not in ("first", "last"):
        raise ValueError(f"rule is first or last, not {rule!r}")
    kind = docs.schema[id_col].dataType.simpleString()
    names = list(fields)
    rows = docs.selectExpr(f"`{id_col}` AS id", *(f"`{f}` AS f{k}" for k, f in enumerate(names)))
    out = rows.mapInArrow(section_batches([f"f{k}" for k in range(len(names))], rule, json_path, rank_path), f"id {kind}, field string, section int, char_start bigint, char_end bigint, n_tokens bigint, n_shared bigint")
    back = " ".join(f"WHEN 'f{k}' THEN '{f}'" for k, f in enumerate(names))
    return out.selectExpr(f"id AS `{id_col}`", f"CASE field {back} END AS field", "section", "char_start", "char_end", "n_tokens", "n_shared")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, field, section, char_start, char_end, n_tokens, n_shared of every line of every document; null texts are one empty line."""
    return count_tokens(table(spark, sf_dir, "documents"))
