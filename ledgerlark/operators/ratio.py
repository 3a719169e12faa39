"""The sequence ratio of two texts, by matching blocks, and the pairs of a tile that reach one."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from ledgerlark.ship import by_value

by_value(__name__)

RATIO_TILE = 128
#: Ranges with fewer pairs of characters than this are matched by the standard library.
SMALL = 1 << 14
#: Rows of a strip of the common subsequence's table.
STRIP = 512
BASE = 0x9E3779B97F4A7C15


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Hashes:
    """Hashes of all windows of a text: equal windows have equal ones."""

    def __init__(self, text: str, powers: np.ndarray, inverse: np.ndarray):
        own = codes(text) + np.uint64(1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers[: len(own)], dtype=np.uint64)])
        self.inverse = inverse

    def windows(self, lo: int, hi: int, size: int) -> np.ndarray:
        return (self.sums[lo + size : hi + 1] - self.sums[lo : hi + 1 - size]) * self.inverse[lo : hi + 1 - size]


def powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def matched(a: str, b: str) -> int:
    """How many characters the matching blocks of two texts hold: the longest common block, of several the first in ``a``, of
    these the first in ``b``, then the same to its left and to its right.

    The longest block of a large range is found by bisection of its length over window hashes, and compared itself.
    """
    size = max(len(a), len(b)) + 1
    powers, inverse = powers_of(BASE, size), powers_of(pow(BASE, -1, 1 << 64), size)
    left, right = Hashes(a, powers, inverse), Hashes(b, powers, inverse)
    total, todo = 0, [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        n, m = ahi - alo, bhi - blo
        if not n or not m:
            continue
        if n * m <= SMALL:
            total += plain(a[alo:ahi], b[blo:bhi])
            continue
        most = min(most, n, m)
        long, i = 0, -1
        lo, hi = 1, most
        step = 8
        while lo <= hi:  # first doubling lengths, then halving what is between
            at = min(hi, step) if step else (lo + hi) // 2
            mine, other = left.windows(alo, ahi, at), np.unique(right.windows(blo, bhi, at))
            place = np.minimum(np.searchsorted(other, mine), len(other) - 1)
            hit = other[place] == mine
            if hit.any():
                long, i, lo = at, int(hit.argmax()), at + 1
                step = step * 4 if step else 0
            else:
                hi, step = at - 1, 0
        if not long:
            continue
        j = int((right.windows(blo, bhi, long) == left.windows(alo, ahi, long)[i]).argmax())
        x, y = alo + i, blo + j
        if a[x : x + long] != b[y : y + long]:  # two windows of one hash
            total += plain(a[alo:ahi], b[blo:bhi])
            continue
        total += long
        todo += [(alo, x, blo, y, long), (x + long, ahi, y + long, bhi, long)]
    return total


def plain(a: str, b: str) -> int:
    return sum(x.size for x in SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks())


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all characters; 1 for two empty texts."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def places_of(text: str) -> dict[str, int]:
    """The places of each character of a text: a whole number, a bit a place."""
    masks: dict[str, int] = {}
    for k in range(0, len(text), 4096):  # in pieces: numbers grow with their highest bit
        own: dict[str, int] = {}
        for j, c in enumerate(text[k : k + 4096]):
            own[c] = own.get(c, 0) | 1 << j
        for c, v in own.items():
            masks[c] = masks.get(c, 0) | v << k
    return masks


def subsequence_reaches(a: str, b: str, least: float) -> bool:
    """Whether the longest common subsequence of two texts has ``least`` characters."""
    return subsequences_reach(b, [a], [places_of(a)], [least])[0]


class Window:
    """The part of a text that the present strip of rows can meet, and what was matched left of it."""

    def __init__(self, k: int, size: int, most: int):
        self.k, self.size, self.most = k, size, most
        self.before = self.lo = self.hi = self.row = self.bytes = 0  # a 0 in ``row`` is one more character matched

    def slide(self, top: int, rows: int) -> None:
        lo, hi = max(0, top - (rows - self.most)), min(self.size, top + STRIP + self.size - self.most)
        if (gone := lo - self.lo) > 0:
            self.before += gone - (self.row & (1 << gone) - 1).bit_count()
            self.row >>= gone
        self.row |= (1 << hi - lo) - (1 << self.hi - lo)
        self.lo, self.hi, self.bytes = lo, hi, (hi - lo) // 8 + 1  # a bit at least stays free for the carry

    def reaches(self, rest: int) -> bool:
        """Whether enough can be matched with ``rest`` rows to come, wherever in the text they begin."""
        wide = self.hi - self.lo
        step = max(1, wide // 8)
        return any(self.before + end - (self.row & (1 << end) - 1).bit_count() + min(rest, self.size - self.lo - end + step) >= self.most for end in (*range(step, wide, step), wide))


def subsequences_reach(text: str, others: list[str], places: list[dict[str, int]], least: list[float]) -> list[bool]:
    """Whether the longest common subsequence of a text with each of others (``places``: their ``places_of``) has so many
    characters: an upper bound of what blocks can match.

    A row of all tables, of one character of the text, is one whole number, a bit a character of the others. Only cells near the
    diagonal count: one that is further off leaves too few characters before or behind it. So a strip of rows needs a window
    of each, and those of which too little is left drop out after it.
    """
    out = [True] * len(others)
    alive = []
    for k, other in enumerate(others):
        most = math.ceil(least[k])
        out[k] = most <= min(len(text), len(other))
        if out[k] and most > 0:
            alive.append(Window(k, len(other), most))
    for top in range(0, len(text), STRIP):
        if not alive:
            break
        strip = text[top : top + STRIP]
        for w in alive:
            w.slide(top, len(text))
        row = int.from_bytes(b"".join(w.row.to_bytes(w.bytes, "little") for w in alive), "little")
        bits = [(1 << w.hi - w.lo) - 1 for w in alive]
        full = int.from_bytes(b"".join(f.to_bytes(w.bytes, "little") for w, f in zip(alive, bits, strict=True)), "little")
        own = {c: int.from_bytes(b"".join((places[w.k].get(c, 0) >> w.lo & f).to_bytes(w.bytes, "little") for w, f in zip(alive, bits, strict=True)), "little") for c in set(strip)}
        for c in strip:
            both = row & own[c]
            row = ((row + both) | (row - both)) & full
        told, at, stay = row.to_bytes(sum(w.bytes for w in alive), "little"), 0, []
        for w in alive:
            w.row = int.from_bytes(told[at : at + w.bytes], "little")
            at += w.bytes
            if w.reaches(len(text) - top - len(strip)):
                stay.append(w)
            else:
                out[w.k] = False
        alive = stay
    return out


def ratios_of(least: float):
    """``a, b, ab, ba`` of a task's texts (sides as in ``in_tiles``): positions a < b, and the ratio both ways where one of them
    reaches ``least``."""

    def run(rows: pa.Table) -> pa.Table:
        side, pos, text = (rows.column(c).to_pylist() for c in ("side", "pos", "text"))
        chars, place = np.unique(np.concatenate([codes(t) for t in text]), return_inverse=True)
        size = np.array([len(t) for t in text])
        count = np.bincount(np.repeat(np.arange(len(text)), size) * len(chars) + place, minlength=len(text) * len(chars)).reshape(len(text), -1)
        left, right = (np.flatnonzero(np.array(side) == s) for s in (0, 1))
        out, places = [], {}
        for at, i in enumerate(left):
            others = right if len(right) else left[at + 1 :]
            need = least * (size[i] + size[others]) / 2 - 1e-6
            near = others[(np.minimum(size[others], size[i]) >= need) & (np.minimum(count[others], count[i]).sum(axis=1) >= need)]
            for k in near:
                if k not in places:
                    places[k] = places_of(text[k])
            needs = [least * (size[i] + size[j]) / 2 - 1e-6 for j in near]
            for j, so_long in zip(near, subsequences_reach(text[i], [text[j] for j in near], [places[j] for j in near], needs), strict=True):
                if so_long:
                    a, b = (i, j) if pos[i] < pos[j] else (j, i)
                    ab, ba = ratio(text[a], text[b]), ratio(text[b], text[a])
                    if max(ab, ba) >= least:
                        out.append((pos[a], pos[b], ab, ba))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["a", "b", "ab", "ba"])

    return run
