"""The sequence ratio against the standard library's, and near duplicates against all pairs."""

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.operators import audit, ratio


def slow(a, b):
    return SequenceMatcher(a=a, b=b, autojunk=False).ratio()


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=60), st.text("abc", max_size=60))
def test_ratio_of_short_texts(a, b):
    ratio.SMALL, kept = 0, ratio.SMALL
    try:
        assert ratio.ratio(a, b) == slow(a, b)
    finally:
        ratio.SMALL = kept


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "売上", "the "])
    return "".join(t)


@pytest.mark.parametrize("seed", range(6))
def test_ratio_of_longer_texts(seed):
    rng = random.Random(seed)
    a = "".join(rng.choice(["the ", "of ", "売上高", "profit ", "1", "2", "\n"]) for _ in range(500))
    for b in (edited(rng, a, 3), edited(rng, a, 90), "".join(rng.sample(a, len(a))), a, a[600:] + a[:600], ""):
        assert ratio.ratio(a, b) == slow(a, b)
        top = slow(a, b) * (len(a) + len(b)) / 2
        assert ratio.subsequence_reaches(a, b, top) and not ratio.subsequence_reaches(a, b, min(len(a), len(b)) + 1)


def test_long_texts_in_time():
    rng = random.Random(1)
    a = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(20_000))[:100_000]
    b = edited(rng, a, 400)
    began = time.process_time()
    assert ratio.subsequence_reaches(a, b, 0.9 * (len(a) + len(b)) / 2)
    assert 0.98 < ratio.ratio(a, b) < 1
    assert time.process_time() - began < 30


@pytest.mark.parametrize("tile", [128, 6])
def test_near_duplicates_of_a_fixture(spark, tile):
    rng = random.Random(tile)
    base = ["".join(rng.choice(["how ", "many ", "売上 ", "profit ", "year ", "of "]) for _ in range(n)) for n in (2, 9, 30, 31)]
    rows = [(k, edited(rng, rng.choice(base), rng.choice([0, 1, 3])), rng.choice("xy"), "s", "2024", rng.choice(["1", " 1 ", None])) for k in range(110)] + [(200, " ", "x", "s", "2024", "1"), (201, None, "x", "s", "2024", "1")]
    df = spark.createDataFrame(rows, "idx bigint, question string, company_name string, subtask string, filing_year string, answer string")
    got = {(r.first_index, r.similar_index): r.ratio for r in audit.near_duplicates(df, tile=tile).collect()}
    want = {}
    for i, q, c, *_, x in rows:
        for j, p, d, *_, y in rows:
            if i < j and c == d and (x or "").strip() == (y or "").strip() and q != p and (q or "").strip() and (p or "").strip() and (r := slow(q, p)) >= 0.9:
                want[i, j] = round(r, 3)
    assert got == pytest.approx(want) and len(want) > 100


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("strip", [1, 5, 512])
def test_subsequences_of_many_texts_at_once(strip, monkeypatch):  # F3
    monkeypatch.setattr(ratio, "STRIP", strip)
    rng = random.Random(strip)
    for _ in range(60):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))
        others = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))) if rng.random() < 0.4 or len(text) < 9 else edited(rng, text, 4) for _ in range(9)]
        for off in (-2, -1, 0, 0.5, 1):
            least = [common(text, x) + off for x in others]
            assert ratio.subsequences_reach(text, others, [ratio.places_of(x) for x in others], least) == [off <= 0] * 9
