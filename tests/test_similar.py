"""Similar pairs of a block and the rows that stay, against going through them one by one."""

import random
import unicodedata

import numpy as np
import pytest

from ledgerlark.operators import similar, validate

SCHEMA = "pos bigint, question string, subtask string, edinet_code string"


def form(t):
    return unicodedata.normalize("NFKC", (t or "").strip()).replace("△", "-").replace("▲", "-").replace(",", "").lower()


def grams(t):
    t = form(t)
    return {t[i : i + 3] for i in range(len(t) - 2)}


def jaccard(g, k):
    return len(g & k) / len(g | k) if g and k else 0.0


def greedy(rows):
    kept, out = {}, []
    for pos, text, *block in rows:
        own, g = kept.setdefault(tuple(block), []), grams(text)
        if not any(jaccard(g, k) > 0.7 for k in own):
            own.append(g)
            out.append(pos)
    return out


def texts(rng, n):
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 9, 40, 41, 90]))) for _ in range(max(1, n // 6))]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice("xyz売上")
        out.append("".join(t))
    return out


@pytest.mark.parametrize(("tile", "most"), [(2048, 1 << 20), (7, 1 << 20), (3, 5), (2048, 9)])
def test_dedupe_in_tiles_and_turns(spark, tile, most):
    rng = random.Random(tile + most)
    rows = [(k, t, rng.choice("aab"), rng.choice(["E1", "E1", "E2"])) for k, t in enumerate(texts(rng, 220))] + [(900, None, "a", "E1"), (901, "", "a", "E1"), (902, "ab", "a", "E1"), (903, "ab", "a", "E1"), (904, "𠮷野家😀", "a", "E1"), (905, "𠮷野家😀", "a", "E1")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.pos for r in validate.dedupe(df, tile=tile, most_pairs=most).collect()) == greedy(rows)


@pytest.mark.parametrize("tile", [2048, 10])
def test_pairs_are_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(similar, "PART", 16)
    rng = random.Random(tile)
    rows = [(k, t, rng.choice("ab")) for k, t in enumerate(texts(rng, 150))]
    df = spark.createDataFrame([(b, k, form(t)) for k, t, b in rows], "_k0 string, pos bigint, text string")
    got = [(r.a, r.b) for r in similar.gram_pairs(df, ["_k0"], 0.7, tile).collect()]
    want = [(i, j) for i, s, b in rows for j, t, c in rows if i < j and b == c and jaccard(grams(s), grams(t)) > 0.7]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want) and len(want) > 50


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64) for _ in range(90)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = similar.shared(sets, 0)
    assert all(got[i, j] == want[i][j] for i in range(90) for j in range(90) if i != j)
    assert (similar.shared(sets, 30) == np.array(want)[:30, 30:]).all()


@pytest.mark.parametrize("most", [1 << 20, 700])
def test_a_long_chain_ends(spark, most):
    edges = spark.createDataFrame([("x", k, k + 1) for k in range(5000)] + [("y", 7000, 7001)], "_k0 string, a bigint, b bigint")
    gone = sorted(r.v for r in similar.dropped(edges, ["_k0"], most).collect())
    assert gone == [*range(1, 5001, 2), 7001]
    assert similar.dropped(edges.limit(0), ["_k0"]) is None


def test_a_chain_of_similar_texts(spark):
    letters = "".join(chr(0x4E00 + k) for k in range(5100))
    rows = [(k, letters[k : k + 20], "s", "c") for k in range(5000)]  # each like its next three
    kept = sorted(r.pos for r in validate.dedupe(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == greedy(rows[:300])[:60] + kept[60:] and all(b - a == kept[1] - kept[0] for a, b in zip(kept, kept[1:]))


def written(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_texts_move_to_their_tile_once(spark):
    rng = random.Random(5)
    rows = [("x", k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1000))) for k in range(400)]
    rows += [("x", 1000 + k, t + "!") for _, k, t in rows[:30]] + [("y", 2000, rows[0][2])]
    df = spark.createDataFrame(rows, "_k0 string, pos bigint, text string")
    before, key = written(spark), "spark.sql.requireAllClusterKeysForDistribution"
    spark.conf.set(key, "true")  # what meets in a task is shuffled, not sorted where it happens to be
    got = {(r.a, r.b) for r in similar.gram_pairs(df, ["_k0"], 0.7, 10).collect()}
    spark.conf.unset(key)
    assert got == {(k, 1000 + k) for k in range(30)}
    assert sum(n for k, n in written(spark).items() if k not in before) < 10 * len(rows)  # 43 tiles of a block
