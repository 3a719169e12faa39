"""Quality rules, embedding whitening and collocations against plain versions, with nulls, ties, long texts and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.llm import collocations, quality_rules, whitening

CLASHING = {"id": "1", "n": "2", "x": "3", "kept": "true", "rank": "4", "phrase": "'p'", "n_words": "5", "label": "6", "component": "7", "shard": "8"}


def clash(df):
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in CLASHING.items() if k not in df.columns))


# quality rules


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:]))
    marked = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if windows[g] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), failed


ODD_TEXTS = [None, "", " \t\n\x0b\x0c\r ", "a", "a a a a", "a b c a b c", "a b c d a b c d a", "x\nx\n\nx \ny\n y\ny", "# * $ % & | < >", "\x1c odd\x85white\xa0space ideographic", "日本 語😀 日本 語😀 日本 語😀", "w " * 200_000, "one two three " * 40 + "end"]


def test_counts_of_texts(spark):
    rng = random.Random(1)
    texts = [*ODD_TEXTS, *("".join(rng.choice(["a", "b", "c ", " ", "\n", "d\n", "#", "\t", "é "]) for _ in range(rng.choice([3, 30, 400]))) for _ in range(150))]
    df = clash(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(df, none).collect()}
    assert got == {k: counts(t) for k, t in enumerate(texts)}


def grown(rows):
    """The learner over plain rows (label, grow, {statistic: value})."""

    def fits(r, tests):
        return all(r[2][s] <= t if sign == "<=" else r[2][s] >= t for s, sign, t in tests)

    rules, rest = [], list(rows)
    while len(rules) < quality_rules.MOST_RULES:
        have = Counter(label for label, grow, _ in rest if grow)
        verdict = 0 if have[0] <= have[1] else 1
        if have[verdict] < quality_rules.LEAST_ROWS or not have[1 - verdict]:
            break
        tests = []
        while len(tests) < quality_rules.MOST_TESTS:
            own = [r for r in rest if r[1] and fits(r, tests)]
            best = None
            p0, n0 = (sum((r[0] == verdict) == same for r in own) for same in (True, False))
            for s in quality_rules.STATISTICS:
                values = sorted({r[2][s] for r in own})
                for v, above in zip(values, values[1:]):
                    for sign, t in (("<=", (v + above) // 2), (">=", (v + above) // 2 + 1)):
                        p = sum(r[0] == verdict for r in own if fits(r, [(s, sign, t)]))
                        n = sum(r[0] != verdict for r in own if fits(r, [(s, sign, t)]))
                        if p >= quality_rules.LEAST_ROWS:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, (s, sign, t), n
            if best is None:
                break
            tests.append(best[1])
            if not best[2]:
                break
        if not tests:
            break
        sides = []
        for k in range(1, len(tests) + 1):
            own = [r for r in rest if not r[1] and fits(r, tests[:k])]
            sides.append((sum(r[0] == verdict for r in own), sum(r[0] != verdict for r in own)))
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in sides]
        k = max(range(len(tests)), key=lambda k: (worth[k], -k))
        p, n = sides[k]
        if not p or 100 * p < quality_rules.LEAST_RIGHT * (p + n):
            break
        rules.append(quality_rules.Rule(verdict, tuple(tests[: k + 1])))
        rest = [r for r in rest if not fits(r, tests[: k + 1])]
    have = Counter(r[0] for r in rest)
    return rules, 1 if have[1] >= have[0] else 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_list_is_that_of_plain_covering(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        x = {s: rng.randint(0, 40) for s in quality_rules.STATISTICS}
        bad = x["symbol_share"] > 30 or (x["size"] < 10 and x["stop_share"] < 15) or (seed == 2 and x["line_words"] == 7)
        rows.append((int(not bad) if rng.random() > 0.04 * (seed == 3) else rng.randint(0, 1), rng.random() < 0.67, x))
    df = spark.createDataFrame([(label, grow, *(x[s] for s in quality_rules.STATISTICS)) for label, grow, x in rows], f"label int, grow boolean, {', '.join(f'{s} int' for s in quality_rules.STATISTICS)}").cache()
    rules, rest = quality_rules.learn(df)
    assert (rules, rest) == grown(rows) and len(rules) >= 2
    verdict, number = quality_rules.applied(rules, rest)
    got = df.select("label", verdict.alias("v"), number.alias("k")).collect()
    assert sum(r.label == r.v for r in got) >= 0.93 * len(got) and {r.k for r in got} >= {1, 2}
    assert df.select(verdict.alias("v"))._jdf.queryExecution().toString().count("Python") == 0


def test_rules_without_labels_or_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, text)], "doc_id bigint, text string")
    for labels, want in (([], [True, True, True, False, True]), ([(1, None), (None, 1), (7, 1), (3, 5)], [True, True, True, False, True])):
        got = quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
        assert sorted(r.kept for r in got) == sorted(want) and {r.rule for r in got} == {None, 0}
        assert [r.held_out for r in got] == [r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got]
    assert quality_rules.quality_rules(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND NOT base_failed AND quality IS NOT NULL").select(F.col("kept").cast("int").alias("k"), "quality").collect()
    assert len(got) > 60 and sum(r.k == r.quality for r in got) >= 0.97 * len(got)


# whitening


def plain_whitening(vectors, components=4):
    xs = {k: [math.floor(256 * float(c)) for c in v] for k, v in vectors.items()}
    fit = sorted({tuple(x) for x in xs.values()})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[Fraction(x[j]) - Fraction(total[j], n) for j in range(d)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    z = {k: np.array([float(Fraction(v) - Fraction(t, n)) for v, t in zip(x, total)]) for k, x in xs.items()}
    return n, {k: sum((n * v - t) ** 2 for v, t in zip(x, total)) for k, x in xs.items()}, {k: z[k] @ u[:, order] / np.sqrt(e[order]) for k in z}, e[order] / np.trace(cov)


def whitened(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_whitening_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) * np.array([9, 5, 3, 2, 1, 0.5]) + np.array([100, -70, 3, 0, 0, 8])
    vectors = {k: base[k % 60].astype(np.float32).tolist() for k in range(200)}  # copies
    rows = [(k, v) for k, v in vectors.items()] + [(900, None), (901, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (902, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0]), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    df = clash(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5))
    got = whitened(whitening.whiten(df))
    n, deviation, values, share = plain_whitening(vectors)
    assert set(got) == set(vectors)
    for k, own in got.items():
        assert sorted(own) == [1, 2, 3, 4] and {r.n for r in own.values()} == {n} and {r.deviation for r in own.values()} == {deviation[k]}
        for c, r in own.items():
            assert abs(abs(r.whitened) - abs(values[k][c - 1])) < 1e-8 and r.explained == pytest.approx(share[c - 1], rel=1e-9) and r.identity_error < 1e-9
    for c in range(1, 5):  # one sign for all rows
        assert len({np.sign(got[k][c].whitened * values[k][c - 1]) for k in got if abs(values[k][c - 1]) > 1e-6}) == 1


def test_whitening_of_little(spark):
    def of(rows, kind="array<double>"):
        return whitened(whitening.whiten(spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}")))

    assert of([]) == {} and of([(1, None)]) == {}
    one = of([(1, [0.5, -0.001]), (2, [0.5, -0.001])])[1]  # nothing varies
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one.values()] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = of([(k, [float(k), 0.0]) for k in range(5)])  # one direction only
    assert line[0][1].explained == 1.0 and line[0][2].whitened is None and line[0][1].identity_error < 1e-12
    far = of([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])  # held at 2^62; squares pass 64 bits
    assert far[1][1].deviation is None and far[3][1].n == 3 and abs(far[1][1].whitened + far[2][1].whitened) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 90), 1 << 90), min_size=1, max_size=8))
def test_remainders_give_numbers_back(values):
    primes = whitening.primes_for(1 << 90)
    assert whitening.remainder_values([[v % p for v in values] for p in primes], primes) == values


def test_scatter_is_exact():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 40), 1 << 40, (20_000, 3))
    n, total = len(x), [int(v) for v in x.astype(object).sum(axis=0)]
    reach = n * (1 << 40) + max(map(abs, total))
    primes = whitening.primes_for(n * reach**2)
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int64()))], ["x"])
    out = next(whitening.residue_scatter(primes, n, total)(iter([batch.slice(0, 9000), batch.slice(9000)])))
    rows = np.array(out.column("g").to_pylist(), object).reshape(len(primes), 9)
    y = x.astype(object) * n - np.array(total, object)
    assert whitening.remainder_values(rows.tolist(), primes) == [int(v) for v in (y.T @ y).reshape(-1)]


# collocations


def plain_phrases(rows, least, longest=5, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, _, cut = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_texts(rng, n):
    vocabulary = ["der", "The", "the", "a", "é", "x\x1cy", "日本", "b", "c", "dd", "e　f", "q"]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.choice([3, 6, 12])]) + rng.choice(["", "", "", ".", ",", "\n", ";!"]) for _ in range(rng.choice([1, 8, 60]))]
        out.append((rng.choice(["en", "en", "de", None]), " ".join(words) if rng.random() > 0.05 else rng.choice([None, "", "  \t", "...", "A\tb  c"])))
    return [*out, ("en", "go " * 3000), ("en", "go " * 3000)]


@pytest.mark.parametrize(("shard_words", "most_sent", "top"), [(1 << 19, 1 << 19, 2000), (7, 1 << 19, 2000), (40, 0, 3)])
def test_phrases_are_those_of_plain_counting(spark, shard_words, most_sent, top):
    rows = some_texts(random.Random(shard_words), 260)
    df = clash(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    got = sorted(map(tuple, collocations.collocations(df, least=12, top=top, shard_words=shard_words, most_sent=most_sent).collect()))
    want = plain_phrases(rows, 12, top=top)
    assert got == want and {r[0] for r in got} == {"en", "de", "und"}


def test_phrases_of_nothing(spark):
    for rows in ([], [("en", None), (None, ""), ("en", ". , .")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0
    one = collocations.collocations(spark.createDataFrame([("en", "a b " * 100)], "lang string, text string"), longest=2).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in one] == [("a b", 100, 100, 100, 200, 2000)]


def test_scores_beyond_64_bits(spark):
    level = spark.createDataFrame([("x", "p q", 4 * 10**15, [5 * 10**15], [6 * 10**15])], "lang string, phrase string, f bigint, pre array<bigint>, suf array<bigint>")
    row = collocations.scored(level, spark.createDataFrame([("x", 10**17)], "lang string, n bigint"), 2).first()
    assert row.score == 1000 * 4 * 10**15 * 10**17 // (30 * 10**30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_bitmaps_shift_and_join(ids):
    a = np.array(ids)
    at = np.flatnonzero(a)
    sizes, block, mask = collocations.bitmaps(a[at] - 1, at, 3)
    maps = (np.repeat(np.arange(3), sizes), block, mask)
    got = Counter()
    for x, y, _, bits in collocations.joined(collocations.shifted(*maps), maps):
        for p, q, m in zip(x, y, bits):
            got[int(p), int(q)] += bin(int(m)).count("1")
    assert got == Counter((x - 1, y - 1) for x, y in zip(ids, ids[1:]) if x and y)


def test_a_task_holds_one_shard(spark, monkeypatch, tmp_path):
    from pathlib import Path

    import pyarrow.parquet as pq

    from ledgerlark.llm.common import Scratch

    def no_lists(*_):
        raise AssertionError("an aggregate of lists holds those of many shards")

    monkeypatch.setattr(collocations.F, "collect_list", no_lists)
    df = spark.createDataFrame([("en", "a b c d e. " * 20), ("en", "b c d " * 30)], "lang string, text string")
    few, many = (sorted(map(tuple, collocations.collocations(df, least=12, shard_words=40, most_sent=n).collect())) for n in (1 << 19, 0))
    assert few == many and len(few) == 5
    wide = spark.range(0, 12, 1, 1).selectExpr("id", "CAST(array_join(transform(sequence(1, 32768), x -> sha2(CAST(id * 100000 + x AS STRING), 512)), '') AS BINARY) AS x")  # 4 MB each, 2 MB packed
    stored = Scratch(spark).put(wide, wide=True)
    at = next(Path(stored._scratch_path.removeprefix("file:")).glob("*.parquet"))
    own = pq.ParquetFile(at).metadata
    assert own.num_rows == 12 and max(own.row_group(k).num_rows for k in range(own.num_row_groups)) <= 3
