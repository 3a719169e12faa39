"""Small fixtures for every operator of the training-text subpackage: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns; results against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from ledgerlark.llm import exact_dedup, html_text, language_id, licences, media, mixing, ngram_join, packing, quality, tokens
from ledgerlark.llm.common import Scratch
from ledgerlark.llm.components import connected

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names clash with those that the operators use or return.
CLASHING = {"id": "1", "kept": "true", "rid": "2", "score": "0.5", "length": "3", "slot": "4", "v": "5", "key": "'k'", "sequence_id": "6"}


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in CLASHING.items())) if extra else df


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


ODD = [
    (1, "the same text", "en", "a"), (2, "the same text", "en", "a"), (2, "the same text", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "x", "en", None), (None, "lonely", "fr", "b"), (None, None, None, None),
    (6, "the same text ", "de", "c"), (7, "long " * 40_000, "en", "c"), (8, "long " * 40_000 + "end", "en", "c"), (9, "1234 !!", "en", "c"), (10, "日本 語é \u0000   <|endoftext|>", "de", "a"),
]


# exact dedup


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups(spark, extra):
    got = exact_dedup.exact_groups(frame(spark, ODD, extra)).collect()
    want = brute_exact(ODD)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(ODD)
    for r in got:
        assert (r.keep_id, r.group_size) == by[r.text_sha256]
    for sha, (keep, _) in by.items():
        stay = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(stay) == 1 and stay[0].doc_id == keep


def test_exact_common_prefixes(spark):
    rng = random.Random(1)
    base = words(rng, 4000)
    rows = [(k, base[: rng.choice([0, 63, 64, 65, 512, 4096, len(base)])] + rng.choice(["", "a", "b"]), None, None) for k in range(200)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    want = brute_exact(rows)
    assert got == {i: (*want[t], i == want[t][0]) for i, t, *_ in rows}
    kept = exact_dedup.drop_exact(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, _ in want.values())


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact(frame(spark, [], True)).count() == 0


def test_drop_exact_odd(spark):
    out = exact_dedup.drop_exact(frame(spark, ODD, True))
    assert out.columns == frame(spark, ODD, True).columns
    assert sorted((r.text or "") for r in out.collect()) == sorted({t or "" for _, t, *_ in ODD})


# n-gram Jaccard join


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub(r"\s", " ", (text or "").lower()))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_classes(rows):
    rows = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    up, links = {i: i for i, _ in rows}, dict.fromkeys([i for i, _ in rows], 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        if s and t and len(s & t) >= 0.8 * len(s | t):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (root(i), links[i]) for i, _ in rows}


def near_rows(seed, groups, copies, size):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = words(rng, size).split()
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w), "en", "s"))
    return rows


@pytest.mark.parametrize(("groups", "copies", "node", "block"), [(25, 8, 400, 512), (2, 60, 10, 16)])
def test_jaccard_classes(spark, monkeypatch, groups, copies, node, block):
    monkeypatch.setattr(ngram_join, "NODE", node)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_rows(groups, groups, copies, 120)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_jaccard_odd(spark):
    rows = [r for r in ODD if r[0] not in (2,)] + [(11, "The same, TEXT!", None, None), (12, "one two three four five six", None, None), (13, "one two three four five six", None, None)]
    got = ngram_join.jaccard_classes(frame(spark, rows, True)).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    for r in got:
        assert (r.class_id, r.n_links) == (want[r.doc_id] if r.doc_id is not None else (None, 0))
    assert ngram_join.jaccard_classes(frame(spark, [])).count() == 0
    assert sorted(str(r.doc_id) for r in ngram_join.drop_near(frame(spark, rows, True)).collect()) == sorted(str(i) for i, *_ in rows if i is None or want[i][0] == i)


def test_repeated_rows_are_copies(spark):
    rows = [(1, "one two three four five six", None, None)] * 3 + [(2, "one two three four five six", None, None)]
    got = ngram_join.jaccard_classes(frame(spark, rows)).collect()
    assert [(r.class_id, r.copy_id, r.n_links, r.n_texts) for r in got] == [(1, 1, 3, 0)] * 4


def test_rows_that_share_an_id(spark):
    rng = random.Random(31)
    a, b, c = (words(rng, 200) for _ in range(3))
    rows = [(1, a, None, None), (1, b, None, None), (2, b + " two more", None, None), (3, a + " two more", None, None), (2, c, None, None)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_classes(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 2, 0), (3, 1, 1)]
    assert sorted((r.doc_id, r.text) for r in ngram_join.drop_near(frame(spark, rows, True)).collect()) == sorted([(1, a), (1, b), (2, c)])


def test_links_at_the_threshold_in_large_nodes(spark, monkeypatch):
    """Pairs at 0.80 to 0.82 inside nodes far over NODE, whose documents share most of their text; sizes differ."""
    monkeypatch.setattr(ngram_join, "NODE", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(33)
    passage, rows = words(rng, 60).split(), []
    for k in range(110):
        own = words(rng, 30 + k % 20).split()
        rows.append((2 * k, " ".join(passage + own), "en", "s"))
        rows.append((2 * k + 1, " ".join(passage + own + words(rng, rng.choice([18, 21, 24, 27])).split()), "en", "s"))
    want = brute_classes(rows)
    assert 60 < sum(n > 0 for _, n in want.values()) < 220
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(frame(spark, rows)).collect()} == want


def test_shingles_of_long_texts():
    rng = random.Random(5)
    text = words(rng, 700_000)
    assert len(text) > 2 << 20
    (a,), (b, c) = ngram_join.shingle_sets([text.encode()]), ngram_join.shingle_sets([text[:1000].encode(), text[:1000].encode()])
    assert len(a) == len(shingles(text)) and (b == c).all() and np.isin(b[:-1], a).mean() > 0.98


def test_runs_reach_recall():
    assert (1 - 0.8) ** ngram_join.runs_for(0.8, 0.999) <= 0.001 < (1 - 0.8) ** (ngram_join.runs_for(0.8, 0.999) - 1)


def test_planned_runs_reach_recall_in_split_nodes():
    runs = ngram_join.runs_planned(0.8, ngram_join.RECALL)
    assert (1 - 0.8**ngram_join.LEVELS) ** runs + ngram_join.sketch_miss(0.8, runs * ngram_join.LEVELS) <= 1 - ngram_join.RECALL


def test_pairs_in_a_hot_passage_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "NODE", 1)  # all nodes are split to the last level, as where a passage is very frequent
    seen, hold = [], ngram_join.signature_batches
    monkeypatch.setattr(ngram_join, "signature_batches", lambda n, orders: seen.append(orders) or hold(n, orders))
    rng = random.Random(11)
    passage, rows = words(rng, 26), []
    for k in range(600):  # 22 shingles of the passage in all texts; pairs at a similarity of 0.8 exactly
        own = words(rng, 22)
        rows += [(2 * k, f"{passage} {own}", "en", "s"), (2 * k + 1, f"{passage} {own} {words(rng, 11)}", "en", "s")]
    a, b = (ngram_join.shingle_sets([rows[k][1].encode()])[0] for k in (0, 1))
    assert np.isin(a, b).sum() / len(np.union1d(a, b)) == 0.8
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(frame(spark, rows)).collect()}
    assert got == {k: (k - k % 2, 1) for k in range(len(rows))}
    assert (1 - 0.8**ngram_join.LEVELS) ** (seen[0] / ngram_join.LEVELS) <= 1 - ngram_join.RECALL


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 3)] + [(2000, k) for k in range(2001, 2100)]
    got = {r.v: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    forest = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = forest.get(a, a), forest.get(b, b)
            forest.setdefault(a, a), forest.setdefault(b, b)
            low, high = min(x, y), max(x, y)
            for k, v in forest.items():
                if v == high:
                    forest[k] = low
    assert got == forest


# packing and tokens


def test_supersteps_are_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        cap = rng.choice([10, 50, 2048])
        sizes = [rng.randint(1, rng.choice([cap, max(1, cap // 3)])) for _ in range(rng.randint(1, 150))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        bins = {}
        for length, _, n, each, first, offset in packing.supersteps(counts, cap):
            for i in range(n):
                bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
        for own in bins.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= cap
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((cap if fit is None else fit) - s)
        assert len(gaps) == len(bins)


@pytest.mark.parametrize("rows", [ODD, []])
def test_packing(spark, rows):
    packed = packing.pack_documents(frame(spark, rows, True), digest=False).collect()
    bpe, taken, got = tokens.ByteBpe(), {}, {}
    for r in packed:
        ids = np.frombuffer(r.ids, np.uint32)
        assert len(ids) == r.length <= packing.CAPACITY
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
        got.setdefault(r.doc_id, []).append((r.piece, r.start, ids.tolist()))
    for own in taken.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(own[-1]) <= packing.CAPACITY
    for i, t, *_ in rows:
        if [x[0] for x in rows].count(i) == 1:
            own = sorted(got[i])
            assert [p for p, *_ in own] == list(range(len(own)))
            assert list(itertools.chain(*(x for *_, x in own))) == bpe.plain(t or "") + [0]
            assert all(len(x) == packing.CAPACITY for *_, x in own[1:])
    assert len(packed) == sum(len(range(0, len(bpe.plain(t or "")) + 1, 2048)) for _, t, *_ in rows)


def check_packing(got, sizes, capacity):
    assert sorted(r.doc_id for r in got) == sorted(range(len(sizes)))
    bins = {}
    for r in got:
        assert r.length == sizes[r.doc_id]
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - s)
    return len(gaps)


@pytest.mark.parametrize("make", [lambda r: r.randint(1, 2048), lambda r: r.choice([819, 100, 700, 3, 2048]), lambda r: 100, lambda r: min(2048, int(r.expovariate(1 / 300)) + 1)])
def test_sweeps_over_many_ranges(spark, make):
    rng = random.Random(21)
    sizes = [make(rng) for _ in range(2500)]
    df = spark.createDataFrame([(k, 0, s) for k, s in enumerate(sizes)], "doc_id bigint, piece int, length bigint")
    want = best_fit_decreasing(sizes, 2048)
    assert check_packing(packing.best_fit(df, 2048).collect(), sizes, 2048) == want  # one range
    assert check_packing(packing.best_fit(df, 2048, rows_a_range=400).collect(), sizes, 2048) <= want * 1.01 + 1


def test_ranges_are_matched_by_rank():
    rng = random.Random(22)
    for _ in range(300):
        sizes = sorted(rng.randint(1, 60) for _ in range(rng.randint(1, 40)))
        kinds = [rng.random() < 0.5 for _ in sizes]
        cuts = sorted(rng.sample(range(len(sizes) + 1), min(len(sizes), rng.randint(0, 5))))
        ranges = [list(zip(sizes[a:b], kinds[a:b], strict=True)) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]
        left = []
        for k, own in enumerate(ranges):  # gaps below pieces in every range, as a sweep leaves it
            gaps, pieces = sorted(s for s, g in own if g), sorted((s for s, g in own if not g), reverse=True)
            while gaps and pieces and gaps[-1] >= pieces[-1]:
                gaps.pop(), pieces.pop()
            left.append((gaps, pieces))
        lines = [(k, len(p), max(p, default=0), len(g), min(g, default=0)) for k, (g, p) in enumerate(left)]
        taken, used = set(), {}
        for below, rank, n, above, to, each in packing.match_ranges(lines):
            assert below < above
            for i in range(n):
                assert (below, rank + i) not in taken
                taken.add((below, rank + i))
                used.setdefault((above, to + i // each), []).append(left[below][1][rank + i])
        assert all(sum(own) <= left[k][0][g] for (k, g), own in used.items())
        free = [(k, s) for k, (g, _) in enumerate(left) for i, s in enumerate(g) if (k, i) not in used]
        assert not any(k > j for k, _ in free for j, (_, p) in enumerate(left) for i in range(len(p)) if (j, i) not in taken)


def test_sequences(spark):
    packed = Scratch(spark).put(packing.pack_documents(frame(spark, ODD[:6])))
    out = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in out) == sum(len(r.ids) for r in packed.collect())


def test_best_fit_refuses_odd_lengths(spark):
    with pytest.raises(ValueError):
        packing.best_fit(spark.createDataFrame([(1, 0, 4000)], "doc_id bigint, piece int, length bigint"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'stLL09.!é漢😀　́\x1c\x85ſ")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_those_of_tokenizers(text):
    bpe = test_ids_are_those_of_tokenizers.__dict__.setdefault("bpe", tokens.ByteBpe())
    assert bpe(text).tolist() == bpe.plain(text)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000, "\n" * 50_000 + "x", "é" * 50_000, "<|endoftext|> a<|endoftext|>"])
def test_ids_of_long_runs(text):
    bpe = tokens.ByteBpe()
    assert bpe(text).tolist() == bpe.plain(text)


def test_token_counts(spark):
    rows = [*ODD, (20, "first line\nsecond line\n\nlast", "en", "a"), (21, "\n\n", "en", "a"), (22, "é\nü\n", "en", "a")]
    got = {}
    for r in tokens.count_tokens(frame(spark, rows, True)).collect():
        got.setdefault(r.doc_id, []).append(r)
    bpe = tokens.ByteBpe()
    for i, t, *_ in rows:
        if [x[0] for x in rows].count(i) > 1:
            continue
        own, t = sorted(got[i], key=lambda r: r.section), t or ""
        parts = re.findall(r"[^\n]*\n|[^\n]+", t) or [""]
        assert [t[r.char_start : r.char_end] for r in own] == parts
        ids = bpe(t)
        ends = np.cumsum(bpe.lengths[ids])
        cuts = np.cumsum([len(p.encode()) for p in parts])
        want = np.bincount(np.searchsorted(cuts, ends - bpe.lengths[ids], side="right"), minlength=len(parts))
        assert [r.n_tokens for r in own] == want[: len(parts)].tolist()
    last = tokens.count_tokens(frame(spark, [(1, "a\n\n\nb", "x", "y")]), rule="last").collect()
    assert sum(r.n_tokens for r in last) == len(bpe("a\n\n\nb"))
    two = tokens.count_tokens(frame(spark, [(1, "body text", "en", "title"), (2, None, None, None)]), fields=("source", "text")).collect()
    assert [(r.doc_id, r.field, r.n_tokens > 0) for r in sorted(two, key=lambda r: (r.doc_id, r.field))][:2] == [(1, "source", True), (1, "text", True)]
    assert tokens.count_tokens(frame(spark, [])).count() == 0


# media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=5))
def test_media_round_trip(texts):
    for t, m in zip(texts, media.encode_texts(texts), strict=True):
        images = media.images_of(m)
        assert b"".join(x.tobytes() for x in media.thumbnails(images)) == media.to_payload(t).tobytes()
        for im in images:
            assert (media.luminance_scalar(im) == media.luminance_lanes([im], im.interval)[0]).all()


def test_media_long():
    t = np.random.default_rng(0).integers(0, 256, 1_300_000, dtype=np.uint8).tobytes()
    (m,) = media.encode_texts([t])
    images = media.images_of(m)
    assert len(images) == 3 and b"".join(x.tobytes() for x in media.thumbnails(images)) == media.to_payload(t).tobytes()


def test_media_columns(spark):
    back = media.decode_media(media.encode_media(frame(spark, ODD, True))).selectExpr("doc_id", "thumbnail", "n_bytes", "length(media) n").collect()
    assert len(back) == len(ODD)
    want = sorted((str(i), len((t or "").encode()), media.digest((t or "").encode())) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, (len(r.thumbnail), hashlib.sha256(r.thumbnail).hexdigest(), zlib.crc32(r.thumbnail[-64:]))) for r in back) == want
    assert media.decode_media(media.encode_media(frame(spark, []))).count() == 0


def test_other_baseline_images():
    """A colour image with subsampling and AC coefficients, written bit by bit, and one without restart markers."""
    dc, ac = {0: 2, 1: 2, 2: 2, 5: 3}, {0: 1, 1: 2, 0xF0: 3, 0x11: 4}
    codes, acs = media.canonical(dc), media.canonical(ac)
    bits = ""
    values = [3, -2, 0, 1, -17, 30]  # four luminance blocks, then one of each colour

    def put(code):
        return format(code[0], f"0{code[1]}b")

    before = {0: 0, 1: 0, 2: 0}
    for k, d in enumerate(values):
        part = 0 if k < 4 else k - 3
        before[part] += d
        size = abs(d).bit_length()
        size = size if size in dc else 5
        bits += put(codes[size]) + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
        bits += put(acs[1]) + "1" + put(acs[0x11]) + "0" + put(acs[0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = (
        b"\xff\xd8" + b"\xff\xdb\x00\x43\x00" + bytes([8] * 64) + b"\xff\xc0\x00\x11\x08\x00\x10\x00\x10\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00" + media.dht(0, dc) + media.dht(0x10, ac) + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"
    )
    (im,) = media.images_of(head + scan + b"\xff\xd9")
    assert media.luminance_scalar(im).tolist() == [[3, 1], [1, 2]]
    assert media.thumbnails([im])[0].tolist() == [[131, 129], [129, 130]]
    with pytest.raises(ValueError):
        media.images_of(b"not an image")


# mixing


def brute_edf(plan):
    """Earliest deadline first over all blocks, slot by slot, from windows by exact fractions."""
    done, out = [0] * len(plan.a), []
    for t in range(plan.total):
        open_ = [(math.ceil(plan.slot(s, k + 1)), s) for s, k in enumerate(done) if k < plan.b[s] and math.floor(plan.slot(s, k)) <= t]
        deadline, s = min(open_)
        assert deadline > t
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_schedule_is_pfair():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 9)
        weights = [rng.choice([rng.random() ** 3 + 1e-5, 0.25, Fraction(1, 1000)]) for _ in range(n)]
        plan = mixing.Plan(mixing.whole(weights), [rng.randint(1, 60) for _ in range(n)])
        source, block, done = plan.run(0, plan.total, [0] * n)
        order = list(zip(source.tolist(), block.tolist(), strict=True))
        assert order == brute_edf(plan) and done == plan.b
        seen, total = [0] * n, sum(map(Fraction, weights))
        first_end = min(Fraction(b) * total / Fraction(w) for b, w in zip(plan.b, weights, strict=True))
        for t, (s, _) in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(x - d) < 1 for x, d in zip(seen, plan.due(t), strict=True))
            if t <= first_end:  # until a source ends, what is due is the weight itself
                assert plan.due(t) == [Fraction(w) * t / total for w in weights]


@pytest.mark.parametrize("weights", [[1.0] * 20, [0.65] + [0.35 / 700] * 700, [1e-5, 1 - 1e-5]])
def test_a_later_chunk_holds_the_weights(weights):
    total = sum(map(Fraction, weights))
    plan = mixing.Plan(mixing.whole(weights), [1_000_000_000] * len(weights))
    first, n = 15_000_000 // 16, 20_000
    early = first - 256 - 8 * len(weights)
    done = plan.run(early, first, plan.guess(early))[2]
    source, block, _ = plan.run(first, first + n, done)
    for t, (s, k) in enumerate(zip(source.tolist(), block.tolist(), strict=True), first):
        w = Fraction(weights[s]) / total
        assert k // w <= t < -(-(k + 1) // w)


@pytest.mark.parametrize("before", [0, 50])
def test_chunks_give_the_single_run(spark, before):
    rng = random.Random(17)
    counts = [rng.randint(1, 900) for _ in range(9)]
    weights = [n**0.5 for n in counts]
    key = lambda r: tuple(r)
    one = sorted(map(key, mixing.schedule(spark, counts, weights, 4, 1 << 17).collect()))
    many = sorted(map(key, mixing.schedule(spark, counts, weights, 4, 61, before).collect()))
    assert one == many and len(one) == sum(-(-n // 4) for n in counts)


def test_wrong_guesses_are_scheduled_again(spark):
    counts, weights = [400, 300, 200, 77], [0.4, 0.3, 0.2, 0.1]
    want = sorted(map(tuple, mixing.schedule(spark, counts, weights, 1, 1 << 17).collect()))
    plan = mixing.Plan(mixing.whole(weights), counts)
    hold = mixing.chunk_states(spark, plan, 50, 0)
    wrong = mixing.Plan(plan.a, plan.b)
    wrong.guess = lambda t: [plan.guess(t)[0] - 1, plan.guess(t)[1] + 1, *plan.guess(t)[2:]]
    assert mixing.chunk_states(spark, wrong, 50, 0) == hold
    assert sorted(map(tuple, mixing.schedule(spark, counts, weights, 1, 50, 0).collect())) == want


@pytest.mark.parametrize("rows", [ODD, [], [(k, "t", "en", f"s{min(k % 7, 3)}") for k in range(400)]])
def test_mix(spark, rows):
    out = mixing.mix_sources(frame(spark, rows, True), block=4).collect()
    assert sorted(r.position for r in out) == list(range(len(rows)))
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, *_ in rows)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.slot, set()).add(r.source or "")
    assert all(len(v) == 1 for v in by_slot.values())
    assert [r.slot for r in sorted(out, key=lambda r: r.position)] == sorted(r.slot for r in out)
    if len(rows) == 400:
        counts = {s: sum(r[3] == s for r in rows) for s in sorted({r[3] for r in rows})}
        plan = mixing.Plan(mixing.whole(list(mixing.tempered(counts).values())), [-(-n // 4) for n in counts.values()])
        seen = dict.fromkeys(counts, 0)
        for t, (_, own) in enumerate(sorted(by_slot.items()), 1):
            seen[own.pop()] += 1
            assert all(abs(x - d) < 1 for x, d in zip(seen.values(), plan.due(t), strict=True))


def test_mix_order_keeps_all_columns(spark):
    rows = frame(spark, [(k, f"t{k}", "en", f"s{k % 3}") for k in range(100)]).selectExpr("*", "doc_id + 1000 AS position", "doc_id + 2000 AS slot", "doc_id + 3000 AS block_no", "doc_id + 4000 AS own", "doc_id + 5000 AS src")
    got = mixing.in_mix_order(rows)
    assert got.columns == rows.columns and sorted(got.collect()) == sorted(rows.collect())


@pytest.mark.parametrize(("sources", "each", "hot", "until"), [(20, 250, 250, 4980), (1200, 2, 1500, 2399)])
def test_mix_follows_unrounded_weights(spark, sources, each, hot, until):
    counts = {f"s{k}": hot if k == 0 else each for k in range(sources)}
    weights = dict.fromkeys(counts, Fraction(1, sources)) if hot == each else {s: Fraction(1, 2) if n == hot else Fraction(1, 2 * (sources - 1)) for s, n in counts.items()}
    rows = [(k, None, None, s) for k, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    out = mixing.mix_sources(frame(spark, rows), weights=weights, block=1).select("slot", "source", "block_no").collect()
    assert sorted(r.slot for r in out) == list(range(len(rows)))
    seen = dict.fromkeys(counts, 0)
    for r in sorted(out)[:until]:  # before the first source ends; a block inside its window keeps |placed - due| < 1
        w = weights[r.source]
        assert r.block_no == seen[r.source] and r.block_no // w <= r.slot < -(-(r.block_no + 1) // w)
        seen[r.source] += 1
    assert all(abs(seen[s] - w * until) < 1 for s, w in weights.items())


def test_mix_of_many_sources(spark):
    rows = [(k, None, None, f"s{k}") for k in range(10_500)]
    assert sorted(r.position for r in mixing.mix_sources(frame(spark, rows)).select("position").collect()) == list(range(len(rows)))


def test_mix_refuses_bad_weights(spark):
    with pytest.raises(ValueError):
        mixing.mix_sources(frame(spark, ODD), weights={"a": 0})


# language


def test_gradient():
    net = language_id.BiGru(["a", "b", "c"])
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    data, label = np.random.default_rng(0).integers(97, 123, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, g = net.gradient(data, label)
    for k, w in net.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[at] += 1e-3
        up = net.gradient(data, label)[0]
        w[at] -= 2e-3
        down = net.gradient(data, label)[0]
        w[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def lang_rows():
    rng = random.Random(4)
    make = {"xx": "abcd", "yy": "efgh"}
    return [(k, " ".join("".join(rng.choice(make[lang]) for _ in range(4)) for _ in range(30)), lang, "s") for k in range(120) for lang in [("xx", "yy")[k % 2]]]


def test_language(spark):
    rows = [*lang_rows(), (1000, None, "xx", "s"), (1001, "12 34", "xx", "s"), (None, "abcd abcd abcd", None, "s"), (1002, "", None, None), (1003, "ABCD dcba " * 30_000, None, None)]
    df = frame(spark, rows, True)
    net = language_id.train_on(df.where(~language_id.held_out("doc_id", 4, 2)))
    got = language_id.predict(df, net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, _, lang, _ in rows[:120]:
        assert by[i].lang_pred == lang and by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= by[i].score <= 1
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0)] * 3
    assert by[1003].lang_pred == by[None].lang_pred == "xx" and by[None].held_out
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {1000, 1001, 1002}


def test_language_without_labels(spark):
    df = frame(spark, [(1, "abc", None, None)])
    assert language_id.train_on(df) is None and language_id.train_on(frame(spark, [])) is None
    assert [(r.lang_pred, r.score) for r in language_id.predict(df, None).collect()] == [("und", 0)]
    assert language_id.predict(frame(spark, []), None).count() == 0


def test_letters():
    assert language_id.has_letter("é") and language_id.has_letter("1a") and not language_id.has_letter("1 !") and not language_id.has_letter(None)


# quality


def test_statistics_of_parts():
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 80)).encode() for _ in range(50)] + [b"", b"\n\n", "é!! | ".encode() * 10, b"a" * 3_000_000]
    assert np.allclose(quality.measure(texts), np.concatenate([quality.measure([t]) for t in texts]))
    x = dict(zip(quality.FEATURES, quality.measure([b"Ab ab ab!!\nAb ab ab!!"])[0], strict=True))
    assert x["distinct_words"] == 3 / 6 and x["again_lines"] == 0.5 and x["again_word"] == 0 and x["marked_words"] == 2 / 6 and x["upper_of_letters"] == 2 / 12


def test_trees_match_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.boost(x, y)
    assert ((t.probability(x) >= 0.5) == y).mean() > 0.97
    for row, raw in zip(x[:50], t.raw(x[:50]), strict=True):
        total = t.base
        for k in range(len(t.feature)):
            node = 0
            while t.left[k][node] != node:
                node = t.left[k][node] if row[t.feature[k][node]] <= t.threshold[k][node] else t.right[k][node]
            total += t.value[k][node]
        assert abs(total - raw) < 1e-9


def test_quality(spark):
    rng = random.Random(8)
    rows = [(k, words(rng, 40) if k % 2 else words(rng, 40).upper().replace(" ", "!! "), "en", "s") for k in range(200)] + [(900, None, None, None), (None, "abc", None, None), (901, "abc " * 100_000, None, None)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(1, None, 0), (None, 1, 0), (5000, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_scores(frame(spark, rows, True), labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality.quality_scores(frame(spark, []), labels).count() == 0


# licences


def brute_base(text):
    w, found = licences.words_in(text or ""), []
    for phrase, label in licences.PHRASES:
        q = phrase.split()
        found += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases():
    rng = random.Random(5)
    vocab = ["the", "MIT", "License", "apache", "license", "general", "public", "licensed", "under", "É", "x", "2.0", "mit", "K"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    auto = licences.Automaton()
    for t, g in zip(texts, licences.scan_texts(auto, [t.encode().lower() for t in texts]), strict=True):
        assert g[:5] == brute_base(t)
    long = "word " * 500_000 + "the MIT License"
    assert licences.scan_texts(auto, [long.encode().lower()])[0][:5] == brute_base(long)


def test_matching_statistics():
    rng, auto = random.Random(7), licences.Automaton()
    subs = {tuple(w[i:j]) for _, w, _ in auto.items for i in range(len(w)) for j in range(i + 1, min(len(w), i + 14) + 1)}
    for _ in range(200):
        a, b = rng.choice(auto.items)[1], rng.choice(auto.items)[1]
        i = rng.randrange(len(a))
        seq = a[i : i + rng.randint(1, 8)] + [rng.choice(list(auto.number))] + b[:4]
        for k, (_, n) in enumerate(auto.stream([auto.number[x] for x in seq])):
            want = 0
            while want <= k and tuple(seq[k - want : k + 1]) in subs:
                want += 1
            assert n == want


def brute_cover(own):
    """The most words of a template that any row of its matches covers, by trying all rows."""
    best = 0

    def go(row, covered):
        nonlocal best
        best = max(best, covered)
        for at, place, n in own:
            if not row:
                go([(at, place, n)], n)
                continue
            a, p, m = row[-1]
            fresh = n - max(0, a + m - at, p + m - place)
            if (at, place, n) > (a, p, m) and fresh > 0 and place + n > p + m and at <= a + m + licences.MOST_GAP:
                go([*row, (at, place, n)], covered + fresh)

    go([], 0)
    return best


def test_chains_cover_the_most():
    rng, auto = random.Random(11), licences.Automaton((("x", " ".join(f"w{k}" for k in range(40))),), ())
    for _ in range(300):
        own = sorted({(rng.randrange(60), (p := rng.randrange(36)), rng.randint(1, 40 - p)) for _ in range(rng.randint(1, 8))})
        spans = auto.chain([(0, *m) for m in own])
        want = brute_cover(own) / 40
        assert (max(s[3] for s in spans) == want) if want >= licences.LEAST_SHARE else not spans
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("every", [7, 8, 9])
def test_changed_notices_keep_their_labels(every):
    auto = licences.automaton()
    for label, text in licences.TEMPLATES:
        own = text.split()
        if len(own) < 30:
            continue
        changed = " ".join("zzz" if k % every == every - 1 else w for k, w in enumerate(own))
        assert label in licences.scan_texts(auto, [f"before {changed} after".lower().encode()])[0][5].split(",")


def test_whole_bodies_and_copies():
    auto = licences.automaton()
    for label, body in licences.bodies():
        (row,) = licences.scan_texts(auto, [("intro words " + body + " end").lower().encode()])
        assert label in row[5].split(",") and row[6] == 1.0
    notice = licences.TEMPLATES[0][1]
    (row,) = licences.scan_texts(auto, [" ".join([notice] * 3).lower().encode()])
    assert len([x for x in row[7] if x["template"] == 0]) == 3


def test_equal_hashes_of_other_words_count_for_nothing(monkeypatch):
    hold = licences.span_hashes

    def collide(buf, lo, hi):
        out = hold(buf, lo, hi)
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            if buf[a:b].tobytes() == b"xyz":
                out[k] = hold(np.frombuffer(b"mit", np.uint8), np.array([0]), np.array([3]))[0]
        return out

    monkeypatch.setattr(licences, "span_hashes", collide)
    rows = licences.scan_texts(licences.automaton(), [b"the xyz license", b"the mit license and the xyz license", b"under the terms of the xyz license mit license"])
    assert [r[:5] for r in rows] == [brute_base(t) for t in ("the xyz license", "the mit license and the xyz license", "under the terms of the xyz license mit license")]


def test_spans(spark):
    rows = [(1, "Intro. " + licences.TEMPLATES[0][1] + " Outro.", None, None), (2, "Licensed under CC BY-NC 4.0.", None, None), *ODD[2:]]
    got = {r.doc_id: r for r in licences.licence_scan(frame(spark, rows, True)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score == 1.0 and got[1].spans[0].first_word == 1
    assert got[2].labels == "cc-by-nc" or (got[2].n_base, got[2].labels) == (0, "")
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert licences.licence_scan(frame(spark, [])).count() == 0


# pages


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p>a", "a"), ("plain &amp; more", "plain & more"), ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;x</p>", "a <b> &amp; é x"),
    ("<div id=content><h1>T</h1><p>Hello, world, this is the main paragraph of the page.<p>Second one, also long enough.</div><div class='comments'><p>nice, post, I like it, very much, indeed</p></div>", "T\n\nHello, world, this is the main paragraph of the page.\n\nSecond one, also long enough."),
    ("<nav><p>menu, menu, menu, and more of it</p></nav><article><h1>T</h1><p>x <b>y</b><br>z<p>w</article><footer>f</footer>", "T\n\nx y z\n\nw"),
    ("<article><p>x</p><form><p>sign up</p></form><aside>s</aside><div class=cookie-notice>c</div><blockquote><p>q</p></blockquote><table><tr><td>1<td>2</table></article>", "x\n\nq\n\n1\n\n2"),
    ("<script>var t='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"), ("<p>cut &am", "cut &am"), ("<p title='a>b'>q</p>", "q"), ("<div class='wrap has-sidebar sidebar-left'><article><p>in</p></article></div>", "in"), ("<div class='page-header'><p>all there is</p></div>", "all there is"), ("<article><p>story</p></article><section id='comments'><article class='comment'><p>nice, very nice, good, great</p></article></section>", "story"),
    ("<div class='adslot'>buy</div><div id='content'><p>Text, with, commas.</p><div class='AdBox'>buy</div><p>More.</p></div><div class='user-comments'><p>a, b, c, d, e, f, g</p></div><div class='siteFooter'>f</div>", "Text, with, commas.\n\nMore."), ("<b><p>x</b>y</p>z", "xy\n\nz"),
])
def test_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("page", ['<article class="post comments-open">{}</article><p>Short, end.</p>', '<div id="content" class="has-ads">{}</div>', '<div class="entry related-1"><article>{}</article></div><p>Short, end.</p>', '<article>{}</article><div id="comments"><article class="comment"><p>First, nice one, I say, and more, and more.</p></article></div>'])
def test_pages_with_firm_words(page):
    body = "This is the text of the article, long enough to count, with commas, and so on."
    assert html_text.main_text(f"<html><body>{page.format(f'<p>{body}</p>')}</body></html>") == body


def test_pages_table(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, None), (2, None, "<div>" * 2000 + "<p>deep</p>", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extract_text(df).collect())
    assert got == [("1", "u", "a", 1), ("1", "u", "a", 1), ("2", "None", "deep", 4), ("None", "None", "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ap\"'=! divstyle-&;", max_size=80))
def test_any_page(html):
    html_text.main_text(html)


# the pipeline


def test_pipeline_stages(spark):
    rows = [*lang_rows(), (500, lang_rows()[0][1], "xx", "s"), (501, lang_rows()[1][1] + " efgh", "yy", "t"), (502, None, None, None), (503, "12", None, None)]
    docs = frame(spark, rows)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark).put(stage(spark, kept[-1], ""))
        assert out.columns == docs.columns
        kept.append(out)
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    assert ids[0] - ids[1] == {502, 503} and ids[1] - ids[2] == {0} and ids[2] - ids[3] == {501} and ids[3] == ids[4]
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], "").collect()
    assert {r.doc_id for r in last} == ids[4]
    order = [r.doc_id for r in kept[-1].orderBy("source").collect()]
    assert sorted(order) == sorted(ids[4])


def test_pipeline_packs_in_the_order_of_the_mix(spark):
    rng = random.Random(13)
    rows = [(k, words(rng, rng.choice([40, 40, 300, 900])), "en", "hot" if k < 500 else f"s{k % 5}") for k in range(800)]
    docs = Scratch(spark).put(frame(spark, rows))
    mixed = Scratch(spark).put(corpus_pipeline.mixing(spark, docs, ""))
    packed = {}
    for name, stored in (("mixed", mixed), ("plain", docs)):
        got = corpus_pipeline.packing(spark, stored, "").collect()
        assert {r.doc_id for r in got} == {k for k, *_ in rows}
        packed[name] = got
    assert set(packed["mixed"]) != set(packed["plain"])
    at = {r.doc_id: r.position for r in mixing.mix_sources(docs).select("doc_id", "position").collect()}
    firsts = {name: {} for name in packed}
    for name, own in firsts.items():
        for r in packed[name]:
            own[r.sequence_id] = min(own.get(r.sequence_id, len(rows)), at[r.doc_id])
        assert sorted(own) == list(range(len(own)))
    ranked = {name: [own[k] for k in sorted(own)] for name, own in firsts.items()}
    assert ranked["mixed"] == sorted(ranked["mixed"]) and ranked["plain"] != sorted(ranked["plain"])


def test_packing_in_order_keeps_all_pieces(spark):
    stored = Scratch(spark).put(frame(spark, ODD, True))
    got = packing.pack_in_order(stored).collect()
    want = packing.pack_documents(stored, digest=True).collect()
    key = lambda r: str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and {r.sequence_id for r in got} == set(range(len({r.sequence_id for r in want})))
    assert packing.pack_in_order(Scratch(spark).put(frame(spark, []))).count() == 0


# held-out accuracy on the given tables, and twins of what the queries do


SF = "/root/testdata/sf0.01"


def test_language_on_documents(spark):
    got = {r.doc_id: r for r in language_id.op5_language_id(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in rows}
    judged = [got[r.doc_id].lang_pred == r.lang for r in rows if r.lang is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and any(c.isalpha() for c in r.text)]
    assert len(judged) > 150 and sum(judged) / len(judged) > 0.97
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"


def test_quality_on_documents(spark):
    got = {r.doc_id: r for r in quality.op6_quality_classifier(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None]
    judged = [got[r.doc_id].predicted == r.quality for r in labels if got[r.doc_id].held_out]
    assert len(judged) > 80 and sum(judged) / len(judged) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def brute_positions(net, data):
    """A document's probabilities by one scalar step a byte, window by window."""
    h, w = language_id.HIDDEN, net.w

    def states(part, d):
        out, s = [], np.zeros(h)
        for x in part:
            g = w["x"][d][:, x].astype(float)
            m = w["u"][d].astype(float) @ s
            z, r = (1 / (1 + np.exp(-2 * (g[k : k + h] + m[k : k + h]))) for k in (0, h))
            n = np.tanh((m[2 * h :] + w["b"][d][:, 0]) * r + g[2 * h :])
            s = z * s + (1 - z) * n
            out.append(s)
        return out

    total, count = np.zeros(len(net.labels)), 0
    for at in range(0, len(data), language_id.WINDOW):
        lo = at - language_id.AROUND
        part = [data[k] if 0 <= k < len(data) else 0 for k in range(lo, lo + language_id.READS)]
        f, b = states(part, 0), states(part[::-1], 1)[::-1]
        for k in range(language_id.AROUND, language_id.AROUND + language_id.WINDOW):
            if language_id.LETTER[part[k]]:
                logits = w["v"].astype(float) @ np.concatenate([f[k], b[k]]) + w["c"][:, 0]
                p = np.exp(logits - logits.max())
                total, count = total + p / p.sum(), count + 1
    return total / max(count, 1)


def test_documents_are_read_in_overlapping_windows():
    rng, net = random.Random(41), language_id.BiGru(["a", "b", "c"])
    texts = ["", "x", "é" * 32, words(rng, 9), words(rng, 60) + " é日本", "1 2", "a" * 64, "b" * 65]
    got = net.documents([language_id.to_bytes(t) for t in texts])
    for t, p in zip(texts, got, strict=True):
        assert np.allclose(p, brute_positions(net, language_id.to_bytes(t)), atol=1e-5)


def test_language_stage_without_labels_keeps_letters(spark):
    df = frame(spark, [(1, "abc", None, None), (2, "12", None, None), (3, None, None, None), (4, "é", None, None)], True)
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 4}


def test_much_repeated_rows_are_drawn_once(spark):
    rows = lang_rows() + [(7, lang_rows()[7][1], "yy", "s")] * 500
    assert language_id.train_on(frame(spark, rows)).labels == ["xx", "yy"]


def brute_sections(text, rule):
    """Tokens of every line, token by token, character by character."""
    bpe = tokens.ByteBpe()
    data = (text or "").encode()
    line_of, line = [], 0
    for byte in data:
        line_of.append(line)
        line += byte == 10
    n = max(1, (line_of[-1] if line_of else 0) + 1)
    own, shared, at = [0] * n, [0] * n, 0
    for t in bpe(text or "").tolist():
        size = int(bpe.lengths[t])
        a, b = line_of[at], line_of[at + size - 1]
        own[a if rule == "first" else b] += 1
        shared[a] += a != b
        at += size
    return list(zip(own, shared, strict=True))


@pytest.mark.parametrize("rule", ["first", "last"])
def test_tokens_of_lines_one_by_one(spark, rule):
    rng = random.Random(43)
    texts = ["a\n\n\nb", "\n\n\n", "", None, "x \n y\n\n  z", " \n \n \n"] + ["".join(rng.choice("ab \n\n\té") for _ in range(60)) for _ in range(40)]
    got = {}
    for r in tokens.count_tokens(frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]), rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.n_shared))
    for k, t in enumerate(texts):
        assert [x[1:] for x in sorted(got[k])] == brute_sections(t, rule)


def test_long_blanks_need_no_rescue():
    bpe = tokens.ByteBpe()
    text = "a" + " " * 1_000_000 + "b"
    assert bpe(text).tolist() == bpe.plain(text)


def test_scores_are_those_of_a_scalar_walk(spark, monkeypatch):
    rng, held = random.Random(45), []
    learn = quality.learn
    monkeypatch.setattr(quality, "learn", lambda *a: held.append(learn(*a)) or held[-1])
    rows = [(k, words(rng, rng.randint(5, 60)) if k % 2 else words(rng, 30).upper().replace(" ", "!! "), "en", "s") for k in range(160)] + [(900, None, None, None), (901, "", None, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(frame(spark, rows), labels).collect()}
    trees = held[0][0]
    for i, text, *_ in rows:
        x = quality.measure([(text or "").encode()])[0]
        total = trees.base
        for k in range(len(trees.feature)):
            node = 0
            while trees.left[k][node] != node:
                node = trees.left[k][node] if x[trees.feature[k][node]] <= trees.threshold[k][node] else trees.right[k][node]
            total += trees.value[k][node]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-5


# the whole pipeline against plain versions of its stages


def check_run(spark, rows, path, extra=False):
    """run() over documents with these rows: every stage by a plain version, from what the language stage kept on."""
    docs = frame(spark, rows, extra)
    docs.write.parquet(f"{path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(path)).collect()
    spoken = [(r.doc_id, r.text) for r in language_id.keep_identified(spark.read.parquet(f"{path}/documents.parquet")).collect()]
    assert all(t and any(c.isalpha() for c in t) for _, t in spoken)
    best = {}
    for i, t in spoken:
        if t not in best or (-1 if i is None else i) > (-1 if best[t] is None else best[t]):
            best[t] = i
    left = [(i, t) for t, i in best.items()]
    classes = brute_classes(left)
    kept = [(i, t) for i, t in left if i is None or classes[i][0] == i]
    bpe, places = tokens.ByteBpe(), {}
    want = sorted((str(i), zlib.crc32(np.array([*bpe.plain(t), 0], np.uint32)[:k].tobytes()), k) for i, t in kept for n in [len(bpe.plain(t)) + 1] for k in [n % 2048 or 2048])
    assert sorted((str(r.doc_id), r.ids_crc32, r.length) for r in packed if r.piece == 0) == want
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(places) == set(range(len(places)))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    return packed


def test_pipeline_against_plain_versions(spark, tmp_path):
    rng = random.Random(47)
    base = [words(rng, 40) for _ in range(12)]
    rows = lang_rows() + [(1000 + k, base[k % 12] + (" tail" if k % 3 else ""), "zz", rng.choice(["s", "t", None])) for k in range(48)]
    rows += [(None, base[0] + " some more of it, alone", "zz", None), (None, None, None, None), (2000, "", "xx", "s"), (2001, "12 34", "xx", "s"), (2002, words(rng, 3000), "zz", "t"), (2002, words(rng, 3000), "zz", "t"), rows[0], rows[0]]
    assert len(check_run(spark, rows, tmp_path, extra=True)) > 100


def test_pipeline_of_nothing(spark, tmp_path):
    assert check_run(spark, [], tmp_path) == []
