import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.llm import lm_scoring, near_dedup, suffix_dedup
from quillstat.llm.graph import components


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(seed=1):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (6, 7, 40, 120, 300, 800)]
    docs = [" ".join(w) for w in base]
    for w in base:
        docs += [" ".join(edited(rng, w, max(0, round(len(w) * s)))) for s in (0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    big = words(rng, 200)
    docs += [" ".join(edited(rng, big, 3)) for _ in range(60)]  # a family without its original
    passage = " ".join(words(rng, 70))
    docs += [" ".join(words(rng, 60)) + " " + passage + " " + " ".join(words(rng, 50)) for _ in range(12)]
    docs += [" ".join(words(rng, 90)) for _ in range(40)]
    docs += ["", " ", "a b", "A  B", "one two three four", "one two three four five", "x " * 5000, "é" * 40 + " ü" * 60]
    return docs


def brute_components(docs):
    def shingles(t):
        w = t.encode().lower().split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = [shingles(t) for t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(len(sets[i]), root(i)) for i in range(len(docs))]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    docs = corpus()
    order = list(range(len(docs)))
    random.Random(3).shuffle(order)  # originals don't come first
    docs = [docs[i] for i in order]
    want = brute_components(docs)
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)], "doc_id long, text string, component_id string")
    for small, block in ((16, 1000), (2, 10)):  # also the completion by blocks
        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r.doc_id: r for r in near_dedup.near_duplicates(df, carry=["text"]).collect()}
        assert [(got[i].n_shingles, got[i].component_id) for i in range(len(docs))] == want
        assert all(got[i].kept == (want[i][1] == i) and got[i].carried_text == docs[i] for i in range(len(docs)))


def test_near_duplicates_edge_cases(spark):
    t = " ".join(f"k{i}" for i in range(30))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (9, None), (9, ""), (None, "z z z z z z")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    same = [r for r in rows if r.n_shingles == 26]
    assert [r.component_id for r in same] == [5, 5, 5] and sorted(r.kept for r in same) == [False, True, True] and sum(r.representative for r in same) == 1
    assert all(r.kept for r in rows if r.n_shingles < 26)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[102] == 100 and got[100] == 100


def test_components_on_top_of_known_ones(spark, monkeypatch):
    from quillstat.llm import graph

    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(7, i) for i in range(1000, 1400)]  # a hub
    of = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {r.node: r.component for r in components(of(links)).collect()}
    for hubs in (10_000, 4):
        monkeypatch.setattr(graph, "HUBS", hubs)
        known = graph.merged(None, of(links[:150]))
        known = graph.merged(known, of(links[150:500]))
        got = {r.node: r.component for r in graph.merged(known, of(links[500:])).collect()}
        assert {k: v for k, v in got.items() if k in want} == want
    assert graph.merged(known, of([])).count() == known.count()


def test_bins_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[300:], rng.integers(0, 2**63, 280).astype(np.uint64)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - j) < 0.08
    few = a[:5]
    assert len(np.unique(near_dedup.signature(few))) <= 5  # filled from full bins only


def brute_removal(rows):
    low = {}
    for i, t in rows:
        b = t.encode()
        for j in range(len(b) - 49):
            s = b[j : j + 50]
            low[s] = min(low.get(s, i), i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if low[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def test_suffix_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = corpus(5)
    texts += ["ab" * 300, "ab" * 200 + "c" * 120, "c" * 121, "x" * 49, "x" * 50, "x" * 51, texts[3][:200], "p" + texts[3][150:260] + "q", "🙂漢" * 40, "é🙂漢" * 40]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_bytes string").selectExpr("*", "1 AS part", "2 AS bucket", "3 AS mask")
    want = brute_removal(rows)
    for part, hot in ((1 << 23, 10**6), (3000, 10**6), (3000, 3)):  # few parts, many, and frequent anchors window by window
        monkeypatch.setattr(suffix_dedup, "PASS_BYTES", min(part, 7000))  # texts in several passes
        got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(df, part_bytes=part, hot=hot).collect())
        assert got == want
    kept = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df, with_text=True).collect()}
    assert all(len(kept[i].encode()) <= len(t.encode()) for i, t in rows)


def test_suffix_dedup_edge_cases(spark):
    t = "0123456789" * 8
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (2, "y" + t), (None, t), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(False, 1, 80, 0), (False, 1, 80, 0), (False, 2, 80, 80), (False, 2, 81, 80), (False, 3, 0, 0), (False, 4, 0, 0), (True, None, 80, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(97, 100, 900).astype(np.uint8), np.zeros(60, np.uint8)])
    wanted = np.zeros(len(text), bool)
    wanted[rng.permutation(900)[:600]] = True
    order, common = suffix_dedup.two_stage_order(text, wanted)
    raw = text.tobytes()
    keys = [raw[i : i + 50] for i in order]
    assert keys == sorted(raw[i : i + 50] for i in np.flatnonzero(wanted))
    lcp = lambda a, b: next((k for k in range(50) if a[k] != b[k]), 50)
    assert common[1:].tolist() == [lcp(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_lm_counts_and_scores(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "river", "House", "of", "stone", "x%d" % rng.randrange(50)]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(200, None), (201, " \n"), (202, "zq" * 3000), (None, "the river"), (3, docs[3][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    got = lm_scoring.lm_scores(df).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in docs if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    natural = [r for r in got if r.held_out and r.n_tokens > 20]
    assert np.mean([r.bits_per_byte for r in natural]) < 2.5  # 8 for a model that knows nothing
    assert lm_scoring.lm_scores(df.limit(0)).count() == 0
    rare = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in lm_scoring.lm_scores(df, common=2).collect())
    assert rare == [(w[0], w[3], w[5]) for w in want]


def lm_tables(key, c):
    return [lm_scoring.Table.of(key, c, o) for o in range(1, lm_scoring.ORDERS + 1)]


def test_lm_probabilities_sum_to_one(spark):
    key = np.sort(lm_scoring.six_grams([line for _, line in lm_scoring.lines(b"aa bb cc " * 9)] * 40)[0])
    key, c = np.unique(key, return_counts=True)
    model = lm_scoring.Mixer.start()
    context = np.uint64(int.from_bytes(b"bb cc", "big")) << np.uint64(8)
    p = 10 ** model.log10(context | np.arange(256, dtype=np.uint64), lm_tables(key, c))
    assert abs(p.sum() - 1) < 1e-4 and p[ord(" ")] > 0.9


def test_lm_counters_keep_their_odds_at_any_size():
    context = int.from_bytes(b"abcde", "big") << 8
    key = np.array([context | 0b01000000, context | 0b11000000, context | 0b11000001], np.uint64)
    for size in (1, 100, 10**7, 10**11):
        c = np.array([6, 30, 30], np.int64) * 10 * size
        n = list(lm_scoring.bit_counts(key, lm_tables(key, c)))
        assert (n[0][:, :, 1] == 600 * size).all() and (n[0][:, :, 0] == 60 * size).all()  # ten to one
        assert (n[7][1] == 300 * size).all() and (n[7][2] == 300 * size).all() and (n[7][0, :, 1] == 0).all()


def test_lm_long_texts_go_in_pieces():
    text = b"  Aa  b\tccc dd " * 50 + b" " * 100 + b"end"
    whole = list(lm_scoring.lines(text))
    cut = list(lm_scoring.lines(text, 40))
    assert len(whole) == 1 and len(cut) > 5
    assert [w for t, _ in cut for w in t] == whole[0][0]
    assert (lm_scoring.six_grams([x for _, x in cut])[0] == lm_scoring.six_grams([whole[0][1]])[0]).all()
    assert list(lm_scoring.lines(b"")) == [([], b"\n" * 6)]


def test_lm_bits_fall_as_the_corpus_grows(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda: " ".join(rng.choices(vocabulary, weights, k=40))
    test = [(i, text()) for i in range(10**6, 10**6 + 200)]
    test = [(i, t) for i, t in test if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [(i, text()) for i in range(1600)]
    got = []
    for n in (50, 300, 1600):
        df = spark.createDataFrame(train[:n] + test, "doc_id long, text string")
        got.append(np.mean([r.bits_per_byte for r in lm_scoring.lm_scores(df).where("doc_id >= 1000000").collect()]))
    assert got[0] > got[1] > got[2] and got[2] < 2.2
    # the same text many times over moves no prediction of a frequent context
    df = spark.createDataFrame(train[:300] * 10 + test, "doc_id long, text string")
    again = np.mean([r.bits_per_byte for r in lm_scoring.lm_scores(df).where("doc_id >= 1000000").collect()])
    assert again < got[1] * 1.1
    # strings that are not broadcast are scored by the join
    monkeypatch.setattr(lm_scoring, "PART_GRAMS", 100_000)
    few = lm_scoring.lm_scores(spark.createDataFrame(train[:50] + test, "doc_id long, text string"), common=5, common_grams=50).where("doc_id >= 1000000").collect()
    assert np.mean([r.bits_per_byte for r in few]) == pytest.approx(got[0], rel=1e-5)
