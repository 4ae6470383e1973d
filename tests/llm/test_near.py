import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import components, fingerprints, jaccard


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def brute(texts, n, num, den):
    sets = [shingles(t, n) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [len(s) for s in sets], classes(range(len(texts)), links)


def corpus(seed, groups, copies, edits, size=(1, 120)):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(*size))]
        for _ in range(rng.choice(copies)):
            t = list(base)
            for _ in range(rng.choice(edits)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, p int")


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_links_equal_brute_force(spark, n, num, den):
    texts = corpus(n, 60, [1, 2, 3, 8], [0, 1, 1, 2, 3, 6]) + [None, "", " ", "one", "One", "two words", "a b c d", "A B C D"] + corpus(9, 2, [60], [0, 1, 2, 3, 4], (60, 90))
    sizes, want = brute(texts, n, num, den)
    got = {r.doc_id: r for r in jaccard.join(rows(spark, texts), n, num, den).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert {i: got[i].component_id for i in got} == want


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(7)
    for num, den in ((85, 100), (80, 100), (1, 2)):
        scheme = jaccard.Scheme(num, den)
        for size in (2, 5, 7, 12, 40, 170, 400):
            for _ in range(12):
                a = rng.integers(1, 1 << 62, size).astype(np.uint64)
                most = int((den - num) / (den + num) * 2 * size)
                drop = int(rng.integers(0, most // 2 + 1))
                b = np.concatenate([a[drop:], rng.integers(1, 1 << 62, max(0, most - drop - int(rng.integers(0, 2)))).astype(np.uint64)])
                both = len(a) - drop
                if den * both < num * (len(a) + len(b) - both) or (len(a) == len(b) and not drop):
                    continue
                a, b = np.sort(a), np.sort(b)
                sig, owner = jaccard.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), scheme)
                assert set(sig[owner == 0]) & set(sig[owner == 1]), (num, den, size, drop)


def test_links_of_blocks():
    rng = random.Random(11)
    texts = corpus(5, 9, [1, 4, 9], [0, 1, 2, 5], (20, 70))
    sets = [np.sort(np.array([hash(x) & (2**63 - 1) for x in shingles(t, 4)], np.uint64)) for t in texts]
    want = np.array([[100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert ((jaccard.linked_pairs(sets, 0, 85, 100) | np.eye(len(sets), dtype=bool)) == want).all()
    half = rng.randrange(1, len(sets))
    assert (jaccard.linked_pairs(sets, half, 85, 100) == want[:half, half:]).all()
    links = [(i, j) for i in range(len(sets)) for j in range(i) if want[i, j]]
    assert classes(range(len(sets)), jaccard.forest(want, 0)) == classes(range(len(sets)), links)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = corpus(21, 3, [70], [0, 1, 2, 3, 5, 8], (60, 90)) + corpus(2, 20, [1, 3], [0, 1])
    _, want = brute(texts, 4, 85, 100)
    assert {r.doc_id: r.component_id for r in jaccard.join(rows(spark, texts), 4, 85, 100).collect()} == want


def test_repeated_and_null_keys(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(5, text), (5, text), (5, "other words here now"), (None, text), (None, None), (2, text + " more"), (9, "")]
    got = jaccard.join(spark.createDataFrame(data, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == [(-1, 0, -1), (-1, 27, 2), (2, 28, 2), (5, 1, 5), (5, 27, 2), (5, 27, 2), (9, 0, 9)]


def test_no_rows(spark):
    assert jaccard.join(rows(spark, ["x"]).limit(0)).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(4)
    nodes = list(range(100))
    rng.shuffle(nodes)
    links = [(nodes[i], nodes[i + 1]) for i in range(60)] + [(nodes[70], nodes[i]) for i in range(71, 90)] + [(3, 3)]
    want = {k: v for k, v in classes(nodes, links).items() if any(k in x for x in links if x[0] != x[1])}
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_of_edited_and_next(spark):
    texts = corpus(3, 30, [1, 2], [0, 1], (1, 90)) + [None, "", "one", "ñandú é " * 3]
    data = [(i * 3, t) for i, t in enumerate(texts)]
    rows_ = fingerprints.with_next(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert len(rows_) == len(texts)
    for r in rows_:
        i = r.doc_id // 3
        following = texts[(i + 1) % len(texts)] or ""
        assert r.next_head == following[: len(texts[i] or "") // 4]


def test_estimates(spark):
    texts = corpus(8, 12, [3], [0, 1, 4], (40, 90))
    df = rows(spark, texts).select("doc_id", fingerprints.sketch(F.col("text"), 64).alias("s"))
    sketches = {r.doc_id: list(r.s) for r in df.collect()}
    pairs = df.alias("a").crossJoin(df.alias("b")).select(
        F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"),
        fingerprints.resemblance(F.col("a.s"), F.col("b.s"), 64).alias("j_"),
        fingerprints.containment(F.col("a.s"), F.col("b.s"), 64).alias("c_"),
        fingerprints.merge(F.col("a.s"), F.col("b.s"), 64).alias("m"),
        fingerprints.distinct_shingles(F.col("a.s"), 64).alias("n"),
    ).collect()
    for r in pairs:
        a, b = shingles(texts[r.i], 5), shingles(texts[r.j], 5)
        assert abs(r.j_ - len(a & b) / len(a | b)) < 0.25
        assert abs(r.c_ - len(a & b) / len(a)) < 0.35
        assert abs(r.n - len(a)) <= max(1, 0.5 * len(a))
        assert list(r.m) == sorted(set(sketches[r.i]) | set(sketches[r.j]))[:64]


def test_empty_repeated_and_null(spark):
    data = [(1, ""), (1, ""), (None, None), (2, "a b c d e f"), (2, "a b c d e f"), (2, "other")]
    got = fingerprints.with_next(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 6 and all(r.next_sketch is not None for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.with_next(empty).count() == 0
    one = fingerprints.with_next(spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")).collect()
    assert one[0].next_head == "a"


def test_copies_in_descending_order_keep_their_pivot(spark, monkeypatch):
    # One task meets A under 10 before 5; B is the pivot and linked to neither.
    a = [f"a{i}" for i in range(40)]
    texts = {10: a, 5: a, 7: [f"b{i}" for i in range(40)], 20: [*a[:39], "z"]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(jaccard, "signature_rows", lambda rows, *_: spark.createDataFrame([(1, 10), (1, 7), (1, 20)], "sig long, _id long"))
    got = {r.doc_id: r.component_id for r in jaccard.join(df, 4, 85, 100).collect()}
    assert got == {10: 5, 5: 5, 7: 7, 20: 5}


def test_shuffled_ids_in_one_task_equal_brute_force(spark):
    texts = corpus(17, 25, [2, 4, 8], [0, 0, 1, 2, 4], (20, 60))
    ids = random.Random(3).sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
    _, want = brute(texts, 4, 85, 100)
    least = {}
    for i, c in want.items():
        least[c] = min(least.get(c, ids[i]), ids[i])
    got = {r.doc_id: r.component_id for r in jaccard.join(df, 4, 85, 100).collect()}
    assert got == {ids[i]: least[c] for i, c in want.items()}
