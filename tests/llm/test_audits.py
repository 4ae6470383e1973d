"""License scans, filter audits and target sampling against plain loops."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import filter_audit, licenses, queries, target_sampling

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# ---------------------------------------------------------------- licenses


def matches(found, w):
    """Every template at every start, without an index."""
    out = []
    for t in found:
        k = t["slack"]
        for s in range(-len(t["words"]) - k, len(w) + k):
            share = sum(x for i, (v, x) in enumerate(zip(t["words"], t["idf"])) if v in w[max(0, s + i - k) : max(0, s + i + k + 1)]) / t["total"]
            if share >= t["need"] - 1e-9 and all(any(x >= 0 and w[x : x + len(p)] == p for x in range(s + o - k, s + o + k + 1)) for o, p in t["phrases"]):
                out.append((t["label"], t["base"], s, round(min(share, 1.0), 9)))
    return sorted(out)


TEXTS = [
    None, "", " \n ", "cc", "CC-BY", "cc by cc by", "x cc\nBY 4.0 y", "Cc K by", "all rights all rights reserved", "GENERAL public licensİ general public license",
    "Released under the MIT License.", "Licensed under the Apache License,\n * Version 2.0 (the License)", "This work is licensed under the GNU General Public License, version 3.",
    "This library is licensed to you by us under the GNU General Public License, at version 2", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "licensed under cc by nc 4 0", "mit einer license", "mit der license of apache version 2 0", "reserved rights all", "é" * 30, "license " * 300, "this is free and unencumbered software released into the wild",
]


def check_licenses(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.templates()
    n, counts = licenses.document_counts(df, found)
    each = [set(words(t)) for t in texts]
    assert n == len(texts)
    assert all(counts.get(w, 0) == sum(w in e for e in each) for t in found for w in t["words"])
    weighed = licenses.weighed(found, n, counts)
    for r in licenses.scan(df, weighed).collect():
        w = words(texts[r.doc_id])
        assert r.n_words == len(w)
        assert sorted((m.label, m.base, m.start, round(m.share, 9)) for m in r.matches) == matches(weighed, w)
    return {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(df, weighed).collect()}


def test_licenses(spark):
    labels = check_licenses(spark, TEXTS)
    at = lambda text: labels[TEXTS.index(text)]
    assert at(TEXTS[10]) == {"mit"} and at(TEXTS[11]) == {"apache-2.0"} and at(TEXTS[12]) == {"gpl", "gpl-3.0"}
    assert at("cc by cc by") == {"cc-by"} and at("mit einer license") == set()
    assert {"cc-by", "cc-by-nc"} <= at("licensed under cc by nc 4 0")


def test_licenses_at_random(spark):
    """Notices with words put in, left out and changed, in noise."""
    rng = random.Random(11)
    notices = [t for _, t, _ in licenses.NOTICES] + list(licenses.BASE)
    texts = []
    for _ in range(60):
        out = []
        for _ in range(rng.randint(0, 3)):
            out += [rng.choice(["the", "of", "license", "cc", "by", "noise", "version", "2"]) for _ in range(rng.randint(0, 12))]
            for w in rng.choice(notices).split():
                out += [w] if rng.random() > 0.08 else rng.choice([[], [w, "extra"], ["other"]])
        texts.append(" ".join(out))
    found = check_licenses(spark, texts)
    assert sum(map(bool, found.values())) > 20


def test_op11(spark):
    got = {r.doc_id: r for r in queries.queries()["op11_license_scan"](spark, DATA).collect()}
    for i, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        w, r = words(text), got[i]
        places = sorted((s, label) for p, label in licenses.BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), *((places[0][0], places[-1][0]) if places else (None, None)))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_native(spark):
    plan = queries.queries()["op11_license_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- filter audit


def test_audit_by_removal(spark):
    """Each order applied to the documents themselves, on random flags."""
    rng = random.Random(12)
    docs = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", "c", None, "d" * 5000]), rng.choice(["en", None, "", "de"]), rng.random() < 0.3, rng.random() < 0.4) for _ in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 4, None]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, p boolean, n boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(df, marks, {"P": F.col("p"), "N": F.col("n")}, repeats="R").collect()}
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    fails = []
    for i, text, lang, p, n in docs:
        again = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, *_ in docs)
        fails.append({c for c, f in (("P", p), ("N", n), ("R", again)) if f})
    parts = {lang or "" for _, _, lang, *_ in docs}
    assert len(got) == len(parts) * 18
    shapley = {}
    for part in parts:
        mine = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in map("".join, itertools.permutations("PNR")):
            left = set(mine)
            for step, c in enumerate(order, 1):
                gone = {k for k in left if c in fails[k]}
                late = {k for k in mine if c in fails[k]} - left
                left -= gone
                r = got[part, order, step]
                assert (r.filter, r.kept, r.removed, r.redundant) == (c, len(left), len(gone), len(late))
                assert r.unique_fails == sum(fails[k] == {c} for k in mine)
                assert (r.good_lost, r.toxic_lost) == (sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone))
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    assert all(r.shapley == shapley[part, r.filter] for (part, _, _), r in got.items())


def test_text_filters(spark):
    texts = ["", "a " * 99, "a " * 100, " ".join(map(str, range(80))) + " x" * 21, "AbCdEfGhIj", "A" + "b" * 9, "Éa" * 5, "no # here", "x y\x0bz"]
    made = filter_audit.text_filters(F.col("text"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *[c.alias(k) for k, c in made.items()]).collect()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        want = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", r.text)) > 10 * len(r.text), bool(re.search(r"[#$%&*|]", r.text)))
        assert (r.A, r.B, r.C, r.D) == want


def test_too_many_filters(spark):
    df = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        filter_audit.audit(df, df.selectExpr("doc_id", "1 quality", "1 toxic"), {c: F.lit(True) for c in "ABCDEFGH"})


# ---------------------------------------------------------------- target sampling


def sampled(docs, target, percent=25, least=20, buckets=10_000):
    """The contract, one document at a time."""

    def features(t):
        w = words(t)
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    own, raw, want = [features(t) for _, t in docs], [0] * buckets, [0] * buckets
    for _, bs in own:
        for b in bs:
            raw[b] += 1
    for t in target:
        for b in features(t)[1]:
            want[b] += 1
    s, t = sum(raw), sum(want)
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, bs) in zip(docs, own):
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    order = lambda r: [(v is None, v or 0) for v in r]
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=order)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=lambda r: [(v is None, v or 0) for v in r])


def test_features():
    rng = random.Random(13)
    alphabet = ["a", "Z", "9", "é", "語", " ", "\n", ".", "_", "\x00", "x" * 47, "y" * 60]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "z" * 5000 + " b", " "]
    bucket, doc, n = target_sampling.features([t.encode() for t in texts])
    for k, t in enumerate(texts):
        w = words(t)
        assert n[k] == len(w)
        assert sorted(bucket[doc == k].tolist()) == sorted(zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def test_target_sampling(spark):
    """Ties at the cut, repeated and missing keys, null, empty and long texts,
    no targets, no documents."""
    rng = random.Random(14)
    some = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Eps"]) for _ in range(rng.choice([0, 5, 19, 20, 21, 40]))) for _ in range(40)]
    docs = [(rng.choice([None, *range(150)]), rng.choice([None, "", *some])) for _ in range(400)] + [(1000 + i, some[0] + " tie" * 30) for i in range(50)] + [(7, "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for target in (["alpha beta alpha", None, ""], []):
        bench = spark.createDataFrame([(t,) for t in target], "text string")
        assert rows_of(target_sampling.resample(df, bench)) == sampled(docs, target)
        assert rows_of(target_sampling.resample(df, bench, percent=100)) == sampled(docs, target, percent=100)
    assert rows_of(target_sampling.resample(df, bench, percent=0)) == sampled(docs, [], percent=0)
    assert target_sampling.resample(df.limit(0), bench).count() == 0


def test_one_score_in_ranges(spark):
    """Rows of one score are numbered range by range of their keys."""
    rows = spark.range(5000).selectExpr("(id * 7919) % 100003 as _id", "10L as n_features", "cast(id % 2 as long) as score")
    got = target_sampling.ranked(rows, [(1, 0), (0, 2500)]).collect()
    want = sorted(((r.score, r._id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.score, r._id) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 5001))
