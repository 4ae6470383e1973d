"""Keywords by an index say what contains says, and cost little more when many."""

import random
import time

from pyspark.sql import functions as F

from tidewell.operators import keywords


def test_against_contains(spark):
    rng = random.Random(7)
    letters = "abcdé ü-"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"a", "ab", "a b", "ab cd", "  ", "x" * 130}
    texts = [None, "", "ABC", "x" * 200, "x" * 129] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "keyword string, rank int")
    for counted in (True, False):
        got = {(r.id, r.keyword) for r in keywords.matches(df, table, counted=counted).collect()}
        assert got == {(i, w) for i, t in enumerate(texts) for w in words if t is not None and w in t.lower()}
    first = {r.id: (r.n, r.keywords) for r in keywords.first_matches(df, table, 3).collect()}
    for i, t in enumerate(texts):
        own = [w for w in sorted(words) if w in (t or "").lower()]
        assert first.get(i, (0, [])) == (len(own), own[:3])
    assert keywords.matches(df.limit(0), table).count() == 0 and keywords.matches(df, table.limit(0)).count() == 0


def test_parts_of_long_words(spark):
    word = "".join(chr(97 + i * i % 26) for i in range(500))
    got = set(spark.range(1).select(F.explode(keywords.parts(F.lit(f"ab {word} é語x")))).toPandas()["col"])
    assert got == {word[i : i + 3] for i in range(498)} | {"é語x"}


def test_many_keywords_cost_little_more(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9)))
    many = [word() for _ in range(10_000)]
    df = spark.createDataFrame([(i, " ".join([word() for _ in range(400)] + [rng.choice(many)])) for i in range(400)], "id long, text string").cache()
    df.count()

    def seconds(n):
        table = spark.createDataFrame([(w,) for w in many[:n]], "keyword string")
        best = []
        for _ in range(3):
            begin = time.perf_counter()
            found = keywords.matches(df, table).count()
            best.append(time.perf_counter() - begin)
        return min(best), found

    (few, _), (lots, found) = seconds(60), seconds(10_000)
    assert found >= 400 and lots < 3 * few + 1
