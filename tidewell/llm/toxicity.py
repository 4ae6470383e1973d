"""Toxicity by a weighted lexicon (operator 7).

Texts are folded: lower case, look-alike letters of other scripts and
full-width forms to Latin, digits and signs inside words to the letters they
stand for, everything else that is no letter to a blank. An Aho-Corasick
automaton then finds the lexicon's terms, whole words and word beginnings, in
one pass; exception phrases cancel the hits that they cover. The sum of the
weights of the hits, and the length of the text in words, go through a
logistic curve.

The lexicon is learned from labelled rows: words and word beginnings of
`PREFIXES` letters, in at least LEAST_DOCS toxic documents, whose smoothed log
odds of occurring in toxic against other documents are high (counted and
compared in Spark; only terms that speak for toxicity come to the driver); of
two nested terms the longer is kept only if it says more. Two-word phrases
around a term that occur in clean documents only become exceptions. The curve is fitted on the same rows. Fitting uses at most
`most_labels` labelled rows, those with the smallest hashes of their ids (of
toxic rows and others apart); this documented sample is all that is bounded,
every document is scored whole.

Defined cases: a null or empty text has no hits and gets the score of none;
repeated rows get equal scores; without labelled rows of both kinds the
lexicon is empty and all scores are equal and below 0.5; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

PREFIXES = (4, 5, 6, 7)
MOST_LABELS = 16_000
LEAST_DOCS = 4
LEAST_WEIGHT = 3.0
LEAST_CLEAN = 3  # clean documents' uses of an exception phrase
SEED = 104_729

# Letters of other scripts that look like Latin ones, and the
# digits and signs that stand for letters inside words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_LATIN = bytes(i if chr(i).isalpha() else 32 for i in range(256))
_HIDDEN = re.compile(r"[0134578@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![\d.,:])")
_NO_WORD = re.compile(r"[\W\d_]+")
_GLYPHS = str.maketrans(HOMOGLYPHS)
_SIGNS = str.maketrans(SUBSTITUTES)


def fold(text: str) -> str:
    """The folded text: words of letters between single or more blanks, with a
    blank at each end."""
    t = text.lower()
    t = _HIDDEN.sub(lambda m: m.group().translate(_SIGNS), t)
    try:
        return f" {t.encode('latin-1').translate(_LATIN).decode('latin-1')} "
    except UnicodeEncodeError:
        t = unicodedata.normalize("NFKC", "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Mn")))
        return f" {_NO_WORD.sub(' ', t.lower().translate(_GLYPHS))} "


def terms(folded: str) -> set[str]:
    """Whole words as " word ", word beginnings as " word"."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in PREFIXES:
        out.update(" " + w[:n] for w in words if len(w) > n)
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), curve: tuple[float, float, float] = (-2.0, 2.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, tuple(exceptions), curve
        self._machine = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def machine(self):
        if self._machine is None:
            import ahocorasick

            m = ahocorasick.Automaton()
            for t, w in self.weights.items():
                m.add_word(t, (len(t), w))
            for e in self.exceptions:
                m.add_word(e, (len(e), None))
            if len(m):
                m.make_automaton()
            self._machine = m
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of each word hit: its heaviest term, unless an
        exception phrase covers it."""
        if not len(self.machine):
            return []
        best: dict[int, float] = {}
        covered = []
        for end, (n, w) in self.machine.iter(folded):
            start = end - n + 1
            if w is None:
                covered.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        return [(s, w) for s, w in best.items() if not any(a <= s < b for a, b in covered)]

    def features(self, text: str) -> tuple[int, float, int]:
        """(hits, their weight, words)."""
        folded = fold(text)
        found = self.hits(folded)
        return len(found), math.fsum(w for _, w in found), folded.count(" ") - 1 if not found else len(folded.split())

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(weight) - (c * math.log1p(words) if weight else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def sample(labels: DataFrame, most: int, held_out, key: str = "doc_id", label: str = "toxic") -> dict[int, int]:
    """Labelled ids for fitting: half the bound for either label."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out).select(key, label)
    out: dict[int, int] = {}
    for value in (0, 1):
        for r in rows.where(F.col(label) == value).orderBy(F.xxhash64(F.lit(SEED), key), key).limit(most // 2).collect():
            out[r[0]] = max(out.get(r[0], 0), value)
    return out


def learn(df: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out=None) -> Lexicon:
    spark = df.sparkSession
    chosen = sample(labels, most_labels, F.lit(False) if held_out is None else held_out, key, label)
    n = [sum(1 for v in chosen.values() if v == k) for k in (0, 1)]
    if not all(n):
        return Lexicon({})
    ids = spark.createDataFrame(list(chosen.items()), "_id long, _label int")  # most_labels rows at most
    known = df.select(F.col(key).cast("long").alias("_id"), C.text_of(text).alias("_text")).join(F.broadcast(ids), "_id")
    known = C.staged(known.repartition("_id"), "toxicity-sample")

    def count_terms(batches):
        seen: Counter = Counter()
        for batch in C.sliced(batches, "_text"):
            for t in batch.column(0).to_pylist():
                seen.update(terms(fold(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    toxic = known.where("_label = 1").select("_text").mapInArrow(count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= LEAST_DOCS)
    clean = known.where("_label = 0").select("_text").mapInArrow(count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("clean"))
    odds = (F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))).alias("weight")
    counted = toxic.join(clean, "term", "left").select("term", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
    speaks = counted.select("term", "toxic", "clean", odds).where(F.col("weight") >= LEAST_WEIGHT - 1.0)
    speaks = speaks.where(F.col("toxic") / n[1] > 4 * F.col("clean") / n[0])
    weights = select_terms({r.term: r.weight for r in speaks.collect()})  # bounded by the sample
    first = Lexicon(weights)

    def contexts(batches):
        seen: Counter = Counter()
        for batch in C.sliced(batches, "_text"):
            for t, toxic_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = " " + " ".join(fold(t).split()) + " "
                for start, _ in first.hits(folded):
                    end = folded.index(" ", start + 1)
                    before = folded.rfind(" ", 0, start)
                    after = folded.find(" ", end + 1)
                    if before >= 0:
                        seen[folded[before : end + 1], toxic_] += 1
                    if after > 0:
                        seen[folded[start : after + 1], toxic_] += 1
        rows = [(p, k, v) for (p, k), v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["phrase", "label", "n"])

    around = known.select("_text", "_label").mapInArrow(contexts, "phrase string, label int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    exceptions = tuple(sorted(r.phrase for r in around.where("toxic = 0").where(F.col("clean") >= LEAST_CLEAN).select("phrase").collect()))
    lexicon = Lexicon(weights, exceptions)

    def measure(batch: pa.RecordBatch) -> dict:
        found = [lexicon.features(t) for t in batch.column(0).to_pylist()]
        return {"weight": [f[1] for f in found], "words": [f[2] for f in found], "label": batch.column(1)}

    points = C.map_arrow(known.select("_text", "_label"), measure, "weight double, words long, label int", "_text").collect()
    lexicon.curve = fit_curve(points)
    return lexicon


def select_terms(odds: dict[str, float]) -> dict[str, float]:
    """The terms of the lexicon, short ones first: log odds of LEAST_WEIGHT or
    more; a term that begins with a kept one must say clearly more than that."""
    kept: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t.rstrip()), -len(t), t)):
        above = [kept[t[:k]] for k in range(2, len(t)) if t[:k] in kept]
        if odds[t] >= LEAST_WEIGHT and not (above and odds[t] < max(above) + 1.0):
            kept[t] = odds[t]
    return kept


def fit_curve(points) -> tuple[float, float, float]:
    """Ridge logistic regression of the label on log1p(weight) and, where there
    are hits, on log1p(words), both classes weighing the same; Newton steps."""
    y = np.array([p[2] for p in points], float)
    x = np.array([[1.0, math.log1p(p[0]), -math.log1p(p[1]) if p[0] else 0.0] for p in points])
    n1 = max(1.0, y.sum())
    w = np.where(y == 1, 0.5 / n1, 0.5 / max(1.0, len(y) - n1)) * len(y)
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-1]) * len(y) ** 0.5
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1]), max(0.0, float(beta[2]))


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, hits, weight, words, score."""
    types = dict(df.dtypes)

    def one(batch: pa.RecordBatch) -> dict:
        found = [lexicon.features(t) for t in batch.column(len(keep)).to_pylist()]
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"hits": [f[0] for f in found], "weight": [f[1] for f in found], "words": [f[2] for f in found], "score": [lexicon.score(f[1], f[2]) for f in found]}

    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["hits long, weight double, words long, score double"])
    return C.map_arrow(df.select(*keep, C.text_of(text).alias("_text")), one, schema, "_text")


def held_out(key: str = "doc_id"):
    """The fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = learn(docs, labels, held_out=held_out())
    out = score(docs, lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "words")
