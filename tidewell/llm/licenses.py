"""License scans by a positional index of rare words (operator 11).

DataFrame functions only. A template is the wording of a notice: its words,
each with its place, and mandatory key phrases among them. A first pass counts
in how many documents each word of the templates stands; the rarer, the more it
weighs (idf). The index holds, for each template, its rarest words with their
places: as many as it takes for the others to weigh less than a match needs, so
that no match stands without one of them. A file's words are looked up there;
every posting proposes a start of its template in the file, and the postings of
a template are intersected by relative position: what counts is the weight of
all template words that stand at their places from that start, give or take
`slack` words for what was put in or left out. A start with enough weight whose
key phrases all stand in their places is a match, and its share of the
template's weight its score.

The base phrases are templates of which all words stand consecutively: no
slack, full weight. Texts are read twice and never shuffled; counts of some 200
words come to the driver.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond
ASCII, counted from 0.

Defined cases: a null or empty text has no words, no labels and score 0, and
its first and last place are null; a template may match in several places, also
over others; equal texts give equal results, repeated rows keep a row each; an
empty table gives an empty table; other columns stay where `keep` names them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Usual wording of public licenses' notices, and the phrases
#: without which a text does not state the license.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "obtaining a copy of this software"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", ["unauthorized copying", "proprietary and confidential"]),
]
#: Share of a notice's weight that a match needs; words that may be put in.
NEED, SLACK = 0.6, 3

#: The one character beyond ASCII whose lower case is a letter of ASCII.
_KELVIN, _OTHER = "K", "ḳ"
_SHIFT, _ROOM = 1 << 40, 1 << 12  # codes of (template, start), starts from -_ROOM


def word_list(text: Column) -> Column:
    """The words of a text. Lower case beyond ASCII moves no word's ends."""
    low = F.lower(F.replace(text, F.lit(_KELVIN), F.lit(_OTHER)))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def templates(base: dict[str, str] = BASE, notices: list = NOTICES, need: float = NEED, slack: int = SLACK) -> list[dict]:
    """Templates as data; phrases must stand in their template's words."""
    out = [{"label": label, "base": True, "words": p.split(), "phrases": [], "need": 1.0, "slack": 0} for p, label in base.items()]
    for label, text, phrases in notices:
        words = text.split()
        places = []
        for p in map(str.split, phrases):
            places.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
        out.append({"label": label, "base": False, "words": words, "phrases": places, "need": need, "slack": slack})
    return out


def document_counts(df: DataFrame, found: list[dict], text: str = "text") -> tuple[int, dict[str, int]]:
    """Documents, and those that have each word of the templates."""
    vocabulary = sorted({w for t in found for w in t["words"]})
    own = F.array_distinct(F.filter(word_list(C.text_of(text)), lambda w: w.isin(vocabulary)))
    rows = df.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word"))  # "" counts the documents
    counts = dict(rows.groupBy("word").agg(F.count("*")).collect())  # a row a word
    return counts.pop("", 0), counts


def weighed(found: list[dict], n: int, counts: dict[str, int]) -> list[dict]:
    """The templates with their words' idf, and those that the index holds."""
    out = []
    for t in found:
        idf = [math.log(1 + (n + 1) / (counts.get(w, 0) + 1)) for w in t["words"]]
        total = sum(idf)
        rarest, rest = [], total
        for i in sorted(range(len(idf)), key=lambda i: (-idf[i], i)):
            if rarest and rest < t["need"] * total * (1 - 1e-9):
                break
            rarest.append(i)
            rest -= idf[i]
        out.append(t | {"idf": idf, "total": total, "rarest": rarest})
    return out


def _sql(value) -> str:
    """A value as a literal of SQL; dicts are structs."""
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(_sql, value)) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value).lower()


def _literals(found: list[dict]) -> tuple[Column, Column, list[str]]:
    """Templates and postings as array literals, and the words to look up. One
    expression each: hundreds of single literals would take long to plan."""
    rows, postings = [], []
    for k, t in enumerate(found):
        words = [{"word": w, "at": i, "idf": x} for i, (w, x) in enumerate(zip(t["words"], t["idf"]))]
        # Templates without phrases of their own have their words as one.
        phrases = [{"at": i, "words": p} for i, p in t["phrases"] or [(0, t["words"])]]
        rows.append({"label": t["label"], "base": t["base"], "words": words, "phrases": phrases, "total": float(t["total"]), "need": float(t["need"]), "slack": t["slack"]})
        postings += [{"word": t["words"][i], "code": k * _SHIFT + _ROOM - i, "slack": t["slack"]} for i in t["rarest"]]
    return F.expr(_sql(rows)), F.expr(_sql(postings)), sorted({p["word"] for p in postings})


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _matches(words: Column, found: list[dict]) -> Column:
    """array<struct<label, base, start, share>> of a file's words."""
    rows, postings, rare = _literals(found)
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare))

    def starts(i: Column) -> Column:
        hits = F.filter(postings, lambda p: p["word"] == F.get(words, i))
        near = lambda p: F.transform(F.sequence(-p["slack"], p["slack"]), lambda d: p["code"] + i + d)
        return F.flatten(F.transform(hits, near))

    # Whole numbers, since only those are made distinct by hashing.
    codes = F.array_distinct(F.flatten(F.transform(places, starts)))

    def stands(w: Column, start: Column, slack: Column) -> Column:
        first = F.greatest(start + w["at"] - slack, F.lit(0))
        length = F.greatest(start + w["at"] + slack - first + 1, F.lit(0))
        return F.array_contains(F.slice(words, first + 1, length), w["word"])

    def complete(p: Column, start: Column, slack: Column) -> Column:
        at = start + p["at"]
        return F.exists(F.sequence(at - slack, at + slack), lambda x: (x >= 0) & (F.slice(words, F.greatest(x, F.lit(0)) + 1, F.size(p["words"])) == p["words"]))

    def match(t: Column, start: Column) -> Column:
        weight = F.aggregate(t["words"], F.lit(0.0), lambda sum_, w: sum_ + F.when(stands(w, start, t["slack"]), w["idf"]).otherwise(0.0))
        enough = lambda share: (share >= t["need"] - 1e-9) & F.forall(t["phrases"], lambda p: complete(p, start, t["slack"]))
        judged = lambda share: F.when(enough(share), F.when(share > 1 - 1e-9, 1.0).otherwise(share))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), start.cast("long").alias("start"), _let(weight / t["total"], judged).alias("share"))

    def judged(code: Column) -> Column:
        start = (code % _SHIFT - _ROOM).cast("int")
        return _let(F.get(rows, F.shiftright(code, 40).cast("int")), lambda t: _let(start, lambda s: match(t, s)))

    return F.filter(F.transform(codes, judged), lambda m: m["share"].isNotNull())


def scan(df: DataFrame, found: list[dict], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words and matches. `found` comes from weighed()."""
    if not found:
        raise ValueError("no templates")
    if max(len(t["words"]) + t["slack"] for t in found) >= _ROOM:
        raise ValueError(f"templates have less than {_ROOM} words")
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    # Through an array of one, so that a text is split once.
    both = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) > 0, _matches(w, found)).otherwise(none).alias("matches"))
    rows = df.select(*keep, F.transform(F.array(word_list(C.text_of(text))), both)[0].alias("_scan"))
    return rows.select(*keep, F.col("_scan.n_words").alias("n_words"), F.col("_scan.matches").alias("matches"))


def licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words and matches with the templates of this module."""
    found = templates()
    return scan(df, weighed(found, *document_counts(df, found, text)), text, keep)


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    rows = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), score.alias("score"))
