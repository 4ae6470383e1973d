"""Exact token counts at every prefix of a text (operator 3).

The model never merges across the start of a run of blanks, so a text is a
sequence of independent segments, each a run of blanks with what follows it.
With c(i) the number of tokens of the first i code points and s the start of
the segment that holds i,

    c(i) = c(s) + tokens(segment[: i - s]),

which is one pass over the segments; the inner counts of a segment depend on
nothing else and are remembered. They come from one dynamic program over the
segment: the encoding of its first i code points ends in the one piece t for
which (last piece of the first i - |t| code points, t) is a pair that the
model keeps apart, since merges are local: a sequence of pieces is an encoding
where each two neighbours are one. The library is asked about pairs only, once
for each; all counts, those of whole texts as well, are cells of these tables.
The table of c at all segment ends, together with the inner counts of one
segment, answers "how many tokens has this prefix" and "how much of the text
fits into a budget" by look-up, without encoding the text again. A segment
costs time in proportion to its length, however long it is.

Defined cases: a null or empty text has no tokens; runs of blanks, control
characters and very long words are segments like any other; equal rows get
equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Segments remembered by a worker; rarer ones are encoded when they come.
CACHE = 1_000_000
#: The blank that the library puts before a text and instead of every space.
BLANK = "▁"
_SEGMENT = re.compile(" +[^ ]*")


class _Inner(dict):
    """Segment without its first blank -> tokens of each of the segment's
    prefixes, as bytes while they fit."""

    def __init__(self, count):
        super().__init__()
        self.count = count
        self.extra: dict = {}

    def learn(self, texts: list[str]) -> None:
        """Count the words of a batch that are new, in order: each goes on
        where it leaves the one before. What finds no room is kept for the
        batch."""
        self.extra = {}
        new: set[str] = set()
        for t in texts:
            new.update(t.split(" "))
        for rest in sorted(w for w in new if w not in self and len(w) < 64):
            if len(self) < CACHE:
                self[rest] = self.packed(rest)
            else:
                self.extra[rest] = self.packed(rest)

    def packed(self, rest: str):
        counts = self.count(" " + rest)
        return bytes(counts) if max(counts) < 256 else tuple(counts)

    def __missing__(self, rest: str):
        known = self.extra.get(rest)
        if known is None:
            known = self.packed(rest) if len(rest) < 64 else self.count(" " + rest)
            if len(rest) < 64 and len(self) < CACHE:
                self[rest] = known
        return known


class PrefixCounter:
    """Counts for one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self._known = _Inner(self._count)
        pieces = [(self.model.id_to_piece(i), i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self._pieces = dict(pieces)
        self._ends = _Ends(self._pieces)
        self._apart: dict[tuple[str, str], bool] = {}
        self._long: tuple[str, list[int]] = ("", [0])
        self._state: tuple[str, list[int], list[str]] = ("", [0], [""])

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(" " + text.replace(BLANK, " ")) if text else []

    def counts(self, text: str) -> list[int]:
        """Tokens of each segment: the last cell of its own table."""
        if not text:
            return []
        plain = text.replace(BLANK, " ") if BLANK in text else text
        known = self._known
        if plain[0] == " " or plain[-1] == " " or "  " in plain:
            return [known[s[1:]][-1] for s in _SEGMENT.findall(" " + plain)]
        return [c[-1] for c in map(known.__getitem__, plain.split(" "))]

    def learn(self, texts: list[str]) -> None:
        self._known.learn([t.replace(BLANK, " ") if BLANK in t else t for t in texts])

    def _kept_apart(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is these two pieces."""
        known = self._apart.get((a, b))
        if known is None:
            known = self._raw(a + b) == [a, b]
            if len(self._apart) < CACHE:
                self._apart[a, b] = known
        return known

    def _raw(self, s: str) -> list[str]:
        """Pieces of s without the blank that the library puts before it; a
        character of bytes counts as a piece."""
        if s[0] == BLANK and len(s) > 1:
            return self._surface(s[1:])
        # A line feed is bytes to the model: nothing merges with it.
        return self._surface("\n" + s)[2:]

    def _surface(self, s: str) -> list[str]:
        out, ids = [], self.model.encode(s, num_threads=1)
        at, whole = 0, BLANK + s.replace(" ", BLANK)
        i = 0
        while i < len(ids):
            if self.model.is_byte(ids[i]):
                n = len(whole[at].encode("utf-8", "surrogatepass"))
                out.append(whole[at])
                at, i = at + 1, i + n
            else:
                piece = self.model.id_to_piece(ids[i])
                out.append(piece)
                at, i = at + len(piece), i + 1
        return out

    def inner(self, segment: str):
        """Tokens of each prefix of a segment."""
        if len(segment) <= 64:
            return self._known[segment[1:]]
        if self._long[0] != segment:
            self._long = segment, self._count(segment)
        return self._long[1]

    def _count(self, segment: str) -> list[int]:
        """The program; it goes on from what the last segment has in common."""
        s = segment.replace(" ", BLANK)
        pieces, apart, ends = self._pieces, self._apart, self._ends
        before, counts, last = self._state
        same = 0
        for a, b in zip(before, s):
            if a != b:
                break
            same += 1
        del counts[same + 1 :], last[same + 1 :]
        for i in range(same + 1, len(s) + 1):
            for n in ends[s[max(0, i - 2) : i]]:  # lengths of pieces that end so
                if n > i:
                    continue
                t = s[i - n : i]
                if t in pieces:
                    if i == n:
                        break
                    known = apart.get((last[i - n], t))
                    if known or known is None and self._kept_apart(last[i - n], t):
                        break
            else:  # bytes, which nothing merges with
                n, t = 1, s[i - 1]
                if t in pieces:
                    raise ValueError("a prefix without an encoding")
            counts.append(counts[i - n] + (1 if t in pieces else len(t.encode("utf-8", "surrogatepass"))))
            last.append(t)
        self._state = s, counts, last
        return counts.copy()

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """(code points, tokens) at the end of each segment."""
        ends = [e - 1 for e in accumulate(map(len, self.segments(text)))]
        return ends, list(accumulate(self.counts(text)))

    def prefix(self, text: str, n_chars: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of the first n_chars code points."""
        ends, totals = table or self.table(text)
        n_chars = max(0, min(n_chars, len(text)))
        k = bisect_right(ends, n_chars)
        if k and ends[k - 1] == n_chars or not n_chars:
            return totals[k - 1] if k and n_chars else 0
        before, start = (totals[k - 1], ends[k - 1]) if k else (0, 0)
        return before + self._segment(text, ends, k)[n_chars - start + (not k)]

    def fits(self, text: str, budget: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Code points of the longest prefix of at most `budget` tokens."""
        ends, totals = table or self.table(text)
        k = bisect_right(totals, budget)
        if k == len(ends):
            return len(text)
        low = ends[k - 1] if k else 0
        before = totals[k - 1] if k else 0
        inner = self._segment(text, ends, k)
        shift = len(inner) - 1 - (ends[k] - low)  # 1 for the first segment's blank
        for n in range(ends[k] - 1, low, -1):
            if before + inner[n - low + shift] <= budget:
                return n
        return low if budget >= 0 else 0

    def _segment(self, text: str, ends: list[int], k: int) -> list[int]:
        """Inner counts of segment k; the first has the library's blank."""
        return self.inner(text[ends[k - 1] : ends[k]] if k else " " + text[: ends[0]])

    def every(self, text: str, table: tuple[list[int], list[int]] | None = None) -> list[int]:
        """Tokens of the first 0, 1, ... code points."""
        ends, totals = table or self.table(text)
        out = [0]
        for k in range(len(ends)):
            before = totals[k - 1] if k else 0
            out += [before + c for c in self._segment(text, ends, k)[1 if k else 2 :]]
        return out


class _Ends(dict):
    """The last two characters (or the only one) -> lengths of the pieces that
    end so, longest first."""

    def __init__(self, pieces):
        super().__init__()
        lengths: dict[str, set[int]] = {}
        for t in pieces:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.one = {t for t in pieces if len(t) == 1}
        for end, own in lengths.items():
            self[end] = tuple(sorted(own | ({1} if end[-1] in self.one else set()), reverse=True))

    def __missing__(self, end: str):
        found = (1,) if end[-1] in self.one else ()
        if len(self) < CACHE:
            self[end] = found
        return found


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def prefix_table(df: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes, n_tokens and the table of exact counts: prefix_chars
    and prefix_tokens hold code points and tokens at each segment's end,
    prefix_counts the tokens of the first 0, 1, ... code points."""
    return _run(df, model_file, text, keep, (), True)


def token_counts(df: DataFrame, model_file: str, budgets: tuple[int, ...] = (4096,), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes, n_tokens and for each budget b `fits_b`: the code
    points of the longest prefix of at most b tokens. One pass, no shuffle."""
    return _run(df, model_file, text, keep, budgets, False)


def _run(df, model_file, text, keep, budgets, whole) -> DataFrame:
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["n_bytes long, n_tokens long"] + [f"fits_{b} long" for b in budgets] + ["prefix_chars array<int>, prefix_tokens array<int>, prefix_counts array<int>"] * whole)

    def one(batch: pa.RecordBatch) -> dict:
        c = counter(model_file)
        out: dict = {k: batch.column(i) for i, k in enumerate(keep)}
        raw = batch.column(len(keep))
        out["n_bytes"] = pc.binary_length(raw)
        texts = raw.to_pylist()
        c.learn(texts)
        totals = [list(accumulate(c.counts(t))) for t in texts]
        out["n_tokens"] = [x[-1] if x else 0 for x in totals]
        ends = [[e - 1 for e in accumulate(map(len, c.segments(t)))] for t in texts] if whole else None
        for b in budgets:
            out[f"fits_{b}"] = [len(t) if not x or x[-1] <= b and max(x) <= b else c.fits(t, b) for t, x in zip(texts, totals)]
        if whole:
            out |= {"prefix_chars": ends, "prefix_tokens": totals, "prefix_counts": [c.every(t, (e, x)) for t, e, x in zip(texts, ends, totals)]}
        return out

    return C.map_arrow(df.select(*keep, C.text_of(text).alias("_text")), one, schema, "_text")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), (4096,))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), F.col("fits_4096").alias("chars_in_limit"))
