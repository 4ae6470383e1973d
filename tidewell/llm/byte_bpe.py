"""Byte-level BPE encoding and decoding (operator 10).

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its
own, starting wherever the chunk starts, so its first pieces may be wrong. The
pattern looks at nothing before a piece, hence two chunks that share one piece
boundary agree on everything after it: the stitch takes the earlier chunk up
to the first common boundary in the overlap and the later chunk from there.
Without a common boundary (a run longer than the overlap) the earlier chunk
is extended until there is one. Then the pieces are encoded, each by itself;
decoding concatenates the raw bytes of the ids.

Texts over `spread` code points (65,536, some ten thousand words) have their chunks dealt out over the cluster
and stitched by document; the others are done where they are read.

Defined cases: a null or empty text has no ids and decodes to no bytes; equal
rows give equal results, repeated doc_ids and null doc_ids keep one row each;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

CACHE = 150_000
CHUNK, OVERLAP = 16_384, 256
SPREAD = 1 << 16
#: White space as the library's regular expressions know it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def boundaries(pattern, text: str, start: int, end: int) -> list[int]:
    """Ends of the pieces of text[start:end], the chunk taken by itself. Ends
    that could move if more text were visible are left out, unless the chunk
    ends with the text."""
    ends = []
    at = start
    for piece in pattern.findall(text[start:end]):
        at += len(piece)
        ends.append(at)
    if end < len(text):
        while ends and ends[-1] + 3 > end:
            ends.pop()
    return ends


def stitch(pattern, text: str, chunks: list[tuple[int, list[int]]], chunk: int = CHUNK) -> list[int]:
    """Piece ends of the whole text from (start, ends) of its chunks."""
    ends = list(chunks[0][1])
    for start, own in chunks[1:]:
        if ends and own and ends[-1] >= own[-1] and start:
            continue
        known = set(ends[bisect_left(ends, start) :])
        at = next((k for k, e in enumerate(own) if e in known), None)
        while at is None:  # no common boundary yet: go on from the last certain one
            begin = ends[-1] if ends else 0
            size = chunk
            more = boundaries(pattern, text, begin, min(len(text), begin + size))
            while not more and begin + size < len(text):
                size *= 2
                more = boundaries(pattern, text, begin, min(len(text), begin + size))
            if not more:
                break
            ends += more
            if not own or ends[-1] >= own[-1]:
                break
            known = set(more)
            at = next((k for k, e in enumerate(own) if e in known), None)
        if at is not None:
            del ends[bisect_left(ends, own[at]) :]
            ends += own[at:]
    return ends


def pieces(pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    if len(text) <= chunk:
        return pattern.findall(text)
    starts = range(0, max(1, len(text) - overlap), chunk - overlap)
    ends = stitch(pattern, text, [(s, boundaries(pattern, text, s, min(len(text), s + chunk))) for s in starts], chunk)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class _Ids(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode(piece))
        if len(self) < CACHE and len(piece) < 64:
            self[piece] = ids
        return ids


class ByteBpe:
    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = compiled(pattern)
        self.ids = _Ids(self.library.encode_ordinary)
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return b"".join(map(self.ids.__getitem__, pieces(self.pattern, text, chunk, overlap)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I")))


_encoders: dict[tuple[str, str], ByteBpe] = {}


def encoder(ranks_file: str, pattern: str) -> ByteBpe:
    key = ranks_file, pattern
    if key not in _encoders:
        _encoders[key] = ByteBpe(*key)
    return _encoders[key]


def encode(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spread: int = SPREAD, decoded: bool = False) -> DataFrame:
    """`keep` and ids: binary, little-endian unsigned 32-bit. With `decoded`
    also the bytes that the ids decode to, made in the same pass."""
    more = "ids binary" + ", decoded binary" * decoded
    rows = df.select(*keep, C.text_of(text).alias("_text"))

    def short(batch: pa.RecordBatch) -> dict:
        e = encoder(ranks_file, pattern)
        ids = [e.encode(t) for t in batch.column(len(keep)).to_pylist()]
        out = {k: batch.column(i) for i, k in enumerate(keep)} | {"ids": ids}
        return out | {"decoded": [e.decode(b) for b in ids]} if decoded else out

    near = C.map_arrow(rows.where(F.length("_text") <= spread), short, _schema(df, keep, more), "_text")
    return near.unionByName(_spread(rows.where(F.length("_text") > spread), ranks_file, pattern, keep, spread, decoded))


def _spread(rows: DataFrame, ranks_file: str, pattern: str, keep, part: int, decoded: bool) -> DataFrame:
    """Very long texts: parts of `part` code points, an overlap and three more
    are dealt out, pre-tokenised and encoded apart, and joined by document.
    A part gives its ids from its first boundary after the overlap on; what
    lies before is the last part's tail. Where two parts share no boundary (a
    run longer than the overlap), the later one is pre-tokenised again from
    the last certain boundary, and nothing else of the text."""
    cuts = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_at", F.explode(F.sequence(F.lit(0), F.length("_text") - 1, F.lit(part))))
    cuts = cuts.select(*keep, "_row", "_at", F.length("_text").alias("_n"), F.expr(f"substring(_text, _at + 1, {part} + {8 * OVERLAP})").alias("_text"))
    cuts = cuts.repartition("_row", "_at")
    schema = _schema(cuts, (*keep, "_row", "_at", "_n"), "ends array<int>, sizes array<int>, ids binary, _text string")

    def pretokenise(batch: pa.RecordBatch) -> dict:
        e = encoder(ranks_file, pattern)
        n = len(keep)
        out = {k: batch.column(i) for i, k in enumerate((*keep, "_row", "_at", "_n"))} | {"_text": batch.column(n + 3)}
        ends, sizes, ids = [], [], []
        for at, total, t in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), batch.column(n + 3).to_pylist()):
            last = at + len(t) >= total
            own = pieces(e.pattern, t)
            coded = list(map(e.ids.__getitem__, own))
            stop, marks = 0, []
            for p in own:
                stop += len(p)
                marks.append(stop)
            while marks and not last and marks[-1] + 3 > len(t):
                marks.pop()
                coded.pop()
            ends.append(marks)
            sizes.append([len(x) for x in coded])
            ids.append(b"".join(coded))
        return out | {"ends": ends, "sizes": sizes, "ids": ids}

    coded = C.map_arrow(cuts, pretokenise, schema, "_text")

    def join(table: pa.Table) -> pa.Table:
        e = encoder(ranks_file, pattern)
        parts = sorted(table.to_pylist(), key=lambda r: r["_at"])
        whole: list[bytes] = []
        done, carry = 0, ""  # code points whose ids are out; text from there to the part
        for p, following in zip(parts, [*parts[1:], None]):
            at, ends = p["_at"], p["ends"]
            if following is not None and not ends and done <= at:  # inside of a run: no boundary yet
                carry += p["_text"][: following["_at"] - at]
                continue
            text = carry + p["_text"]
            start = at - len(carry)
            own = [at + x for x in ends]
            if not carry and (done == at or done in own):
                coded_, pos = [], 0
                for s in p["sizes"]:
                    coded_.append(p["ids"][pos : pos + s])
                    pos += s
                marks, first = own, own.index(done) + 1 if done in own else 0
            else:  # no boundary in common with the part before: again from `done`
                found = pieces(e.pattern, text[done - start :])
                coded_, marks, first, stop = list(map(e.ids.__getitem__, found)), [], 0, done
                for x in found:
                    stop += len(x)
                    marks.append(stop)
                while following is not None and marks and marks[-1] + 3 > start + len(text):
                    marks.pop()
            upto = len(marks)
            if following is not None:
                theirs = {following["_at"] + x for x in following["ends"]}
                upto = next((k + 1 for k in range(first, upto) if marks[k] > following["_at"] and marks[k] in theirs), upto)
            whole += coded_[first:upto]
            done = marks[upto - 1] if upto > first else done
            carry = text[done - start : following["_at"] - start] if following is not None and done < following["_at"] else ""
        row = table.slice(0, 1).select(list(keep))
        ids = b"".join(whole)
        row = row.append_column("ids", pa.array([ids], pa.binary()))
        return row.append_column("decoded", pa.array([e.decode(ids)], pa.binary())) if decoded else row

    return coded.groupBy("_row").applyInArrow(join, _schema(rows, keep, "ids binary" + ", decoded binary" * decoded))


def decode(df: DataFrame, ranks_file: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and decoded: the raw bytes of the ids, concatenated."""

    def one(batch: pa.RecordBatch) -> dict:
        e = encoder(ranks_file, pattern)
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"decoded": [e.decode(b or b"") for b in batch.column(len(keep)).to_pylist()]}

    return C.map_arrow(df.select(*keep, F.col(ids).alias("_ids")), one, _schema(df, keep, "decoded binary"), "_ids")


def _schema(df: DataFrame, keep, more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keep] + [more])


def digests(df: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, decode, and return the contract's digests of both."""
    return encode(df, ranks_file, pattern, text, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
