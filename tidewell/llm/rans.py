"""Token-ID output coded by a static range asymmetric numeral system
(operator 4).

One frequency table, counted over all documents, is shared by all files. A
file holds independent blocks of whole documents in ascending doc_id order. In
a block the ids are dealt over many interleaved lanes, each with its own coder
state, so that one step codes an id of every lane at once. Each block carries
its size, a checksum of its bytes and one of its ids, and inside the block
checkpoints (all lane states and the position in the words) from which a
reader can start. Blocks are the unit of parallel decoding: a reader needs the
table and one block.

Steps: (1) tokenise where the rows are and stage the ids, 16 bits each where
the vocabulary allows, with each task's counts of them; (2) sum the counts; (3) range-partition the ids by doc_id, sort,
code and write the files, staging one index row per block; (4) decode block by
block. Nothing but the table (bounded by the vocabulary) and the totals of the
files (one number each) comes to the driver.

Defined cases: a null or empty text has the end id only; null doc_ids come
first; rows with equal doc_ids keep one output row each, ordered by a hash of their ids;
an empty table writes no block and gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from ._words import split

SCALE_BITS = 20
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
MAGIC = b"TWRANS01"
BLOCK_IDS = 1 << 20
LANES = 4096
LANE_IDS = 64  # ids a lane has at least before there are more lanes
CHECKPOINT_STEPS = 128
CACHE = 800_000
_HEAD = struct.Struct("<8sIIIIII")  # magic, table, ids, lanes, words, checkpoints, crc of the ids


# ---------------------------------------------------------------- the coder


class Table:
    """Frequencies that sum to 2**SCALE_BITS; every id that occurs has one."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        if len(frequencies) and self.frequencies.sum() != 1 << SCALE_BITS:
            raise ValueError("frequencies must sum to the scale")
        self.starts = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint64) if len(frequencies) else self.frequencies
        self.id = zlib.crc32(frequencies.astype("<u4").tobytes())
        self._symbols = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "Table":
        scale = 1 << SCALE_BITS
        used = counts > 0
        if used.sum() > scale:
            raise ValueError("more symbols than the scale holds")
        f = np.where(used, np.maximum(1, np.floor(counts / max(1, counts.sum()) * scale)), 0).astype(np.int64)
        if not used.any():
            f = np.zeros(1, np.int64)
            f[0] = scale
            return cls(f)
        over = int(f.sum()) - scale
        order = np.argsort(-f, kind="stable")
        k = 0
        while over > 0:  # take from the frequent, never below one
            i = order[k % len(order)]
            take = min(over, max(0, int(f[i]) // 2))
            f[i] -= take
            over -= take
            k += 1
        f[order[0]] -= over
        return cls(f)

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies.astype(np.int64))
        return self._symbols

    def to_bytes(self) -> bytes:
        return self.frequencies.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Table":
        return cls(np.frombuffer(data, "<u4").astype(np.int64))


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // LANE_IDS))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    k = lanes_for(n)
    steps = -(-n // k)
    x = np.full(k, LOW, np.uint64)
    f, c = table.frequencies[ids], table.starts[ids]
    if n and not f.all():
        raise ValueError("an id that the table does not know")
    words, points = [], []
    limit, scale, half = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        if (t + 1) % CHECKPOINT_STEPS == 0 and t + 1 < steps:
            points.append((t + 1, len(words), x.copy()))
        ft, ct = f[t * k : (t + 1) * k], c[t * k : (t + 1) * k]
        y = x[: len(ft)]
        spill = y >= (ft << limit)
        words.append((y[spill] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        y = np.where(spill, y >> half, y)
        q = y // ft
        x[: len(ft)] = (q << scale) + (y - q * ft) + ct
    words.reverse()
    sizes = np.cumsum([0] + [len(w) for w in words])
    body = [x.astype("<u8").tobytes()]
    for t, seen, states in reversed(points):  # (step, words before it, states)
        body.append(struct.pack("<II", t, int(sizes[len(words) - seen])) + states.astype("<u8").tobytes())
    body += [w.tobytes() for w in words]
    data = _HEAD.pack(MAGIC, table.id, n, k, int(sizes[-1]), len(points), zlib.crc32(ids.astype("<u4").tobytes())) + b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


def decode_block(data: bytes, table: Table, start: int = 0, end: int | None = None) -> np.ndarray:
    """The ids of a block, or those of `start`:`end`, from the nearest
    checkpoint before `start` on."""
    magic, name, n, k, n_words, n_points, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block")
    if name != table.id:
        raise ValueError("coded with another table")
    end = n if end is None else min(end, n)
    at = _HEAD.size
    x = np.frombuffer(data, "<u8", k, at).astype(np.uint64)
    at += 8 * k
    step = position = 0
    for _ in range(n_points):
        t, before = struct.unpack_from("<II", data, at)
        if t * k <= start:
            step, position, x = t, before, np.frombuffer(data, "<u8", k, at + 8).astype(np.uint64)
        at += 8 + 8 * k
    words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)
    first, last = step, -(-end // k)
    out = np.empty(max(0, last - first) * k, np.uint32)
    mask, scale, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    symbols, frequencies, starts = table.symbols, table.frequencies, table.starts
    for t in range(first, last):
        m = min(k, n - t * k)
        y = x[:m]
        slot = y & mask
        s = symbols[slot]
        out[(t - first) * k : (t - first) * k + m] = s
        y = frequencies[s] * (y >> scale) + slot - starts[s]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << half) | words[position : position + len(low)]
        position += len(low)
        x[:m] = y
    if start == 0 and end == n:
        ids = out[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc or (x != LOW).any() or position != n_words:
            raise ValueError("damaged ids")
        return ids
    return out[start - first * k : end - first * k]


# ------------------------------------------------------------ tokenisation


#: Fixed value: the pre-tokeniser whose letters end where other signs begin.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII that begins another pre-token after a letter (an apostrophe may not).
_SIGN = ~_LETTER & (np.arange(256) < 128) & (np.arange(256) > 32) & (np.arange(256) != 39)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordIds(dict):
    """Runs of non-blanks -> their ids. The library drops white space, so the
    ids of a text are those of its runs; where its pre-tokeniser keeps letters
    apart, runs are cut after a letter before another ASCII sign, and runs of
    ASCII are lower-cased as its normaliser does (nothing combines across such
    a cut). A batch's runs are dictionary-encoded as a column, each distinct
    one is looked up once, and the ids are gathered by array operations."""

    def __init__(self, tokenizer_file: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        parts = json.loads(self.library.to_str())
        first = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.added = [t["content"].encode() for t in parts.get("added_tokens", [])]
        self.apart = first.get("pattern") == {"Regex": LETTERS_APART}
        self.lower = self.apart and [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def specials(self, plain: np.ndarray) -> list[int]:
        """Where the strings of added tokens begin."""
        data, out = plain.tobytes(), []
        for s in self.added:
            at = data.find(s)
            while at >= 0:
                out.append(at)
                at = data.find(s, at + 1)
        return out

    def of_runs(self, runs: list[bytes]) -> list[bytes]:
        """The ids of distinct runs, as bytes."""
        wanted = [r for r in runs if r not in self]
        extra = {}
        if wanted:
            coded = self.library.encode_batch_fast([r.decode() for r in wanted], add_special_tokens=False)
            extra = {r: np.array(e.ids, self.type).tobytes() for r, e in zip(wanted, coded)}
            room = CACHE - len(self)
            if room > 0:
                self.update((r, ids) for r, ids in list(extra.items())[:room] if len(r) < 48)
        get = self.get
        return [get(r) or extra.get(r, b"") for r in runs]

    def encode_all(self, texts: list[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of each text's)."""
        w = split(texts)
        inside = np.zeros(len(w.bytes) + 1, np.int8)
        inside[w.starts], inside[w.ends] = 1, -1
        plain = w.bytes[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        begins = np.zeros(len(plain) + 1, bool)
        begins[np.cumsum(w.ends - w.starts)] = True
        begins[0] = True
        doc, whole = w.doc, []
        if self.apart:
            cut = np.zeros(len(begins), bool)
            cut[1:-1] = _LETTER[plain[:-1]] & _SIGN[plain[1:]]
            cut &= ~begins
            for at in self.specials(plain):  # no cuts in a run with an added token
                stop = at + 1 + int(np.argmax(begins[at + 1 :]))
                start = at - int(np.argmax(begins[at::-1]))
                cut[start:stop] = False
                whole.append(start)
            own = np.cumsum(begins)[cut] - 1  # the run that a cut is in
            begins |= cut
            doc = np.repeat(doc, 1 + np.bincount(own, minlength=len(doc)))
        offsets = np.flatnonzero(begins) if len(plain) else np.zeros(1, np.int64)
        sizes = np.diff(offsets)
        if self.lower and len(sizes):
            ascii_ = np.maximum.reduceat(plain, offsets[:-1]) < 128
            ascii_[np.searchsorted(offsets, whole)] = False
            plain = np.where(np.repeat(ascii_, sizes), _LOWER[plain], plain)
        column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(plain)]).dictionary_encode()
        coded = self.of_runs(column.dictionary.to_pylist())
        width = np.dtype(self.type).itemsize
        flat = np.frombuffer(b"".join(coded), self.type)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // width
        first = np.cumsum(lengths) - lengths
        run = column.indices.to_numpy()
        own = lengths[run]
        before = np.cumsum(own) - own
        ids = flat[np.repeat(first[run] - before, own) + np.arange(int(own.sum()))]
        counts = np.bincount(doc, own, len(texts)).astype(np.int64)
        if end_id is None:
            return ids, counts
        out = np.empty(len(ids) + len(texts), self.type)
        ends = np.cumsum(counts + 1) - 1
        word = np.ones(len(out), bool)
        word[ends] = False
        out[ends] = end_id
        out[word] = ids
        return out, counts + 1


_words: dict[str, WordIds] = {}


def words(tokenizer_file: str) -> WordIds:
    if tokenizer_file not in _words:
        _words[tokenizer_file] = WordIds(tokenizer_file)
    return _words[tokenizer_file]


def token_ids(df: DataFrame, tokenizer_file: str, end_id: int | None = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids: binary, little-endian, 16 bits each (32 for a vocabulary of
    over 65,536). Each task adds one row without ids that has its counts of
    each id (_seen: pairs of 64-bit integers)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = df.select(key, C.text_of(text).cast("binary").alias("_text"))
    schema = f"`{key}` {dict(df.dtypes)[key]}, ids binary, _seen binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    C.small_batches(df.sparkSession)

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in C.sliced(batches, "_text"):
            known = words(tokenizer_file)
            ids, counts = known.encode_all(batch.column(1).to_pylist(), end_id)
            seen = np.bincount(ids, minlength=len(total))
            seen[: len(total)] += total
            total = seen
            offsets = np.zeros(len(counts) + 1, np.int32)
            offsets[1:] = np.cumsum(counts * ids.itemsize)
            column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.nulls(len(counts), pa.binary())], schema=arrow)
        found = np.flatnonzero(total)
        pairs = np.stack([found, total[found]], axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow[0].type), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], schema=arrow)

    return rows.mapInArrow(run, schema)


def id_type(tokenizer_file: str) -> str:
    return words(tokenizer_file).type


# ------------------------------------------------------------ files


def count_ids(ids: DataFrame, most: int = 1 << 20) -> np.ndarray:
    """Occurrences of each id over all rows, from the tasks' own counts. The
    result is as long as the vocabulary."""

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                pairs = np.frombuffer(b, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["id", "n"])

    found = ids.where("_seen is not null").select("_seen").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([0, *(r.id + 1 for r in found)]), np.int64)
    if len(out) > most:
        raise ValueError("not a vocabulary")
    for r in found:
        out[r.id] = r.n
    return out


#: Coded bytes after which a task begins another file: what it holds of its
#: part, whatever the part's size.
FILE_BYTES = 64 << 20


def write(ids: DataFrame, kind: str, folder: str, key: str = "doc_id", parts: int | None = None, file_bytes: int = FILE_BYTES, block_ids: int | None = None) -> DataFrame:
    """Code the rows of token_ids into files under `folder` in ascending key
    order; the index: part, block, file, offset, length, first (ids of the part
    before the block), n_ids, keys, sizes. Rows of equal keys are ordered by a
    hash of their ids, and dealt out by it: one key, or none, can be any share
    of the rows. A part is several files where it is large."""
    table = Table.of_counts(count_ids(ids))
    ids = ids.where("ids is not null")
    fs, root = C.filesystem(folder)
    fs.create_dir(root, recursive=True)
    C.write_once(fs, f"{root}/table.bin", table.to_bytes())
    C.write_once(fs, f"{root}/format.json", json.dumps({"scale_bits": SCALE_BITS, "table": table.id}).encode())
    spark = ids.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(key).asc_nulls_first(), F.xxhash64("ids")]
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    key_type = dict(ids.dtypes)[key]
    schema = f"part int, block int, file string, offset long, length long, first long, n_ids long, keys array<{key_type}>, sizes array<long>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    packed, most = table.to_bytes(), block_ids or BLOCK_IDS

    def run(batches):
        from pyspark import TaskContext

        own = Table.from_bytes(packed)
        part = TaskContext.get().partitionId()
        files, path = C.filesystem(folder)
        blocks: list[bytes] = []
        rows: list[tuple] = []
        keys, sizes, held, waiting = [], [], [], 0
        first = offset = block = number = 0

        def flush():
            """Code the documents that wait as a block."""
            nonlocal keys, sizes, held, waiting, first, offset, block
            data = encode_block(np.frombuffer(b"".join(held), kind).astype(np.uint32), own)
            rows.append((block, offset, len(data), first, waiting, keys, sizes))
            blocks.append(data)
            first, offset, block = first + waiting, offset + len(data), block + 1
            keys, sizes, held, waiting = [], [], [], 0

        def roll() -> pa.RecordBatch:
            """Write the blocks as a file; their rows of the index."""
            nonlocal offset, number
            data = b"".join(blocks)
            name = f"part-{part:06d}-{number:06d}-{hashlib.sha256(data).hexdigest()[:16]}.rans"
            C.write_once(files, f"{path}/{name}", data)
            columns = list(zip(*((part, b, name, *rest) for b, *rest in rows)))
            blocks.clear()
            rows.clear()
            offset, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        width = np.dtype(kind).itemsize
        for batch in C.sliced(batches, "ids"):
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(b) // width
                if waiting and waiting + n > most:
                    flush()
                    if offset >= file_bytes:
                        yield roll()
                keys.append(k)
                sizes.append(n)
                held.append(b)
                waiting += n
        if keys:
            flush()
        if rows:
            yield roll()

    return C.staged(dealt.select(key, "ids").mapInArrow(run, schema), "rans-index")


def read(index: DataFrame, folder: str, key: str = "doc_id", each=None, schema: str = "ids binary") -> DataFrame:
    """key, start, n_tokens and what each(ids) returns (the ids as
    little-endian 32-bit integers unless told otherwise), decoded from the
    files, block by block."""
    spark = index.sparkSession
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a file
    before, at = {}, 0
    for r in totals:
        before[r.part] = at
        at += r.n
    key_type = dict(index.dtypes)["keys"][len("array<") : -1]
    each = each or (lambda ids: (ids.astype("<u4").tobytes(),))
    full = f"`{key}` {key_type}, start long, n_tokens long, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        fs, root = C.filesystem(folder)
        with fs.open_input_stream(f"{root}/table.bin") as f:
            table = Table.from_bytes(f.read())
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['file']}") as f:
                    ids = decode_block(f.read_at(r["length"], r["offset"]), table)
                start, own = before[r["part"]] + r["first"], 0
                out = []
                for k, n in zip(r["keys"], r["sizes"]):
                    out.append((k, start + own, n, *each(ids[own : own + n])))
                    own += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return index.repartition(max(2 * spark.sparkContext.defaultParallelism, len(totals)), "part", "block").mapInArrow(run, full)


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    file = P.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = C.new_path(spark, "rans")
    ids = C.staged(token_ids(docs, file, end_id=2), "token-ids")
    index = write(ids, id_type(file), folder)
    C.free(ids)
    return read(index, folder, each=lambda x: (zlib.crc32(x.astype("<u4").tobytes()),), schema="ids_crc32 long")
