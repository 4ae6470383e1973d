"""Media columns: content-addressed payloads in tar shards (operator 1).

Every task writes the media objects of its rows into tar shards in the shared
folder, each object once per shard under the name of its own SHA-256, and
emits for each row the object's digest, shard, offset and length. Rows are a
few dozen bytes from there on; payloads are never shuffled. Header-only range
reads (the first 33 bytes of an object) fill metadata columns; the whole
object is read back only where features are asked for.

A shard is named after the objects in it and appears by a rename, so a retried
or duplicated task leaves the same shard. The rows are a table in the shared
folder; a lost executor costs only the reads it had not finished.

The format here is PNG, 8-bit greyscale, 64 samples a row: a payload of UTF-8
bytes, padded with zeros to a positive multiple of 64, is stored losslessly as
samples.

Defined cases: a null or empty text is a payload of 64 zero bytes; equal texts
have equal objects; repeated rows keep one output row each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WIDTH = 64
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and the IHDR chunk


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Metadata from the first HEADER_BYTES of an object."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG object")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head[16:29])
    if (depth, colour, interlaced) != (8, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    return {"width": width, "height": height, "depth": depth}


def from_png(data: bytes) -> bytes:
    meta = png_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, share of zero samples and mean
    absolute step between neighbours, of the samples."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    seen = p[p > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={-(seen * np.log2(seen)).sum():.4f};zeros={p[0]:.4f};step={step:.4f}"


class ShardWriter:
    """Tar shards of at most about SHARD_BYTES in one folder."""

    def __init__(self, folder: str):
        self.fs, self.path = C.filesystem(folder)
        self.folder = folder
        self.fs.create_dir(self.path, recursive=True)
        self._open()

    def _open(self):
        self.buffer = io.BytesIO()
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)
        self.where: dict[bytes, int] = {}
        self.names = hashlib.sha256()

    def add(self, digest: bytes, data: bytes) -> int:
        """The object's offset in the shard."""
        if digest not in self.where:
            info = tarfile.TarInfo(digest.hex() + ".png")
            info.size = len(data)
            self.where[digest] = self.tar.offset + tarfile.BLOCKSIZE
            self.tar.addfile(info, io.BytesIO(data))
            self.names.update(digest)
        return self.where[digest]

    @property
    def full(self) -> bool:
        return self.tar.offset >= SHARD_BYTES

    def close(self) -> str:
        """Write the shard and start another; its name."""
        self.tar.close()
        name = f"{self.names.hexdigest()[:32]}.tar"
        C.write_once(self.fs, f"{self.path}/{name}", self.buffer.getbuffer())
        self._open()
        return name


def store(df: DataFrame, folder: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Write payloads to shards under `folder`; `keep`, n_bytes, digest, shard,
    offset, length. Lazy: stage the result before reading objects."""
    types = dict(df.dtypes)
    rows = df.select(*keep, C.text_of(text).cast("binary").alias("_payload"))
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["n_bytes long, digest binary, shard string, offset long, length long"])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        shards = ShardWriter(folder)
        kept: list[list] = [[] for _ in arrow]

        def flush():
            name = shards.close()
            columns = [pa.array([name] * len(c) if f.name == "shard" else c, f.type) for f, c in zip(arrow, kept)]
            for c in kept:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        k = len(keep)
        for batch in C.sliced(batches, "_payload"):
            ids = [batch.column(i).to_pylist() for i in range(k)]
            for j, raw in enumerate(batch.column(k).to_pylist()):
                n = len(raw)
                data = to_png(raw.ljust(-(-max(n, 1) // 64) * 64, b"\0"))
                digest = hashlib.sha256(data).digest()
                offset = shards.add(digest, data)
                for c, v in zip(kept, [*(x[j] for x in ids), n, digest, None, offset, len(data)]):
                    c.append(v)
                if shards.full:
                    yield flush()
        if kept[0]:
            yield flush()

    return rows.mapInArrow(run, schema)


def _ranges(df: DataFrame, folder: str, size, schema: str, each) -> DataFrame:
    """Range-read `size(length)` bytes of each row's object; each(bytes) gives
    the values of the new columns. The rows of a shard come in its order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = dict(df.dtypes)
    full = ", ".join([f"`{c}` {types[c]}" for c in df.columns] + [schema])
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        fs, root = C.filesystem(folder)
        name, handle = None, None
        for batch in batches:
            shard, offset, length, digest = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length", "digest"))
            new, last = [], (None, None)
            for s, o, n, d in zip(shard, offset, length, digest):
                if (s, o) == last[0]:
                    new.append(last[1])
                    continue
                if s != name:
                    if handle:
                        handle.close()
                    name, handle = s, fs.open_input_file(f"{root}/{s}")
                values = each(handle.read_at(size(n), o), d)
                last = (s, o), values
                new.append(values)
            columns = [pa.array([v[i] for v in new], arrow.field(batch.num_columns + i).type) for i in range(len(arrow) - batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=arrow)
        if handle:
            handle.close()

    return df.mapInArrow(run, full)


def with_metadata(df: DataFrame, folder: str) -> DataFrame:
    """width, height and depth, from a range read of each object's header."""

    def each(head: bytes, _):
        m = png_header(head)
        return m["width"], m["height"], m["depth"]

    return _ranges(df, folder, lambda n: min(n, HEADER_BYTES), "width int, height int, depth int", each)


def with_features(df: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes say once read back: media and payload digests,
    sizes, the checksum of the last 64 samples, and the feature string."""

    def each(data: bytes, digest: bytes):
        media = hashlib.sha256(data)
        if media.digest() != digest:
            raise ValueError("a stored object does not match its address")
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), media.hexdigest(), features(payload)

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _ranges(df, folder, lambda n: n, schema, each)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = C.new_path(spark, "media")
    rows = C.staged(store(docs, folder), "media-rows")
    # The rows are small: dealt out, in the order of the objects, the reads of
    # an object that many rows share may be split as well.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "shard", "offset", "doc_id").sortWithinPartitions("shard", "offset")
    out = with_features(with_metadata(rows, folder), folder)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset")
