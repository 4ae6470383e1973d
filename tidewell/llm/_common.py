"""Helpers shared by the training-data operators: the shared folder, staged
tables and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A
    folder of our own stands in only where that is unset in a local session;
    on a cluster there is no folder to guess."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidewell-shared-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back. This
    cuts the lineage; a lost executor costs no recomputation of what is
    already there."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = weakref.ref(out), path
    return out


_paths: dict[int, tuple] = {}


def free(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: what was made of them
    has been written. Other DataFrames are left alone."""
    for df in tables:
        known, path = _paths.pop(id(df), (lambda: None, None))
        if known() is df:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, as Spark spells it, or a plain
    path."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if sep and scheme in ("s3a", "s3n"):
        uri = "s3://" + rest

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_once(fs, path: str, data) -> None:
    """Write a file so that readers see it whole or not at all. A retried or
    speculative task writes the same bytes under the same name: where that is
    there already (some stores refuse to rename over it), nothing is left to
    do."""
    from pyarrow.fs import FileType

    there = lambda: fs.get_file_info(path).type == FileType.File
    if there():
        return
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    try:
        fs.move(temporary, path)
    except OSError:
        if not there():
            raise
        fs.delete_file(temporary)


#: Bytes and rows of a batch that goes to a Python worker: both sides hold a
#: few of them at a time.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session, unless it has smaller bounds. The
    bounds stay: what is planned here runs later."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        try:
            now = int(str(spark.conf.get(name)).lower().rstrip("b"))
        except Exception:  # not known to this version, or with a unit
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `most` bytes in each; a single
    longer row is a batch of its own."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        n, start, size = len(values), 0, 0
        if values.nbytes <= most:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        for i in range(n):
            if i > start and size + lengths[i] > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(lengths[i])
        if start < n:
            yield batch.slice(start, n - start)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over bounded batches; fn returns the output columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches):
        for batch in sliced(batches, column):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, (pa.Array, pa.ChunkedArray)) and v.type == f.type else pa.array(v, type=f.type) for f in arrow for v in (out[f.name],)], schema=arrow
            )

    return df.mapInArrow(run, schema)
