"""Tables keyed by a column: merges, column policies, tombstones, retention.
Plain Parquet has no MERGE; a merge here is an anti-join and a union, and a
table is a folder of versions with a pointer that is swapped last."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.text import nz, strip

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, shared by all nodes; a folder of our own where
    that is unset in a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidewell-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[id(out)] = weakref.ref(out), path
    return out


_staged: dict[int, tuple] = {}


def release(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: what was made of them
    has been written. Other DataFrames are left alone."""
    for df in tables:
        known, path = _staged.pop(id(df), (lambda: None, None))
        if known() is df:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# ---------------------------------------------------------------- merges


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def merge_on(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Upsert: source rows win, other target rows stay."""
    return source.unionByName(target.join(source.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def keyed_union(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows, and remote rows whose key is not there."""
    return local.unionByName(new_rows(local, remote, key), allowMissingColumns=True)


def new_rows(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    return remote.join(local.select(key).distinct(), key, "left_anti")


def insert_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return target.unionByName(new_rows(target, source.dropDuplicates([key]), key))


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")


def keep_state(scraped: DataFrame, hosted: DataFrame, key: str = "id", most: int = 2000) -> DataFrame:
    """What a sync writes: scraped columns always; lead_status "NEW" and notes
    only where nobody has set them; enrichment and tombstone columns stay as
    the hosted table has them."""
    own = [c for c in hosted.columns if c != key and c not in scraped.columns]
    old = hosted.select(key, F.col("lead_status").alias("_status"), F.col("notes").alias("_notes"), *own)
    both = scraped.join(old, key, "left")
    status, notes = strip(nz(F.col("_status"))), strip(nz(F.col("_notes")))
    kept = {"lead_status": F.when((status == "") | (F.lower(status) == "new"), F.lit("NEW")).otherwise(F.col("_status"))}
    kept["notes"] = F.when(notes == "", nz(F.col("notes")) if "notes" in scraped.columns else F.lit("")).otherwise(F.col("_notes"))
    if "description" in scraped.columns:
        kept["description"] = F.left(nz(F.col("description")), F.lit(most))
    return both.withColumns(kept).drop("_status", "_notes")


def write_enrichment(target: DataFrame, news: DataFrame, key: str = "id", columns: tuple[str, ...] = ("grade", "numeric_score", "confidence_level", "hashtags", "fit", "enriched_at")) -> DataFrame:
    """Partial update: a column changes where the news has a value."""
    known = [c for c in columns if c in target.columns and c in news.columns]
    renamed = news.select(key, *[F.col(c).alias(f"_{c}") for c in known])
    return target.join(renamed, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in known}).drop(*[f"_{c}" for c in known])


def set_flag(target: DataFrame, ids: DataFrame, flag: str, value: Column, key: str = "id") -> DataFrame:
    marked = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return target.join(marked, key, "left").withColumn(flag, F.when(F.col("_hit"), value).otherwise(F.col(flag))).drop("_hit")


def tombstone(target: DataFrame, ids: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """Block rows (ids: key, reason) instead of deleting them; a row that is
    blocked stays so, whatever is merged later."""
    hit = ids.groupBy(key).agg(F.min("reason").alias("_reason"))
    old = F.col("blocked_at").isNotNull()
    out = target.join(hit, key, "left")
    new = F.col("_reason").isNotNull() & ~old
    cols = {"blocked_at": F.when(new, as_of).otherwise(F.col("blocked_at")), "blocked_reason": F.when(new, F.left(F.col("_reason"), F.lit(300))).otherwise(F.col("blocked_reason"))}
    if "enriched_at" in target.columns:
        cols["enriched_at"] = F.when(new, as_of).otherwise(F.col("enriched_at"))
    return out.withColumns(cols).drop("_reason")


def set_status(target: DataFrame, changes: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """changes: key, status, notes. NOT RELEVANT blocks the row as well."""
    new = changes.select(key, F.col("status").alias("_status"), F.col("notes").alias("_note"))
    out = target.join(new, key, "left").withColumns({"lead_status": F.coalesce("_status", "lead_status"), "notes": F.coalesce("_note", "notes")})
    gone = (F.col("_status") == "NOT RELEVANT") & F.col("blocked_at").isNull()
    return out.withColumns({"blocked_at": F.when(gone, as_of).otherwise(F.col("blocked_at")), "blocked_reason": F.when(gone, "dismissed by rep (NOT RELEVANT)").otherwise(F.col("blocked_reason"))}).drop("_status", "_note")


def set_dispositions(target: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """changes: company_name, status; a blank status or a dash clears."""
    keyed = changes.withColumn("company_key", T.account_key(F.col("company_name"))).where("company_key <> ''").dropDuplicates(["company_key"])
    clear = (strip(nz(F.col("status"))) == "") | (F.col("status") == "—")
    rows = keyed.where(~clear).select("company_key", F.left(F.col("company_name"), F.lit(200)).alias("company_name"), "status", as_of.alias("updated_at"))
    return merge_on(delete_keys(target, keyed.where(clear), "company_key"), rows, "company_key")


def retain(df: DataFrame, column: str, as_of: Column, days: int = 30) -> DataFrame:
    return df.where(F.col(column) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive migration: columns (name -> type) that are missing, as null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def import_leads(leads: DataFrame, seen: DataFrame, as_of: Column, source: str = "import") -> DataFrame:
    """Leads with a title whose url was not seen, as events; a made-up url for
    those without one, the type inferred, relevance 50 by default."""
    opt = lambda c, t="string": F.col(c).cast(t) if c in leads.columns else F.lit(None).cast(t)
    title = strip(nz(opt("title")))
    base = leads.withColumn("_title", title).where("_title <> ''")
    url = F.coalesce(T.blank_to_null(opt("url")), F.concat(F.lit("https://lead.local/"), F.left(F.md5(F.col("_title").cast("binary")), F.lit(8))))
    rows = base.select(
        T.event_id(url, F.col("_title")).alias("id"),
        F.col("_title").alias("title"),
        T.infer_import_type(F.col("_title"), opt("event_type")).alias("event_type"),
        F.lit(source).alias("source"),
        url.alias("url"),
        F.coalesce(opt("published_date").try_cast("timestamp"), as_of).alias("published_date"),
        as_of.alias("discovered_date"),
        opt("company_name").alias("company_name"),
        opt("description").alias("description"),
        F.coalesce(opt("relevance_score", "double"), F.lit(50.0)).alias("relevance_score"),
        F.coalesce(opt("lead_status"), F.lit("new")).alias("lead_status"),
        nz(opt("notes")).alias("notes"),
    ).dropDuplicates(["url"])
    hashed = rows.withColumn("url_hash", T.url_hash(F.col("url")))
    return hashed.join(seen.select("url_hash").distinct(), "url_hash", "left_anti")


# ---------------------------------------------------------------- versions


class Table:
    """A table in a folder of versions: readers see whole versions only. One
    writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        folder = self._hadoop.Path(f"{self.path}/_current")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder))

    def exists(self) -> bool:
        return bool(self._pointers())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._pointers()[-1]}")

    def write(self, df: DataFrame, keep: int = 2) -> None:
        """Write a version, point to it, and drop all but the last `keep`."""
        old = self._pointers()
        name = f"v{(int(old[-1][1:9]) if old else 0) + 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/_current"))
        self._fs.create(self._hadoop.Path(f"{self.path}/_current/{name}")).close()
        for stale in [*old, name][:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/_current/{stale}"), False)
            self._fs.delete(self._hadoop.Path(f"{self.path}/{stale}"), True)

    def merge(self, source: DataFrame, key: str) -> None:
        self.write(merge_on(self.read(), source, key) if self.exists() else source)

    def push(self, remote: str) -> "Table":
        """Copy the current version to another store (any path that Spark
        writes): it appears there when it is whole."""
        other = Table(self.spark, remote)
        other.write(self.read())
        return other

    def pull(self, remote: str) -> "Table":
        """Take over the current version of another store; without one, this
        table stays as it is."""
        other = Table(self.spark, remote)
        if other.exists():
            self.write(other.read())
        return self


class Buckets:
    """A keyed table whose merges rewrite only what they touch. Rows lie in
    buckets by a hash of their key; a manifest per version says which folders
    make up each bucket. A merge reads and writes the buckets of its source's
    keys, the others stay the files they are; an append adds folders, which
    compaction folds together. A commit creates the next manifest, once: of two
    writers one fails and can try again, readers see whole versions."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        version = self.version()
        self.buckets = self._manifest(version)["buckets"] if version else buckets

    # -- manifests

    def _versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(x[:12]) for x in names if x.endswith(".json"))

    def version(self) -> int:
        """The newest version, 0 of a table that is not there."""
        return (self._versions() or [0])[-1]

    def _file(self, version: int):
        return self._hadoop.Path(f"{self.path}/_manifests/{version:012d}.json")

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, version: int, folders: dict[int, list[str]], schema: str) -> None:
        """Make a version; fails if another writer has made it."""
        made = self._hadoop.Path(f"{self.path}/_manifests/{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(made, False)
        stream.write(json.dumps({"buckets": self.buckets, "schema": schema, "folders": {str(b): f for b, f in folders.items() if f}}).encode())
        stream.close()
        if self._fs.exists(self._file(version)) or not self._fs.rename(made, self._file(version)):
            self._fs.delete(made, False)
            raise RuntimeError(f"version {version} of {self.path} was made by another writer")

    def folders(self, version: int | None = None) -> dict[int, list[str]]:
        """Bucket to its folders."""
        version = version or self.version()
        return {int(b): f for b, f in self._manifest(version)["folders"].items()} if version else {}

    # -- rows

    def _rows(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        version = version or self.version()
        found = self._manifest(version)
        return self._rows([f for fs in found["folders"].values() for f in fs], found["schema"])

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys: only their buckets are opened."""
        found = self._manifest(self.version())
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {dict(self._rows([], found['schema']).dtypes)[self.key]}")
        rows = self._rows([f for b in self._touched(wanted) for f in found["folders"].get(str(b), [])], found["schema"])
        return rows.join(F.broadcast(wanted), self.key, "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # `buckets` at most

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        """Rows as new folders, one a bucket."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{name}"))]
        return {int(x[len("_bucket=") :]): [f"{name}/{x}"] for x in made if x.startswith("_bucket=")}

    @staticmethod
    def _schema(df: DataFrame) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    # -- changes

    def change(self, source: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the buckets that source's keys fall into by
        combine(those rows, source). Returns these buckets."""
        source = staged(source)
        version = self.version()
        folders, touched = self.folders(version), self._touched(source)
        schema = self._manifest(version)["schema"] if version else self._schema(source)
        old = self._rows([f for b in touched for f in folders.get(b, [])], schema)
        rows = combine(old, source)
        new = self._write(rows)
        self._commit(version + 1, {b: f for b, f in folders.items() if b not in touched} | new, self._schema(rows))
        release(source)
        return touched

    def merge(self, source: DataFrame) -> list[int]:
        return self.change(source, lambda old, new: merge_on(old, new, self.key))

    def insert_absent(self, source: DataFrame) -> list[int]:
        return self.change(source, lambda old, new: insert_absent(old, new, self.key))

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys.select(self.key), lambda old, new: delete_keys(old, new, self.key)) if self.version() else []

    def append(self, rows: DataFrame) -> None:
        """Add rows without reading any: their keys must be new."""
        version = self.version()
        folders = self.folders(version)
        for b, f in self._write(rows).items():
            folders[b] = folders.get(b, []) + f
        self._commit(version + 1, folders, self._manifest(version)["schema"] if version else self._schema(rows))

    def compact(self, most: int = 1, keep: Column | None = None) -> list[int]:
        """Fold buckets of more than `most` folders; with `keep` all buckets,
        and only the rows for which it holds (retention). Returns the buckets
        that were rewritten."""
        version = self.version()
        found = self._manifest(version)
        folders = self.folders(version)
        chosen = [b for b, f in folders.items() if keep is not None or len(f) > most]
        if chosen:
            rows = self._rows([f for b in chosen for f in folders[b]], found["schema"])
            new = self._write(rows if keep is None else rows.where(keep))
            self._commit(version + 1, {b: f for b, f in folders.items() if b not in chosen} | new, found["schema"])
        return sorted(chosen)

    def vacuum(self, versions: int = 2) -> None:
        """Remove manifests but the last ones, and folders that none names."""
        found = self._versions()
        kept = {f for v in found[-versions:] for fs in self.folders(v).values() for f in fs}
        for v in found[:-versions]:
            self._fs.delete(self._file(v), False)
        for write in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data")):
            name = f"data/{write.getPath().getName()}"
            for part in self._fs.listStatus(write.getPath()):
                if part.getPath().getName().startswith("_bucket=") and f"{name}/{part.getPath().getName()}" not in kept:
                    self._fs.delete(part.getPath(), True)
