"""Feeds, news and filings as Spark data sources: `spark.read.format("feed")`,
`"news"` and `"filings"`, and the same by `spark.readStream`.

They read what is fetched now (`requests`, a partition for each feed, query or
item code), or an archive of payloads that earlier fetches left: a folder of
cycles, `cycle=<name>/part-*.parquet` with name and payload, a partition for
each row group. Cycle names sort by time; a cycle counts once its writer has
finished. Filters on `cycle` (the as-of cut) choose folders, filters on `name`
reach the Parquet scan; what is left is for Spark. Entries are parsed where they
are read; a source that cannot be fetched or parsed gives one row with an error
and stops no other.

As a stream an archive's offset is its last cycle: a batch takes the cycles
after the one before, `cycles_per_batch` at a time (all that is new in the first
batch after a start), and reads them on the executors, so that a restart
repeats exactly the batch that was lost.

Options: `path` (archive) or `requests` (JSON: name to URI, http(s) or any store
that Arrow knows), `most` (entries of a payload), `timeout` (seconds),
`cycles_per_batch`. Call `register(spark)` once a session.
"""

from __future__ import annotations

import datetime
import json
import operator
import re
import time
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.vocab import NAMESPACES

BLANK = " \t\n\x0b\f\r"
#: Rows, and letters, of a batch that goes to Spark.
BATCH = 500
LETTERS = 4 << 20
#: Payloads that are held at once, and bytes of a row group of an archive: a
#: task holds one such group, whatever the archive's size.
HELD = 16
GROUP = 4 << 20


# ---------------------------------------------------------------- payloads


def declared(xml: str) -> str:
    """A feed with the prefixes declared that it uses without declaring."""
    used = dict.fromkeys(re.findall(r"<([A-Za-z][\w-]*):", xml))
    known = set(re.findall(r"xmlns:([A-Za-z][\w-]*)\s*=", xml))
    extra = "".join(f' xmlns:{p}="{NAMESPACES.get(p, "urn:ns:" + p)}"' for p in used if p not in known)
    return re.sub(r"<(?:rss|feed)\b", lambda m: m[0] + extra, xml, count=1) if extra else xml


def feed_entries(payload: str, most: int | None = None) -> Iterator[tuple]:
    """pos, title, link, summary, pub_date, published, updated, date of a feed's
    items or, without any, entries; of several candidates the first with text."""
    root = ET.fromstring(declared(payload))
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    found = [e for e in root.iter() if local(e) == "item"] or [e for e in root.iter() if local(e) == "entry"]
    for pos, entry in enumerate(found[:most]):
        texts, hrefs = {}, {}
        for e in entry.iter():
            if e is not entry:
                name = local(e)
                texts.setdefault(name, "".join(e.itertext()).strip(BLANK) or None)
                hrefs.setdefault(name, e.get("href"))
        first = lambda *names: next((texts[n] for n in names if texts.get(n)), None)
        link = first("link") or hrefs.get("link") or first("id", "guid")
        yield pos, first("title") or "", link, first("encoded", "description", "summary", "content"), first("pubDate"), first("published"), first("updated"), first("date")


def news_entries(payload: str, most: int | None = None) -> Iterator[tuple]:
    """pos, title, link, summary, published of a news search's answer."""
    for pos, v in enumerate((json.loads(payload).get("value") or [])[:most]):
        yield pos, v.get("name") or "", v.get("url"), v.get("description"), v.get("datePublished")


def filing_entries(payload: str, most: int | None = None) -> Iterator[tuple]:
    """pos, cik, display_name, adsh, file_type, items, states, file_date of a
    full-text search's answer."""
    hits = (json.loads(payload).get("hits") or {}).get("hits") or []
    head = lambda v: v[0] if v else None
    for pos, h in enumerate(hits[:most]):
        s = h.get("_source") or {}
        yield pos, head(s.get("ciks")), head(s.get("display_names")), s.get("adsh"), s.get("file_type"), s.get("items"), s.get("biz_states"), s.get("file_date")


# ---------------------------------------------------------------- stores


def _store(uri: str):
    """(Arrow file system, path) of a URI as Spark spells it."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri[6:]
    if uri.startswith("file:"):
        uri = uri[len("file:") :].replace("//", "/", 1) if uri.startswith("file://") else uri[len("file:") :]
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def fetch(uri: str, timeout: float) -> str:
    if uri.startswith(("http://", "https://")):
        with urllib.request.urlopen(uri, timeout=timeout) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    store, path = _store(uri)
    with store.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def cycles(path: str) -> list[str]:
    """Names of an archive's finished cycles, ascending."""
    from pyarrow import fs

    store, root = _store(path)
    folders = [x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("cycle=")]
    done = store.get_file_info([f"{root}/{x}/_SUCCESS" for x in folders]) if folders else []
    return sorted(x[len("cycle=") :] for x, d in zip(folders, done) if d.type == fs.FileType.File)


def archive(payloads: DataFrame, path: str, cycle: str) -> None:
    """Write name, payload as a cycle of an archive; its name must sort after
    those that streams have read."""
    rows = payloads.select(F.col("name").cast("string").alias("name"), F.col("payload").cast("string").alias("payload"))
    rows.write.options(**{"parquet.block.size": GROUP, "parquet.block.size.row.check.min": 10, "parquet.page.size": 1 << 18}).option("parquet.page.row.count.limit", 256).parquet(f"{path.rstrip('/')}/cycle={cycle}")


# ---------------------------------------------------------------- sources


@dataclass
class Piece(InputPartition):
    """A request (uri) or a row group of an archive's file."""

    cycle: str
    name: str | None = None
    uri: str | None = None
    file: str | None = None
    group: int = 0

    def __post_init__(self):
        self.value = None


#: Filters that are taken over, and the functions of `operator` that apply them.
_TESTS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}


def _holds(test: str, left, value):
    """A test of a value, or of an Arrow field."""
    if test == "in":
        return left.isin(list(value)) if isinstance(left, ds.Expression) else left in value
    return getattr(operator, test)(left, value)


class _Reading:
    """What batch and stream readers share: pieces, and the rows of a piece."""

    def __init__(self, parse, schema: StructType, options):
        self.parse, self.arrow = parse, to_arrow_schema(schema)
        self.path, self.most = options.get("path"), int(options["most"]) if "most" in options else None
        self.requests = json.loads(options.get("requests", "{}"))
        self.timeout, self.step = float(options.get("timeout", 30)), int(options.get("cycles_per_batch", 100))
        self.on_cycle, self.on_name = [], []
        if bool(self.path) == bool(self.requests):
            raise ValueError("one of the options path and requests is needed")

    def chosen(self, cycle: str, name: str | None = None) -> bool:
        return all(_holds(t, cycle, v) for t, v in self.on_cycle) and (name is None or all(_holds(t, name, v) for t, v in self.on_name))

    def pieces(self, names: list[str]) -> list[Piece]:
        """The row groups of cycles; footers are read, no rows."""
        from pyarrow import fs

        out = []
        store, root = _store(self.path)
        for cycle in names:
            for f in store.get_file_info(fs.FileSelector(f"{root}/cycle={cycle}")):
                if f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")):
                    with store.open_input_file(f.path) as opened:
                        groups = pq.ParquetFile(opened).num_row_groups
                    out += [Piece(cycle, file=f.path, group=g) for g in range(groups)]
        return out

    def payloads(self, piece: Piece) -> Iterator[tuple]:
        """(name, payload, error) of a piece."""
        if piece.uri is not None:
            try:
                yield piece.name, fetch(piece.uri, self.timeout), None
            except Exception as e:  # a source that fails stops no other
                yield piece.name, None, f"fetch: {e}"[:300]
            return
        store, _ = _store(self.path)
        part = ds.ParquetFileFormat().make_fragment(piece.file, store, row_groups=[piece.group])
        tests = [_holds(t, ds.field("name"), v) for t, v in self.on_name]
        wanted = reduce(operator.and_, tests) if tests else None
        for batch in part.to_batches(columns=["name", "payload"], filter=wanted, batch_size=HELD, batch_readahead=0, fragment_readahead=0, use_threads=False):
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield name, payload, None if payload is not None else "fetch: no payload"

    def rows(self, piece: Piece) -> Iterator[tuple]:
        blanks = (None,) * (len(self.arrow) - 3)
        for name, payload, error in self.payloads(piece):
            if error is None:
                try:
                    for entry in self.parse(payload, self.most):
                        yield (piece.cycle, name, *entry, None)
                    continue
                except (ET.ParseError, ValueError, AttributeError, TypeError, KeyError) as e:
                    error = f"parse: {e}"[:300]
            yield (piece.cycle, name, *blanks, error)

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        """The rows of a piece; none is Spark's way to say that there are no
        pieces."""
        held, letters = [], 0
        for row in self.rows(piece) if piece is not None else ():
            held.append(row)
            letters += sum(len(v) for v in row if isinstance(v, str))
            if len(held) == BATCH or letters >= LETTERS:
                yield self._batch(held)
                held, letters = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), self.arrow)], schema=self.arrow)


class PayloadReader(_Reading, DataSourceReader):
    def pushFilters(self, filters):
        """Take over comparisons of cycle and name with values."""
        for f in filters:
            test = _TESTS.get(type(f))  # null values compare with nothing: Spark keeps those
            if test and f.value is not None and f.attribute in (("cycle",), ("name",)):
                (self.on_cycle if f.attribute == ("cycle",) else self.on_name).append((test, f.value))
            else:
                yield f

    def partitions(self):
        if self.requests:
            now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S")
            return [Piece(now, name=n, uri=u) for n, u in sorted(self.requests.items()) if self.chosen(now, n)]
        return self.pieces([c for c in cycles(self.path) if self.chosen(c)])


class PayloadStream(_Reading, DataSourceStreamReader):
    def __init__(self, *args):
        super().__init__(*args)
        if not self.path:
            raise ValueError("a stream reads an archive: archive what is fetched")
        self.last = None

    def initialOffset(self) -> dict:
        return {"cycle": ""}

    def latestOffset(self) -> dict:
        names = cycles(self.path)
        if self.last is not None:  # bounded batches once it is known where this one starts
            names = [c for c in names if c > self.last][: self.step] or [self.last]
        return {"cycle": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict):
        self.last = end["cycle"]
        return self.pieces([c for c in cycles(self.path) if start["cycle"] < c <= end["cycle"]])

    def commit(self, end: dict) -> None:
        self.last = end["cycle"]


class FeedSource(DataSource):
    """RSS and Atom feeds."""

    parse = staticmethod(feed_entries)
    columns = "title string, link string, summary string, pub_date string, published string, updated string, date string"

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return f"cycle string, name string, pos int, {self.columns}, error string"

    def reader(self, schema: StructType) -> PayloadReader:
        return PayloadReader(self.parse, schema, self.options)

    def streamReader(self, schema: StructType) -> PayloadStream:
        return PayloadStream(self.parse, schema, self.options)


class NewsSource(FeedSource):
    """Answers of a news search, a name for each query."""

    parse = staticmethod(news_entries)
    columns = "title string, link string, summary string, published string"

    @classmethod
    def name(cls) -> str:
        return "news"


class FilingSource(FeedSource):
    """Answers of a full-text search of filings, a name for each item code."""

    parse = staticmethod(filing_entries)
    columns = "cik string, display_name string, adsh string, file_type string, items array<string>, biz_states array<string>, file_date string"

    @classmethod
    def name(cls) -> str:
        return "filings"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FeedSource, NewsSource, FilingSource):
        spark.dataSource.register(source)


def fetched(spark: SparkSession, requests: dict[str, str], path: str, cycle: str | None = None, partitions: int | None = None, timeout: float = 30) -> str:
    """Fetch all requests now, on the executors, into a cycle of an archive;
    what fails is archived as a payload of null. The cycle's name."""
    cycle = cycle or time.strftime("%Y%m%dT%H%M%S", time.gmtime())
    rows = spark.createDataFrame(sorted(requests.items()), "name string, uri string").repartition(partitions or max(1, min(len(requests), 200)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, uri in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    payload = fetch(uri, timeout)
                except Exception:
                    payload = None
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([payload], pa.string())], names=["name", "payload"])

    archive(rows.mapInArrow(run, "name string, payload string"), path, cycle)
    return cycle
