"""Connectors, supervised queries, and side effects exactly once."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tidewell.sources import connectors
from tidewell.streaming import ledger, supervise

FEED = "<rss version='2.0'><channel><item><title>T {0} &amp; co</title><link>http://x/{0}</link><media:thumbnail url='u'/><content:encoded><![CDATA[some <b>text</b>]]></content:encoded></item><item><guid> g{0} </guid></item></channel></rss>"


def payloads(spark, rows):
    return spark.createDataFrame(rows, "name string, payload string")


@pytest.fixture
def archive(spark, tmp_path):
    connectors.register(spark)
    path = f"file://{tmp_path}/archive"
    for day in ("20240101", "20240102", "20240103"):
        connectors.archive(payloads(spark, [(f"f{i}", FEED.format(i)) for i in range(4)] + [("broken", "<rss"), ("none", None), ("empty", "<rss/>")]), path, day)
    return path


def test_feed(spark, archive):
    df = spark.read.format("feed").option("path", archive).load()
    rows = df.where("cycle = '20240102'").collect()
    got = {(r.name, r.pos): (r.title, r.link, r.summary, r.error) for r in rows}
    assert got["f1", 0] == ("T 1 & co", "http://x/1", "some <b>text</b>", None) and got["f1", 1] == ("", "g1", None, None)
    assert got["broken", None][3].startswith("parse") and got["none", None][3].startswith("fetch")
    assert len(rows) == 4 * 2 + 2
    assert df.where("cycle > '20240101' and name in ('f1', 'f3') and pos = 0").count() == 4
    assert df.where("cycle < '20240101'").count() == 0
    assert spark.read.format("feed").option("path", archive).option("most", 1).load().where("error is null").count() == 12


def test_filters_choose_pieces(archive):
    """What is pushed down decides what is opened."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual
    from pyspark.sql.types import _parse_datatype_string

    source = connectors.FeedSource({"path": archive})
    reader = connectors.PayloadReader(source.parse, _parse_datatype_string(source.schema()), source.options)
    every = len(reader.partitions())
    left = list(reader.pushFilters([GreaterThanOrEqual(("cycle",), "20240103"), EqualTo(("name",), "f2"), EqualTo(("pos",), 0)]))
    assert left == [EqualTo(("pos",), 0)] and 0 < len(reader.partitions()) < every
    assert {r[1] for p in reader.partitions() for r in reader.rows(p)} == {"f2"}


def test_requests(spark, tmp_path):
    connectors.register(spark)
    (tmp_path / "a.xml").write_text(FEED.format(7))
    wanted = {"a": f"{tmp_path}/a.xml", "gone": f"file://{tmp_path}/gone.xml"}
    rows = spark.read.format("feed").option("requests", json.dumps(wanted)).load().collect()
    assert [(r.name, r.link) for r in rows if r.error is None] == [("a", "http://x/7"), ("a", "g7")]
    assert [r.name for r in rows if r.error] == ["gone"]
    cycle = connectors.fetched(spark, wanted, f"file://{tmp_path}/archive")
    again = spark.read.format("feed").option("path", f"file://{tmp_path}/archive").load()
    assert sorted((r.cycle, r.name) for r in again.collect()) == [(cycle, "a")] * 2 + [(cycle, "gone")]


def test_news_and_filings(spark, tmp_path):
    connectors.register(spark)
    news = json.dumps({"value": [{"name": "n", "url": "u", "description": "d", "datePublished": "p"}, {"url": "v"}]})
    filing = json.dumps({"hits": {"hits": [{"_source": {"ciks": ["1", "2"], "display_names": [], "adsh": "a", "items": ["5.02"]}}]}})
    connectors.archive(payloads(spark, [("q", news), ("bad", "[]")]), f"file://{tmp_path}/news", "1")
    connectors.archive(payloads(spark, [("5.02", filing), ("none", "{}")]), f"file://{tmp_path}/filings", "1")
    rows = spark.read.format("news").option("path", f"file://{tmp_path}/news").load().collect()
    assert sorted((r.name, r.pos, r.title, r.link) for r in rows if r.error is None) == [("q", 0, "n", "u"), ("q", 1, "", "v")]
    assert [r.name for r in rows if r.error] == ["bad"]
    rows = spark.read.format("filings").option("path", f"file://{tmp_path}/filings").load().collect()
    assert [(r.name, r.cik, r.display_name, r.adsh, r["items"]) for r in rows] == [("5.02", "1", None, "a", ["5.02"])]


def test_restart_without_loss_or_repeat(spark, archive, tmp_path):
    """A batch that dies half-way comes again under its number."""
    stream = spark.readStream.format("feed").option("path", archive).load()
    tries, errors = [], []

    def each(batch, n):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        tries.append(n)
        if len(tries) in (1, 2):
            raise OSError("killed")

    watch = supervise.Progress()
    spark.streams.addListener(watch)
    start = supervise.polling(stream, each, f"{tmp_path}/state", "restarted")
    failures = supervise.supervise(start, pause=0.05, poll=0.1, failed=lambda n, e: errors.append(str(e)))
    connectors.archive(payloads(spark, [("late", FEED.format(9))]), archive, "20240104")
    assert failures == 2 and len(errors) == 2 and supervise.supervise(start, poll=0.1) == 0
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert tries[:3] == [0, 0, 0] and tries[-1] == 1
    whole = spark.read.format("feed").option("path", archive).load()
    assert out.exceptAll(whole).count() == 0 and whole.exceptAll(out).count() == 0
    spark.streams.removeListener(watch)
    with pytest.raises(Exception, match="killed"):
        bad = supervise.polling(stream, lambda b, n: (_ for _ in ()).throw(OSError("killed")), f"{tmp_path}/state2", "hopeless")
        supervise.supervise(bad, pause=0.01, poll=0.1, most=1)


def test_graceful_stop(spark, archive, tmp_path):
    stop = supervise.Marker(spark, f"file://{tmp_path}/stop", poll=0.05)
    ended = []

    def each(batch, n):
        batch.count()
        if n == 0:
            stop.set()
        ended.append(n)

    stream = spark.readStream.format("feed").option("path", archive).load()
    start = supervise.polling(stream, each, f"{tmp_path}/state", "stopped", every="100 milliseconds")
    thread = threading.Thread(target=lambda: supervise.supervise(start, stop=stop, poll=0.1))
    thread.start()
    thread.join(60)
    assert not thread.is_alive() and ended == [0]
    assert stop.is_set() and supervise.supervise(lambda: pytest.fail("started"), stop=stop) == 0
    stop.clear()
    assert not stop.wait(0.01)


class Mail:
    """A handler that cannot take back what it sent."""

    def __init__(self):
        self.sent, self.fail = [], 0

    def __call__(self, rows, token):
        if self.fail:
            self.fail -= 1
            raise OSError("no mail")
        self.sent += [r.id for r in rows.collect()]


def frame(spark, ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, title string")


def test_ledger(spark, tmp_path):
    book, mail = ledger.Ledger(spark, f"file://{tmp_path}/ledger"), Mail()
    files = ledger.FileAlerts(f"file://{tmp_path}/out")
    step = ledger.exactly_once(book, {"file": files, "mail": mail})
    step(frame(spark, [1, 2, 2]), 0)
    step(frame(spark, [1, 2, 2]), 0)  # delivered again
    mail.fail = 1
    step(frame(spark, [2, 3, None]), 1)  # mail fails: stays open
    assert mail.sent == [1, 2] and book.open("mail") == [1] and book.open("file") == []
    step(frame(spark, [4]), 2)
    assert mail.sent == [1, 2, 3, 4] and book.open("mail") == []
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]
    other = ledger.exactly_once(ledger.Ledger(spark, f"file://{tmp_path}/ledger", run="second"), {"mail": mail})
    other(frame(spark, [4, 5]), 0)  # a new checkpoint: batch numbers start again
    assert mail.sent == [1, 2, 3, 4, 5]
    book.forget(2)
    step(frame(spark, [1]), 3)
    assert mail.sent[-1] == 1


def test_crash_between_send_and_mark(spark, tmp_path):
    book, mail = ledger.Ledger(spark, f"file://{tmp_path}/ledger"), Mail()
    files = ledger.FileAlerts(f"file://{tmp_path}/out")
    step = ledger.exactly_once(book, {"file": files, "mail": mail})
    real = book.mark

    def crash(handler, n, what):
        if what == "done":
            raise SystemExit("killed")
        real(handler, n, what)

    book.mark = crash
    with pytest.raises(SystemExit):
        ledger.exactly_once(book, {"mail": mail})(frame(spark, [1, 2]), 0)
    with pytest.raises(SystemExit):
        ledger.exactly_once(book, {"file": files})(frame(spark, [1, 2]), 0)
    book.mark = real
    step(frame(spark, [1, 2]), 0)
    assert mail.sent == [1, 2] and book.unknown("mail") == [0]
    assert spark.read.json(f"{tmp_path}/out").groupBy("id").count().where("count <> 1").count() == 0
    mail.fail = 9
    with pytest.raises(RuntimeError):
        ledger.exactly_once(book, {"mail": mail})(frame(spark, [7]), 1)
    mail.fail = 0
    step(frame(spark, [7]), 1)
    assert mail.sent == [1, 2, 7]


def test_claims_take_one_row_an_id(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "id int, x string")
    assert sorted(map(tuple, book.claim(rows, 0).collect())) == [(1, "a"), (2, None)]
    assert book.claim(rows.select("id").withColumn("x", F.lit("z")), 1).count() == 0
