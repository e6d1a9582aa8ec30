"""Event streams: the stateful parser against a plain one, keep-alives with a moved clock, feed and sink."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import progress
from ledgerline.streaming import event_stream

EPOCH = dt.datetime(2024, 1, 1)
FRAGMENTS = "conn_id long, seq long, text string, done boolean"


def plain_dispatches(text, done):
    """(event, data) by reading the whole text line by line."""
    *lines, rest = text.split("\n")
    event, out = None, []
    for line in (x.strip(event_stream.BLANKS) for x in lines):
        if line.startswith("event: "):
            event = line[7:].strip(event_stream.BLANKS)
        elif line.startswith("data: "):
            out.append((event, line[6:]))
            event = None
    return out + ([(event, rest.strip(event_stream.BLANKS))] if done and rest.strip(event_stream.BLANKS) else [])


def cut(text, seed):
    r = random.Random(seed)
    ends = sorted(r.sample(range(len(text) + 1), min(len(text), 6)))
    return [text[a:b] for a, b in itertools.pairwise([0, *ends, len(text)])]


TEXTS = [
    'event: progress\ndata: {"step":"a"}\n\n: keep-alive 1\n\nevent: complete\r\ndata: {"status":"success","data":{"x":1}}\n\n',
    'data: {"message":"m"}\nevent: error\nevent: progress\ndata:  {"status":"error"}\ndata: {"n":1}',
    "\n\n  data: Error: no json  \ndata: nothing\ndata: \n  event: x  \nbad line\ndata: {\"x\":0}\n\xa0event: 　y\n",
    ":only a comment\n", "event: progress\ndata: {}\n" * 50, "data: [1]\ndata: 7\nrest with error",
]


def wanted(texts, done=True):
    return sorted((c, n, e, d) for c, t in enumerate(texts) for n, (e, d) in enumerate(plain_dispatches(t, done)))


def all_rows():
    return [(c, k, piece, k == len(pieces) - 1) for c, t in enumerate(TEXTS) for pieces in [cut(t, c)] for k, piece in enumerate(pieces)]


def test_dispatches_of_a_table(spark):
    rows = all_rows()
    more = [(0, 2, "data: again\n", False), (0, 99, "data: after the end\n", False), (None, 0, "data: x\n", True), (7, None, "data: x\n", True), (8, 1, "data: {}\n", True), (9, 0, None, True)]
    random.Random(0).shuffle(rows)
    got = event_stream.dispatches(spark.createDataFrame(rows, FRAGMENTS).unionByName(spark.createDataFrame(more[1:], FRAGMENTS))).collect()
    kinds = {(r["conn_id"], r["n"]): r["kind"] for r in got}
    want = wanted(TEXTS)
    assert sorted(tuple(r)[:4] for r in got) == sorted(w for w in want if (w[0], w[1]) in kinds)
    # A last line without an end is handed over whole, so it is no JSON.
    assert {w[3] for w in want if (w[0], w[1]) not in kinds} == {"nothing", 'data: {"n":1}'}
    assert [kinds[0, k] for k in (0, 1)] == ["progress", "complete"] and kinds[1, 1] == "error" and kinds[2, 0] == "error" and kinds[4, 0] == "progress" and kinds[5, 2] == "error"
    assert event_stream.dispatches(spark.createDataFrame([], FRAGMENTS)).count() == 0


def run_stream(spark, tmp_path, batches, schema, build):
    """Rows of a stream whose input comes batch by batch, and which is restarted between them."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = build(spark.readStream.schema(schema).parquet(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(map(tuple, spark.read.schema(stream.schema).parquet(out).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return got


def test_dispatches_of_a_stream(spark, tmp_path):
    """Fragments come late, early and twice, over restarts; the state carries open lines from batch to batch."""
    rows = all_rows()
    late = [r for r in rows if r[1] % 3 == 1]
    batches = [[r for r in rows if r[1] % 3 == 2], late[::-1], [r for r in rows if r[1] % 3 == 0] + late, late]
    got = run_stream(spark, tmp_path, batches, FRAGMENTS, event_stream.dispatches)
    table = sorted(map(tuple, event_stream.dispatches(spark.createDataFrame(rows, FRAGMENTS)).collect()), key=str)
    assert got[0] == [] and got[-1] == table and got[-2] == table


def at(seconds):
    return EPOCH + dt.timedelta(seconds=seconds)


def test_silence_with_a_moved_clock(spark, tmp_path):
    events = "run_id long, ts timestamp"
    build = lambda s: event_stream.silence_signals(s, "20 seconds")
    # Run 9 moves the clock alone; the events at 42 and 43 come after that at 61 but within the delay.
    batches = [[(1, 0), (2, 0.25), (1, 14), (2, 61)], [(1, 29 + 13), (1, 29 + 14), (3, 70), (1, 75.000001)], [(9, 300)], [(2, 640), (9, 660)], [(1, 700), (3, 900)], [(3, 915), (9, 1500), (1, 2000)], [(9, 3000)]]
    seen = [(r, t) for b in batches for r, t in b if r != 9]
    got = run_stream(spark, tmp_path, [[(r, at(t)) for r, t in b] for b in batches], events, build)
    rows = spark.createDataFrame([(r, at(t)) for r, t in seen], events)
    watermark = at(3000 - 20)
    want = sorted(map(tuple, progress.silence_signals(rows, str(watermark)).collect()), key=str)
    assert [r for r in got[-1] if r[0] != 9] == want
    assert sum(r[2] == "stale" for r in want) == 6
    told = [r for r in got[2] if r[0] == 2]  # at 280 seconds nothing is stale yet, and comments stand up to there
    assert {r[2] for r in told} == {"keep-alive"} and max(r[1] for r in told) < at(280)


def test_silences_by_definition(spark):
    r = random.Random(3)
    times = sorted(r.choice([r.random() * 40, r.random() * 2000, 15 * r.randint(0, 40)]) for _ in range(200))
    moments = [at(t) for t in itertools.accumulate(times)]
    rows = spark.createDataFrame([(1, m) for m in moments] + [(1, None), (2, moments[0])], "run_id long, ts timestamp_ntz")
    want = []
    for a, b in itertools.pairwise(moments):
        due = [a + dt.timedelta(seconds=15 * k) for k in range(1, 41) if a + dt.timedelta(seconds=15 * k) < b]
        want += [(1, t, "stale" if k == 40 else "keep-alive") for k, t in enumerate(due, 1)]
    assert sorted(map(tuple, progress.silence_signals(rows).collect())) == sorted(want)
    last = [r for r in progress.silences(rows, str(moments[0] + dt.timedelta(seconds=601))).collect() if r["run_id"] == 2]
    assert [tuple(r) for r in last] == [(2, moments[0], 39, moments[0] + dt.timedelta(seconds=600))]


# --- the feed


@pytest.fixture
def feed():
    """A server of bars by the day that knows a start date, fails on a symbol's first request, and keeps what it was asked."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            symbol, first = q["symbol"], q["symbol"] not in {s for s, _ in asked}
            asked.append((symbol, q.get("start", "")))
            self.send_response(404 if symbol == "NONE" else 503 if first and symbol == "BUSY" else 200)
            self.end_headers()
            days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
            for k, day in enumerate(days):
                if symbol != "FLAT" and day.isoformat() < q.get("start", ""):
                    continue
                self.wfile.write((json.dumps({"dt": day.isoformat(), "open": 1, "high": 2.5, "low": None if k % 7 else 0.5, "close": len(symbol) + k, "volume": k}) + "\n\n").encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/history?symbol={{symbol}}&start={{start}}", asked
    server.shutdown()


def test_feed_is_asked_for_what_is_needed(spark, feed):
    from ledgerline.sources import feeds

    url, asked = feed
    rows = feeds.history(spark, ["AAA", "BUSY", "NONE", "FLAT", "OTHER"], url)
    assert rows.rdd.getNumPartitions() == 5
    some = rows.where((F.col("dt") > F.lit("2024-02-10").cast("date")) & (F.col("dt") >= F.lit("2024-02-01").cast("date")) & (F.col("symbol") != "OTHER") & F.col("symbol").isin("AAA", "BUSY", "NONE", "FLAT"))
    got = sorted((r["symbol"], r["dt"].isoformat(), r["close"], r["volume"]) for r in some.collect())
    assert got == sorted((s, (dt.date(2024, 1, 1) + dt.timedelta(days=k)).isoformat(), float(len(s) + k), k) for s in ("AAA", "BUSY", "FLAT") for k in range(41, 60))
    assert sorted(asked) == sorted((s, "2024-02-10") for s in ("AAA", "BUSY", "BUSY", "NONE", "FLAT"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "2024-02-01" not in plan  # the feed has taken that bound


def test_feed_without_filters(spark, feed):
    from ledgerline.sources import feeds

    url, asked = feed
    assert feeds.history(spark, ["AAA"], url).where("low IS NULL").count() == 51
    assert asked == [("AAA", "")]
    assert feeds.history(spark, []).count() == 0


def test_feed_of_series(spark, feed):
    from ledgerline.sources import feeds

    url, asked = feed
    rows = feeds.history(spark, ["AAA", "BB"], url, kind="series")
    assert rows.columns == ["series_id", "dt", "value"]
    got = rows.where("series_id = 'BB' AND dt >= DATE '2024-02-28'")
    assert [(r["series_id"], r["dt"].day, r["value"]) for r in got.orderBy("dt").collect()] == [("BB", 28, None), ("BB", 29, None)]
    assert set(asked) == {("BB", "2024-02-28")}  # the sort asks twice


# --- the sink


def test_a_replayed_epoch_writes_nothing_twice(tmp_path):
    from pyspark.sql import Row

    from ledgerline.sources import event_files

    path = str(tmp_path / "events")
    writer = event_files.EpochWriter(path)
    rows = [Row(value=f"event: e\ndata: {k}\n\n") for k in range(5)]
    read = lambda: sorted((f.parent.name, f.read_text()) for f in (tmp_path / "events").glob("epoch=*/*"))
    first, lost = writer.write(iter(rows)), writer.write(iter(rows[:2]))  # the second task is tried again, its first file is lost
    again = writer.write(iter([]))
    writer.commit([first, again, None], 0)
    once = read()
    assert once == [("epoch=0", "".join(r["value"] for r in rows))]
    writer.commit([writer.write(iter(rows))], 0)  # a replay
    assert read() == once
    writer.abort([writer.write(iter(rows))], 1)
    assert read() == once and event_files.staged(path) == [lost.name]
    writer.commit([writer.write(iter(rows[:1]))], 1)
    assert [name for name, _ in read()] == ["epoch=0", "epoch=1"]


def test_sink_of_a_stream(spark, tmp_path):
    """A query whose last commit is lost replays its epoch; each event still stands once."""
    import shutil

    from ledgerline.sources import event_files

    schema = "run_id long, step string, message string, kind string"
    source, path, state = (str(tmp_path / x) for x in ("in", "events", "state"))
    for k in range(2):
        spark.createDataFrame([(k, "a", 'say "x"', "progress"), (k, "b", "two\r\nlines", "complete"), (k, None, "", None)], schema).coalesce(1).write.mode("append").json(source)
        event_files.write_events(spark.readStream.schema(schema).json(source), path, state, trigger="availableNow").awaitTermination()
    shutil.rmtree(f"{state}/commits")
    event_files.write_events(spark.readStream.schema(schema).json(source), path, state, trigger="availableNow").awaitTermination()
    got = sorted(map(tuple, event_files.read_events(spark, path).collect()))
    want = [("complete", '{"run_id":%d,"step":"b","message":"two\\r\\nlines"}'), ("progress", '{"run_id":%d,"step":"a","message":"say \\"x\\""}'), ("", '{"run_id":%d,"message":""}')]
    assert got == sorted((k, e, d % k) for k in range(2) for e, d in want)
    assert event_files.staged(path) == []


def test_results_are_named_by_time():
    from ledgerline.sources import sinks

    assert sinks.stamped("/results/", "eval", dt.datetime(2024, 3, 5, 7, 8, 9)) == "/results/eval_20240305_070809.csv"
