"""Event streams of connections: lines cut anywhere, dispatches, keep-alives and staleness, with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.functions.text import sse_dispatch_kind
from ledgerline.operators.progress import KEEP_ALIVE_SECONDS, STALE_SECONDS

#: Blanks around a line (fixed values).
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A keep-alive's step in microseconds, and how many steps make a run stale.
STEP, MOST = KEEP_ALIVE_SECONDS * 1_000_000, STALE_SECONDS // KEEP_ALIVE_SECONDS
DISPATCHED = "conn_id long, n long, event string, data string"
SIGNALS = "run_id long, us long, signal string"


def keep_state(spark: SparkSession) -> None:
    """Chooses the state store that stateful operators need, and starts its coordinator, which batch queries need, too."""
    spark.conf.set(*STORE)
    _ = spark.streams.active


class OpenLine:
    """What a connection has said since its last whole line, and the event that the next data belongs to."""

    def __init__(self, line: str = "", event: str | None = None, n: int = 0):
        self.line, self.event, self.n = line, event, n

    def feed(self, text: str) -> Iterator[tuple[int, str | None, str]]:
        """(number, event, data) of each data line that the text completes."""
        *whole, self.line = (self.line + text).split("\n")
        for line in whole:
            line = line.strip(BLANKS)
            if line.startswith("event: "):
                self.event = line[7:].strip(BLANKS)
            elif line.startswith("data: "):
                yield self.n, self.event, line[6:]
                self.n, self.event = self.n + 1, None

    def end(self) -> Iterator[tuple[int, str | None, str]]:
        """What stands behind the last line end is handed over as it is."""
        rest, self.line = self.line.strip(BLANKS), ""
        if rest:
            yield self.n, self.event, rest
            self.n, self.event = self.n + 1, None


def row_of(conn_id: int, n: int, event: str | None, data: str) -> Row:
    return Row(conn_id=conn_id, n=n, event=event, data=data)


class Dispatcher(StatefulProcessor):
    """A connection's state: its open line and event, and fragments that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "line string, event string, n long, next long")
        self.early = handle.getMapState("early", "seq long", "text string, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else ("", None, 0, 0)
        state, turn = OpenLine(*held[:3]), held[3]
        waiting = self.early.exists()
        for row in rows:
            if row["seq"] is None or turn is None or row["seq"] < turn:
                continue  # said before, or after the end
            if row["seq"] > turn:
                if not (waiting and self.early.containsKey((row["seq"],))):
                    self.early.updateValue((row["seq"],), (row["text"], row["done"]))
                waiting = True
                continue
            text, done = row["text"], row["done"]
            while True:
                for found in state.feed(text or ""):
                    yield row_of(key[0], *found)
                turn += 1
                if done:
                    for found in state.end():
                        yield row_of(key[0], *found)
                    turn = None
                if turn is None or not (waiting and self.early.containsKey((turn,))):
                    break
                text, done = self.early.getValue((turn,))
                self.early.removeKey((turn,))
        if turn is None and waiting:
            self.early.clear()
        self.open.update((state.line, state.event, state.n, turn))

    def close(self) -> None:
        pass


def dispatches(fragments: DataFrame) -> DataFrame:
    """(conn_id, n, event, data, kind) of fragments (conn_id, seq, text, done); a stream or a table.

    Fragments are a connection's text cut anywhere, numbered from 0; done marks the last one. Lines are
    stripped; an event line names the event of the next data line, comments and other lines pass. Each
    data line is dispatched, numbered from 0, with its kind: see sse_dispatch_kind. Blank data and text
    that is neither JSON nor about an error are left out, as are fragments without conn_id or seq. A
    fragment that comes again, or after the last one, is ignored; one that comes early waits, as state,
    for those before it. A null text is empty. Of a table, fragments are sorted first, so none has to
    wait and a task holds one at a time.
    """
    keep_state(fragments.sparkSession)
    rows = fragments.where(F.col("conn_id").isNotNull()).select(F.col("conn_id").cast("long"), F.col("seq").cast("long"), "text", F.coalesce("done", F.lit(False)).alias("done"))
    if not rows.isStreaming:
        rows = rows.repartition("conn_id").sortWithinPartitions("conn_id", "seq")
    found = rows.groupBy("conn_id").transformWithState(Dispatcher(), DISPATCHED, "Append", "None")
    return found.withColumn("kind", sse_dispatch_kind(F.col("event"), F.col("data"))).where(F.col("kind").isNotNull())


class Silence(StatefulProcessor):
    """A run's state: times not yet settled, the last settled one, and how much of its silence has been told.

    Times are microseconds. They are settled in order once the watermark says that no earlier one can come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long")
        self.last = handle.getValueState("last", "us long, told int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = sorted({row["us"] for row in rows})
        self.pending.appendList([(t,) for t in times])
        self.wake(times[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        pending = sorted({t for (t,) in self.pending.get()}) if self.pending.exists() else []
        later = [t for t in pending if t > now]
        last, told = self.last.get() if self.last.exists() else (None, 0)
        for t in pending[: len(pending) - len(later)]:
            if last is not None:
                for _, at, signal in signals(last, told, t):
                    yield Row(run_id=key[0], us=at, signal=signal)
            last, told = t, 0
        self.pending.clear()
        if later:
            self.pending.put([(t,) for t in later])
            self.wake(later[0])
        if last is None:
            return
        for told, at, signal in signals(last, told, now):
            yield Row(run_id=key[0], us=at, signal=signal)
        if told < MOST:
            self.last.update((last, told))
            self.wake(last + (told + 1) * STEP + 1)
        else:
            self.last.clear()

    def wake(self, us: int) -> None:
        """Asks to be called once the watermark has reached a time."""
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def signals(last: int, told: int, until: int) -> Iterator[tuple[int, int, str]]:
    """(number, time, signal) of a silence since `last` that are due before `until` and not yet told."""
    for k in range(told + 1, MOST + 1):
        if last + k * STEP >= until:
            return
        yield k, last + k * STEP, "stale" if k == MOST else "keep-alive"


def silence_signals(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """(run_id, at, signal) of a stream of events (run_id, ts): what a silent run is told as event time goes on.

    After each KEEP_ALIVE_SECONDS without an event a run gets a keep-alive, and after STALE_SECONDS it is
    stale, once; its next event begins anew. Timers of event time fire as the watermark, `late` behind
    the newest event of all runs, passes them, so an event up to that late still counts in its place and
    a replay gives the same rows. The table version is operators.progress.silence_signals.
    """
    keep_state(rows.sparkSession)
    timed = rows.where(F.col("run_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("run_id").cast("long"), F.col("ts").cast("timestamp").alias("at"))
    found = timed.withColumn("us", F.unix_micros("at")).withWatermark("at", late).groupBy("run_id").transformWithState(Silence(), SIGNALS, "Append", "EventTime")
    return found.select("run_id", F.timestamp_micros("us").alias("at"), "signal")
