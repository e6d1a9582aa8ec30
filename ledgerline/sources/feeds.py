"""Live history feeds as a Spark source: a partition an address, the start date pushed to the request."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import date
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import LongType, StructType

from ledgerline.sources.schemas import BARS, MACRO

FORMAT = "history_feed"
#: Tries of a request, seconds before the second one (twice as many before each later one), and seconds that one may take.
TRIES, PAUSE, TIMEOUT = 4, 0.5, 30.0
FIRST_DAY = date(1, 1, 1)
#: What feeds tell: daily bars of symbols, or values of macro series. The first column names whose history it is.
KINDS = {"bars": BARS.replace(" NOT NULL", ""), "series": MACRO.replace(" NOT NULL", "")}


class Place(InputPartition):
    """One request: a symbol or series, its address and the first day asked for."""

    def __init__(self, name: str, url: str, start: date):
        self.name, self.url, self.start = name, url, start


class HistoryFeed(DataSource):
    """Histories from addresses that answer with a JSON object a line: dt and the kind's other fields.

    Option kind: one of KINDS. Option urls: a JSON object with each symbol's (or series') addresses. An
    address may have {symbol} and, where the feed takes one, {start} (a date, ISO form). A bound of dt
    from below, and a choice of symbols, go to the feed; rows before the bound are also left out here,
    for feeds that don't know it.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "bars")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return HistoryReader(json.loads(self.options["urls"]), schema)


class HistoryReader(DataSourceReader):
    def __init__(self, urls: dict[str, list[str]], schema: StructType):
        self.urls, self.start = urls, FIRST_DAY
        self.key = schema[0].name
        self.fields = [(f.name, int if isinstance(f.dataType, LongType) else float) for f in schema[2:]]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes names and the latest lower bound of dt; all others stay with Spark."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("dt",):
                self.start = max(self.start, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == ("dt",):
                self.start = max(self.start, f.value)
                yield f  # the feed's bound includes the day itself
            elif isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.urls = {s: urls for s, urls in self.urls.items() if s in wanted}
            else:
                yield f

    def partitions(self) -> list[Place]:
        return [Place(s, url, self.start) for s, urls in self.urls.items() for url in urls]

    def read(self, place: Place | None) -> Iterator[tuple]:
        if place is None:  # no address is left to ask
            return
        start = "" if place.start == FIRST_DAY else place.start.isoformat()
        for line in answer(place.url.replace("{symbol}", place.name).replace("{start}", start)):
            if not line.strip():
                continue
            told = json.loads(line)
            day = date.fromisoformat(told["dt"])
            if day >= place.start:
                yield (place.name, day, *(number(told.get(c), kind) for c, kind in self.fields))


def number(value, kind):
    return None if value is None else kind(value)


def answer(url: str) -> list[bytes]:
    """Lines of an address's answer. A busy or failing feed is asked again; one that knows no such symbol has no lines.

    The answer is read whole before any row is made, so a try that breaks off leaves nothing behind.
    """
    for k in range(TRIES):
        try:
            with urlopen(Request(url, headers={"Accept": "application/x-ndjson"}), timeout=TIMEOUT) as response:
                return response.read().splitlines()
        except HTTPError as e:
            if e.code == 404:
                return []
            if e.code not in (429, 500, 502, 503, 504) or k == TRIES - 1:
                raise
        except (URLError, ConnectionError, TimeoutError) as e:
            if isinstance(getattr(e, "reason", None), FileNotFoundError):
                return []
            if k == TRIES - 1:
                raise
        time.sleep(PAUSE * 2**k)
    return []


def history(spark: SparkSession, symbols: list[str] | dict[str, list[str]], url: str = "", kind: str = "bars") -> DataFrame:
    """Bars of symbols (or values of series) from a feed at an address with {symbol}, or from each one's own addresses.

    Filters of dt and of the names reach the feed. One task asks one address.
    """
    urls = symbols if isinstance(symbols, dict) else {s: [url] for s in symbols}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HistoryFeed)
    return spark.read.format(FORMAT).option("kind", kind).option("urls", json.dumps(urls)).load()


def archived(rows: DataFrame, path: str, kind: str = "bars") -> dict[str, list[str]]:
    """Writes histories as a feed's answers, by symbol or series; returns the addresses of each."""
    key = StructType.fromDDL(KINDS[kind])[0].name
    rows.repartition(key).write.partitionBy(key).json(path)
    files = rows.sparkSession.read.option("basePath", path).json(path, schema=KINDS[kind]).select(key, F.input_file_name().alias("file")).distinct()
    out: dict[str, list[str]] = {}
    for name, file in sorted(map(tuple, files.collect())):
        out.setdefault(name, []).append(file)
    return out
