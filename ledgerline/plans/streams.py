"""Queries over event streams, each with its DuckDB SQL; they join those of ledgerline.plans.parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import macro, progress
from ledgerline.plans.oracle import BARS, MACRO
from ledgerline.plans.parts import query
from ledgerline.sources import feeds, scratch
from ledgerline.sources import tables as T
from ledgerline.streaming import event_stream

BLANK = r"[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conn_id, wire): a conversation as the event stream that would tell of it.

    A turn is an event line (not for each fifth), a data line and an empty one, and a comment follows
    each third turn. The data is JSON that names a step, text that is none, or a result, by turn.
    Every third connection ends without a line end.
    """
    n = F.col("turn").cast("string")
    event = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit("event: "), F.when(F.col("turn") % 7 == 6, "done").when(F.col("turn") % 3 == 2, "complete").otherwise("progress"), F.lit(" \r\n")))
    told = F.concat(F.lit('{"step":"'), F.col("role"), F.lit('","message":"'), F.md5("text"), F.lit('"}'))
    data = F.when(F.col("conv_id") % 4 == 1, F.when(F.col("turn") % 2 == 0, F.concat(F.lit("an Error in turn "), n)).otherwise("no json")).when(F.col("turn") % 9 == 8, '{"status":"error"}').when(F.col("turn") % 5 == 4, F.concat(F.lit('{"status":"success","data":{"n":'), n, F.lit("}}"))).otherwise(told)
    comment = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(": keep-alive "), n, F.lit("\n\n"))).otherwise("")
    said = F.concat(event, F.lit("data: "), data, F.lit("\n\n"), comment)
    rows = T.scan(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("all"))
    wire = F.array_join(F.transform("all", lambda x: x["said"]), "")
    return rows.select(F.col("conv_id").alias("conn_id"), F.when(F.col("conv_id") % 3 == 0, F.regexp_replace(wire, r"\n+$", "")).otherwise(wire).alias("wire"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conn_id, seq, text, done): the wires cut anywhere, into pieces of 5 to 41 characters."""
    size = (F.col("conn_id") % 37 + 5).cast("int")
    pieces = F.regexp_extract_all("wire", F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    rows = wires(spark, sf_dir).select("conn_id", F.posexplode(pieces).alias("seq", "text"), F.ceil(F.length("wire") / size).alias("n"))
    return rows.select("conn_id", F.col("seq").cast("long").alias("seq"), "text", (F.col("seq") == F.col("n") - 1).alias("done"))


WIRES = """
said AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE 'event: ' || CASE WHEN turn % 7 = 6 THEN 'done' WHEN turn % 3 = 2 THEN 'complete' ELSE 'progress' END || ' ' || chr(13) || chr(10) END || 'data: '
  || CASE WHEN conv_id % 4 = 1 THEN CASE WHEN turn % 2 = 0 THEN 'an Error in turn ' || turn ELSE 'no json' END WHEN turn % 9 = 8 THEN '{"status":"error"}' WHEN turn % 5 = 4 THEN '{"status":"success","data":{"n":' || turn || '}}'
    ELSE '{"step":"' || role || '","message":"' || md5(text) || '"}' END || chr(10) || chr(10) || CASE WHEN turn % 3 = 0 THEN ': keep-alive ' || turn || chr(10) || chr(10) ELSE '' END AS said FROM conversations),
joined AS (SELECT conv_id AS conn_id, string_agg(said, '' ORDER BY turn) AS wire FROM said GROUP BY 1),
wires AS (SELECT conn_id, CASE WHEN conn_id % 3 = 0 THEN rtrim(wire, chr(10)) ELSE wire END AS wire FROM joined)"""


@query(f"""WITH {WIRES}, pieces AS (SELECT conn_id, string_split(wire, chr(10)) AS l FROM wires), lines AS (SELECT conn_id, unnest(range(1, len(l) + 1)) AS i, len(l) AS n, l FROM pieces),
trimmed AS (SELECT conn_id, i, i = n AS rest, regexp_replace(l[i], '^{BLANK}+|{BLANK}+$', '', 'g') AS line FROM lines),
sorted AS (SELECT *, CASE WHEN rest THEN line <> '' ELSE starts_with(line, 'data: ') END AS is_data, NOT rest AND starts_with(line, 'event: ') AS is_event FROM trimmed),
placed AS (SELECT *, max(CASE WHEN is_event THEN i END) OVER w AS event_at, coalesce(max(CASE WHEN is_data THEN i END) OVER w, 0) AS data_at FROM sorted WINDOW w AS (PARTITION BY conn_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
told AS (SELECT p.conn_id, p.i, CASE WHEN p.event_at > p.data_at THEN regexp_replace(substring(e.line, 8), '^{BLANK}+', '') END AS event, CASE WHEN p.rest THEN p.line ELSE substring(p.line, 7) END AS data FROM placed p LEFT JOIN trimmed e ON e.conn_id = p.conn_id AND e.i = p.event_at WHERE p.is_data),
numbered AS (SELECT conn_id, row_number() OVER (PARTITION BY conn_id ORDER BY i) - 1 AS n, event, data, CASE WHEN json_valid(data) THEN CAST(data AS JSON) END AS j FROM told),
kinds AS (SELECT conn_id, n, event, data, CASE WHEN j IS NULL THEN CASE WHEN regexp_matches(data, '[eE]rror') THEN 'error' END WHEN event = 'error' OR j->>'status' = 'error' THEN 'error' WHEN event = 'complete' OR j->>'status' = 'success' AND coalesce(j->>'data', '') NOT IN ('', '0', 'false') THEN 'complete'
  WHEN event = 'progress' OR coalesce(j->>'step', '') <> '' OR coalesce(j->>'message', '') <> '' THEN 'progress' ELSE 'unknown' END AS kind FROM numbered)
SELECT * FROM kinds WHERE kind IS NOT NULL""")
def sse_dispatch(spark, d):
    """The stateful parser over cut fragments, against SQL over the whole texts."""
    return event_stream.dispatches(fragments(spark, d))


SILENCES = """g AS (SELECT user_id AS run_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS from_ts, ts AS to_ts FROM events),
due AS (SELECT run_id, from_ts, least(40, (epoch_us(to_ts) - epoch_us(from_ts) - 1) // 15000000) AS due FROM g WHERE from_ts IS NOT NULL AND epoch_us(to_ts) > epoch_us(from_ts))"""


@query(f"WITH {SILENCES} SELECT run_id, from_ts, CAST(least(due, 39) AS INTEGER) AS keep_alives, CASE WHEN due = 40 THEN from_ts + INTERVAL 600 SECOND END AS stale_at FROM due WHERE due > 0")
def silences(spark, d):
    return progress.silences(T.scan(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts"))


@query(f"WITH {BARS} SELECT * FROM bars WHERE dt >= DATE '1997-06-30' - INTERVAL 6 MONTH")
def bars_feed(spark, d):
    """A feed that answers with the bars of each symbol, asked for six months of them."""
    urls = feeds.archived(T.bars(spark, d), f"{scratch.scratch_dir(spark)}/ledgerline/feed-{uuid.uuid4().hex}")
    return feeds.history(spark, urls).where(F.col("dt") >= T.since("1997-06-30", "6mo"))


@query(f"WITH {MACRO.replace('FROM lineitem GROUP BY 1)', "FROM lineitem WHERE l_shipdate >= DATE '1996-03-01' GROUP BY 1)", 1)} SELECT 'rate' AS series_id, round(last, 6) AS last, round(reference, 6) AS reference, trend FROM rate_row")
def rates_feed(spark, d):
    """The trend of a rate from a feed of series, asked for its values from a day on."""
    urls = feeds.archived(T.macro(spark, d), f"{scratch.scratch_dir(spark)}/ledgerline/feed-{uuid.uuid4().hex}", "series")
    trend = macro.rate_trend(feeds.history(spark, urls, kind="series").where(F.col("dt") >= F.lit("1996-03-01").cast("date")))
    return trend.withColumns({c: F.round(c, 6) for c in ("last", "reference")})
