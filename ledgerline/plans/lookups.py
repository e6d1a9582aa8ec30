"""Queries for document retrieval and labels, each with its DuckDB SQL."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.functions import formats
from ledgerline.operators import catalog, macro
from ledgerline.plans import retrieval
from ledgerline.plans.oracle import chunk_ctes, section_ctes
from ledgerline.plans.parts import query
from ledgerline.sources import scratch
from ledgerline.sources import tables as T

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Funds by part size, in the order of their symbols.
FUNDS = sorted(macro.SECTOR_FUNDS)


def letter_counts(texts: pd.Series) -> pd.Series:
    """A model that SQL can say, too: how often each letter occurs, and a number from the text's hash, so that texts of the same letters differ."""

    def one(text: str) -> list[float]:
        lower = text.lower()
        return [*(float(lower.count(c)) for c in LETTERS), int(hashlib.md5(text.encode()).hexdigest()[:3], 16) / 64]

    return texts.map(one)


def _counts(text: str) -> str:
    letters = [f"length({text}) - length(replace(lower({text}), '{c}', ''))" for c in LETTERS]
    return "[" + ", ".join([*letters, f"CAST('0x' || substring(md5({text}), 1, 3) AS INTEGER) / 64.0"]) + "]::DOUBLE[]"


def _context(part: str) -> str:
    joined = f"(SELECT string_agg(chunk, chr(10) || chr(10) ORDER BY rank) FROM best b WHERE b.symbol = r.symbol AND b.section = '{part}')"
    return f"md5((SELECT CASE WHEN length(t) > 3000 THEN left(t, 3000) || chr(10) || '...[truncated]' ELSE coalesce(t, 'Not available') END FROM (SELECT {joined} AS t)))"


def _number(part: str) -> str:
    return f"CAST((SELECT count(*) FROM best b WHERE b.symbol = r.symbol AND b.section = '{part}') AS INTEGER)"


@query(f"""WITH RECURSIVE english AS (SELECT * FROM documents WHERE lang = 'en'), {section_ctes("english")},
base AS (SELECT doc_id, section, body AS text FROM cut UNION ALL SELECT doc_id, 'upload', text FROM documents WHERE lang <> 'en'), {chunk_ctes("base", "doc_id, section")},
v AS (SELECT upper(source) AS symbol, section, chunk, {_counts("chunk")} AS e FROM k JOIN documents USING (doc_id)),
r AS (SELECT DISTINCT source AS analysis_id, upper(source) AS symbol FROM documents),
asked AS (SELECT symbol, section, replace(question, '{{}}', symbol) AS q FROM r, (VALUES ('risk_factors', 'What are the key risk factors for {{}}?'), ('mda', 'What is the management discussion and outlook for {{}}?'), ('upload', 'Summarize important fundamental and risk insights for {{}}')) w(section, question)),
u AS (SELECT *, {_counts("q")} AS f FROM asked),
scored AS (SELECT symbol, section, chunk, row_number() OVER (PARTITION BY symbol, section ORDER BY list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)) DESC) AS rank FROM u JOIN v USING (symbol, section)),
best AS (SELECT * FROM scored WHERE rank <= 3)
SELECT analysis_id, symbol, {_context("risk_factors")} AS risk_digest, {_context("mda")} AS mda_digest, {_context("upload")} AS uploaded_digest, {_number("risk_factors")} AS num_risk_chunks, {_number("mda")} AS num_mda_chunks, {_number("upload")} AS num_uploaded_chunks,
  {_number("risk_factors")} + {_number("mda")} > 0 AS dated, EXISTS (SELECT 1 FROM best b WHERE b.symbol = r.symbol) AS available,
  array_to_string(list_filter([(SELECT 'sec_filing:' || count(*) FROM v WHERE v.symbol = r.symbol AND section <> 'upload' HAVING count(*) > 0), (SELECT 'user_pdf:' || count(*) FROM v WHERE v.symbol = r.symbol AND section = 'upload' HAVING count(*) > 0)], lambda x: x IS NOT NULL), ',') AS sources FROM r""")
def document_retrieval(spark, d):
    """What each source's report is told: English documents are filings, all others are uploads."""
    docs = T.scan(spark, d, "documents")
    english = T.filing_texts(docs.where(F.col("lang") == "en")).select(F.col("source").alias("symbol"), F.date_add(F.to_date(F.lit("2000-01-01")), F.col("doc_id").cast("int")).cast("string").alias("filing_date"), "text")
    filed = scratch.written(retrieval.filing_chunks(english, letter_counts), "filed")
    others = docs.where(F.col("lang") != "en").select(F.col("source").alias("analysis_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("symbol"), F.col("doc_id").cast("string").alias("filename"), "text")
    requests = docs.select(F.col("source").alias("analysis_id"), F.col("source").alias("symbol")).distinct()
    uploaded = scratch.written(retrieval.user_chunks(others, letter_counts), "uploaded")
    found = retrieval.retrieve(requests, filed, uploaded, model=letter_counts)
    sources = F.array_join(F.transform("document_sources", lambda x: F.concat_ws(":", x["source_type"], x["chunks"].cast("string"))), ",")
    return found.select("analysis_id", "symbol", *(F.md5(f"{n}_context").alias(f"{n}_digest") for n in ("risk", "mda", "uploaded")), "num_risk_chunks", "num_mda_chunks", "num_uploaded_chunks", (F.col("filing_date") != "").alias("dated"), "available", sources.alias("sources"))


_FUND_LIST = "[" + ", ".join(f"'{f}'" for f in FUNDS) + "]"
_SECTOR_MAP = "MAP {" + ", ".join(f"'{f}': '{s}'" for f, s in macro.SECTOR_FUNDS.items()) + "}"


@query(f"""WITH months AS (SELECT {_FUND_LIST}[p_size % 11 + 1] AS fund, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, avg(l_extendedprice) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
returns AS (SELECT fund, round((arg_max(close, dt) - arg_min(close, dt)) / arg_min(close, dt) * 100, 2) AS return_pct FROM months GROUP BY 1 HAVING count(*) >= 2) SELECT fund, map_extract({_SECTOR_MAP}, fund)[1] AS sector, return_pct FROM returns""")
def sector_funds(spark, d):
    """Returns of sector funds, by part size, with the sector of each."""
    items = T.scan(spark, d, "lineitem").select("l_partkey", "l_extendedprice", F.to_date(F.date_trunc("month", "l_shipdate")).alias("dt"))
    fund = F.element_at(F.array(*map(F.lit, FUNDS)), (F.col("p_size") % 11 + 1).cast("int"))
    parts = T.scan(spark, d, "part").select("p_partkey", fund.alias("sector"))
    prices = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("sector", "dt").agg(F.avg("l_extendedprice").alias("close"))
    return macro.named_sectors(macro.sector_performance(prices).withColumnRenamed("sector", "fund")).select("fund", "sector", "return_pct")


@query("""SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN '/api/documents/' || replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') || '/pdf' END AS file_url FROM pages""")
def file_urls(spark, d):
    """Addresses of stored files whose ids are pages' own addresses; every fourth has no file."""
    pages = T.scan(spark, d, "pages").select("page_id", F.col("url").alias("id"))
    return pages.select("page_id", F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("/api/documents/"), catalog.url_part(F.col("id")), F.lit("/pdf"))).alias("file_url"))


@query("""SELECT event_id, CASE WHEN contains(s, 'error') THEN 'danger' WHEN contains(s, 'ok') OR contains(s, 'complete') THEN 'success' WHEN regexp_matches(s, 'market|macro|risk|scenario|memo') THEN 'info' ELSE 'secondary' END AS step_kind,
CASE r WHEN 'Buy' THEN 'success' WHEN 'Sell' THEN 'danger' ELSE 'warning' END AS recommendation_kind, CASE n WHEN 'bull' THEN 'success' WHEN 'base' THEN 'info' WHEN 'bear' THEN 'danger' ELSE 'secondary' END AS scenario_kind
FROM (SELECT event_id, lower(event_type || ' ' || ['Market Agent', 'OK', 'Completed memo', 'plain', 'Risk'][event_id % 5 + 1]) AS s, ['Buy', 'Sell', 'Hold', 'N/A'][event_id % 4 + 1] AS r, ['bull', 'base', 'bear', 'odd'][event_id % 4 + 1] AS n FROM events)""")
def variant_labels(spark, d):
    """Categories that steps, recommendations and scenarios are shown by."""
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % len(words) + 1).cast("int"))
    step = F.concat_ws(" ", "event_type", pick("Market Agent", "OK", "Completed memo", "plain", "Risk"))
    return T.scan(spark, d, "events").select(
        "event_id", formats.step_kind(step).alias("step_kind"), formats.variant(pick("Buy", "Sell", "Hold", "N/A"), formats.RECOMMENDATION_KINDS, "warning").alias("recommendation_kind"),
        formats.variant(pick("bull", "base", "bear", "odd"), formats.SCENARIO_KINDS, "secondary").alias("scenario_kind"),
    )
