"""Queries over sinks, uploads, embedding and model fallback, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.operators import catalog, model_steps, vectors
from ledgerline.plans.lookups import LETTERS, letter_counts
from ledgerline.plans.parts import query
from ledgerline.sources import filings, scratch, sinks
from ledgerline.sources import tables as T

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def place(spark, name: str) -> str:
    return f"{scratch.scratch_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


def orders(spark, d):
    return T.scan(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def appended_rows(spark, d):
    """A table that grew by three appends, one of them repeated."""
    path, rows = place(spark, "appended"), orders(spark, d)
    for status in ("F", "O", "O"):
        sinks.append(rows.where(F.col("o_orderstatus") == status), path)
    return sinks.read(spark, path, ORDERS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip(spark, d):
    """Results written as CSV and read again."""
    path = place(spark, "results")
    sinks.csv_results(orders(spark, d), path)
    return spark.read.csv(path, schema=ORDERS, header=True)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def json_round_trip(spark, d):
    """A JSON table that is replaced by other rows; each row is also one JSON text."""
    path, rows = place(spark, "json"), orders(spark, d)
    sinks.json_results(rows, path)
    sinks.json_results(rows.where(F.col("o_orderstatus") != "F"), path)
    texts = sinks.json_column(spark.read.json(path, schema=ORDERS))
    return texts.select(F.from_json("json", ORDERS).alias("r")).select("r.*")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'x' || o_custkey AS object_id, o_totalprice AS score FROM orders WHERE o_orderkey = 10 OR o_custkey = 10")
def by_any_id(spark, d):
    """Rows whose id or object id is asked for."""
    rows = T.scan(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("x"), "o_custkey").alias("object_id"), F.col("o_totalprice").alias("score"))
    return catalog.by_any_id(rows, "10").unionByName(catalog.by_any_id(rows, "x10")).distinct()


@query(r"SELECT event_id, epoch_us(ts) // 1000 || '-' || regexp_replace(event_type || ' №' || props || '.pdf', '[^a-zA-Z0-9._-]', '_', 'g') AS stored FROM events")
def stored_names(spark, d):
    """Names under which uploads are stored."""
    name = F.concat(F.col("event_type"), F.lit(" №"), F.col("props"), F.lit(".pdf"))
    return T.scan(spark, d, "events").select("event_id", T.stored_name(name, F.col("ts").cast("timestamp")).alias("stored"))


def pages_of(content: bytes) -> list[str]:
    """A reader whose pages are lines."""
    return content.decode().split("\n")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, array_to_string(l, chr(10) || chr(10)) AS t FROM p)""")
def pdf_pages(spark, d):
    """Texts of files by a reader that gives pages: stripped, blank ones dropped, a blank line between."""
    files = T.scan(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return filings.pdf_texts(files, pages_of).select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("SELECT doc_id, " + ", ".join(f"CAST(length(t) - length(replace(lower(t), '{c}', '')) AS INTEGER) AS n_{c}" for c in "aeiot") + " FROM (SELECT doc_id, left(coalesce(text, ''), 4096) AS t FROM documents)")
def embedded_texts(spark, d):
    """Vectors of a model that sees the first 4,096 characters, its input limit."""
    rows = vectors.embed(T.scan(spark, d, "documents").select("doc_id", "text"), "text", letter_counts)
    return rows.select("doc_id", *(F.col("embedding")[LETTERS.index(c)].cast("int").alias(f"n_{c}") for c in "aeiot"))


def third(prompts: pd.Series) -> pd.DataFrame:
    """Answers every third prompt length, is too busy for even ones and refuses the others."""
    n = prompts.str.len()
    return pd.DataFrame({"answer": ("third:" + prompts).where(n % 3 == 0), "status": (n % 2 == 0).map({True: 429, False: 403})})


def fourth(prompts: pd.Series) -> pd.Series:
    return ("fourth:" + prompts).where(prompts.str.len() % 4 == 0)


@query("""SELECT p_partkey, CASE WHEN length(p_name) % 3 = 0 THEN 'third:' || p_name WHEN length(p_name) % 4 = 0 THEN 'fourth:' || p_name END AS answer,
CASE WHEN length(p_name) % 3 = 0 OR length(p_name) % 4 = 0 THEN 'done' WHEN length(p_name) % 2 = 1 THEN 'stopped' ELSE 'failed' END AS outcome FROM part""")
def model_fallback(spark, d):
    """A second model is asked only what the first was too busy for."""
    rows = T.scan(spark, d, "part").select("p_partkey", "p_name")
    return model_steps.with_fallback(rows, "p_name", [third, fourth]).select("p_partkey", "answer", F.col("answer_outcome").alias("outcome"))


@query("""WITH c AS (SELECT event_type AS category, list({'q': 'Query ' || event_id || '?', 't': CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'T' || event_id % 7 END} ORDER BY event_id) AS l FROM events GROUP BY 1),
p AS (SELECT category, l, coalesce(sum(len(l)) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), u AS (SELECT category, before, l, unnest(range(1, len(l) + 1)) AS i FROM p)
SELECT CAST(100 + before + i - 1 AS BIGINT) AS id, l[i].q AS query, category AS intent, l[i].t AS expected_symbol, 'simple' AS complexity, 'llm_generated' AS source, false AS human_verified FROM u""")
def generated_queries(spark, d):
    """Drafts of annotated queries from a model's JSON lists, one a category, in a fence."""
    item = F.struct(F.concat(F.lit("Query "), "event_id", F.lit("?")).alias("query"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("T"), F.col("event_id") % 7)).alias("expected_ticker"))
    lists = T.scan(spark, d, "events").select(F.col("event_type").alias("category"), F.struct("event_id", item.alias("item")).alias("x")).groupBy("category").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    return model_steps.generated_queries(lists.select("category", F.concat(F.lit("```json\n"), F.to_json("items"), F.lit("\n```")).alias("answer")))
