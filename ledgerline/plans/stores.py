"""Queries over keyed tables, approximate search and company names, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.operators import ivf, resolve, vectors
from ledgerline.plans.parts import QUERIES, query
from ledgerline.sources import scratch
from ledgerline.sources import tables as T
from ledgerline.sources.keyed_tables import KeyedTable

#: Queries without SQL; tests hold them against the exact ones.
WITHOUT_SQL = ("vector_topk_ivf",)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F' DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM r WHERE rn = 1 AND o_custkey % 10 <> 7""")
def keyed_upsert(spark, d):
    """A stored table of each customer's latest order: written, updated, and customers taken out."""
    orders = T.scan(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    schema = ", ".join(f"{name} {kind}" for name, kind in orders.dtypes)
    table = KeyedTable(spark, f"{scratch.scratch_dir(spark)}/ledgerline/latest-{uuid.uuid4().hex}", schema, ["o_custkey"], 16)
    for some in (orders.where(F.col("o_orderstatus") == "F"), orders.where(F.col("o_orderstatus") != "F")):
        table.upsert(some, ["o_orderdate", "o_orderkey"])
    table.delete(orders.where(F.col("o_custkey") % 10 == 7).select("o_custkey"))
    return table.read()


def sides(spark, d):
    rows = T.scan(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("section"))
    return rows.where(F.col("id") % 20 == 0), rows


def vector_topk_ivf(spark, d):
    """Ten nearest rows of a query's label, by inverted cells and product quantisation."""
    return ivf.approximate_top_k(*sides(spark, d), 10)


QUERIES["vector_topk_ivf"] = vector_topk_ivf


@query("""WITH q AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 20 = 0 AND vec_id IS NOT NULL),
n AS (SELECT q.vec_id, least(10, count(d.vec_id)) AS n FROM q JOIN embeddings d ON d.label = q.label AND d.vec_id <> q.vec_id GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS wanted, true AS recalled FROM n""")
def ivf_recall(spark, d):
    """How many neighbours the exact search finds, and whether the approximate one finds 95 in a hundred of them."""
    exact = vectors.cosine_top_k(*sides(spark, d), 10).select("query_id", "id")
    found = vector_topk_ivf(spark, d).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.95 * F.count("*")).alias("recalled"))


@query(r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS name FROM benchmark), companies AS (SELECT md5(name) AS ord, name, upper(left(md5(name), 6)) AS code FROM words),
q AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM conversations),
m AS (SELECT conv_id, turn, arg_min(code, (lower(s) <> name, ord)) AS code FROM q JOIN companies ON contains(lower(s), name) GROUP BY 1, 2),
r AS (SELECT q.conv_id, q.turn, s, code, CASE WHEN coalesce(s, '') = '' THEN 'empty' WHEN regexp_matches(upper(s), '^[A-Z]{1,5}(-[A-Z]{1,2})?$') THEN 'symbol' WHEN code IS NOT NULL THEN 'company' ELSE 'model' END AS route FROM q LEFT JOIN m USING (conv_id, turn))
SELECT conv_id, turn, CASE route WHEN 'symbol' THEN upper(s) WHEN 'company' THEN code END AS symbol, route FROM r""")
def resolve_companies(spark, d):
    """Turns of conversations as queries, against a table of names: the words of the benchmark texts."""
    words = T.scan(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("name")).distinct()
    companies = words.select(F.md5("name").alias("ord"), "name", F.upper(F.left(F.md5("name"), F.lit(6))).alias("symbol"))
    asked = T.scan(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return resolve.resolve(asked, companies=companies).select("conv_id", "turn", "symbol", "route")
