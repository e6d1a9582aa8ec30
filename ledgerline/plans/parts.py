"""Queries for single functions and smaller operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import formats
from ledgerline.functions import text as X
from ledgerline.operators import catalog, documents, model_steps, prompts, resolve, risk, telemetry
from ledgerline.plans.oracle import BARS, CALLS, CHUNKS, REGISTRY, RISK
from ledgerline.sources import filings
from ledgerline.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def text(c):
    return F.col(c).cast("string")


@query(f"WITH {BARS}, {RISK} SELECT symbol, round(covar_samp(sr, br) / var_samp(br), 6) AS beta FROM pairs WHERE sr IS NOT NULL AND br IS NOT NULL GROUP BY 1")
def textbook_beta(spark, d):
    return risk.beta(T.bars(spark, d), T.benchmark(spark, d), textbook=True).withColumn("beta", F.round("beta", 6))


@query("SELECT c_custkey, lower(n_name) AS symbol, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik FROM customer JOIN nation ON c_nationkey = n_nationkey")
def cik_lookup(spark, d):
    nation = T.scan(spark, d, "nation")
    symbols = T.scan(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("symbol"))
    return filings.company_numbers(symbols, nation.select(F.col("n_name").alias("ticker"), F.col("n_nationkey").cast("long").alias("cik_str")))


@query("""SELECT p_partkey AS symbol, CAST(k AS INTEGER) AS rank, CASE WHEN k = 1 THEN 'https://www.sec.gov/a/' || p_partkey ELSE 'https://other/' || p_size END AS url, '2024-01-0' || k AS filing_date, p_brand AS accession_number
FROM part, (VALUES (1), (2)) v(k)""")
def filing_search(spark, d):
    one = lambda day, url: F.concat(F.lit('{"_source": {"file_date": "2024-01-0' + day + '", "file_num": "'), F.col("p_brand"), F.lit('", "file_url": "'), url, F.lit('"}}'))
    hits = F.concat_ws(", ", one("1", F.concat(F.lit("/a/"), text("p_partkey"))), one("2", F.concat(F.lit("https://other/"), text("p_size"))), one("3", F.lit("x")))
    return filings.search_results(T.scan(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.concat(F.lit('{"hits": {"hits": ['), hits, F.lit("]}}")).alias("body")), 2)


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'event' WHEN 'click' THEN 'data' WHEN 'error' THEN 'comment' WHEN 'signup' THEN 'dispatch' ELSE 'other' END AS kind FROM events""")
def sse_lines(spark, d):
    kind = F.col("event_type")
    line = F.when(kind == "view", "event: progress").when(kind == "click", F.concat(F.lit("data: "), F.col("props"))).when(kind == "error", ": keep-alive").when(kind == "signup", " ").otherwise("id: 1")
    return T.scan(spark, d, "events").select("event_id", X.sse_kind(line).alias("kind"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 1000 THEN printf('$%.2fB', round(c_acctbal * 1000) / 1000000) WHEN c_acctbal >= 1 THEN printf('$%.2fM', c_acctbal) ELSE '$' || format('{:,.2f}', c_acctbal * 1000000) END AS magnitude, printf('%.2f%%', CAST(c_nationkey AS DOUBLE)) AS percent,
printf('%+.0f%%', CAST(c_nationkey - 10 AS DOUBLE)) AS signed, CASE WHEN c_nationkey * 7 >= 60 THEN printf('%dm %.1fs', (c_nationkey * 7) // 60, CAST((c_nationkey * 7) % 60 AS DOUBLE)) ELSE printf('%.1fs', CAST(c_nationkey * 7 AS DOUBLE)) END AS duration,
CASE c_nationkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'danger' WHEN 2 THEN 'warning' ELSE 'secondary' END AS variant FROM customer""")
def number_formats(spark, d):
    rows = T.scan(spark, d, "customer")
    n, balance = F.col("c_nationkey"), F.col("c_acctbal")
    worth = F.when(balance >= 1000, F.round(balance * 1000) * 1000).otherwise(balance * 1000000)
    label = F.element_at(F.array(*map(F.lit, ("Buy", "Sell", "Hold", "Odd"))), n % 4 + 1)
    whole = (n * 7).cast("double")
    return rows.select("c_custkey", formats.magnitude(worth).alias("magnitude"), formats.ratio_percent(n / 100).alias("percent"), formats.signed_percent((n - 10) / 100).alias("signed"), formats.duration(whole).alias("duration"), formats.variant(label, formats.RECOMMENDATION_KINDS, "secondary").alias("variant"))


@query("""WITH a AS (SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS m, ['widget', 'red', 'anvil', 'none'] AS w FROM part)
SELECT p_partkey, array_to_string(list_concat(list_filter(w, lambda x: list_contains(m, x)), list_filter(m, lambda x: NOT list_contains(w, x))), ',') AS models FROM a""")
def preferred_models(spark, d):
    have = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)))
    want = F.array(*map(F.lit, ("widget", "red", "anvil", "none")))
    return T.scan(spark, d, "part").select("p_partkey", F.array_join(model_steps.preferred_order(have, want), ",").alias("models"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 'small' ELSE 'main' END AS model, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'next' WHEN 2 THEN 'stop' ELSE 'next' END AS failover FROM events""")
def model_routing(spark, d):
    agent = F.when(F.col("event_type") == "view", "Macro_Trends").when(F.col("event_type") == "error", "news SENTIMENT").otherwise(F.col("event_type"))
    status = F.element_at(F.array(*map(F.lit, (200, 429, 403, 500))), (F.col("event_id") % 4 + 1).cast("int"))
    return T.scan(spark, d, "events").select("event_id", model_steps.model_for(agent).alias("model"), model_steps.failover(status).alias("failover"))


@query("""SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'Missing required fields' WHEN 1 THEN 'Invalid horizon' WHEN 2 THEN 'Invalid risk profile' END AS error FROM customer""")
def validate_requests(spark, d):
    k = F.col("c_nationkey") % 5
    rows = T.scan(spark, d, "customer").select("c_custkey", F.when(k != 0, F.col("c_mktsegment")).alias("symbol"), F.when(k == 1, "weekly").otherwise("short").alias("horizon"), F.when(k == 2, "wild").otherwise("moderate").alias("risk_profile"))
    return resolve.validated(rows).select("c_custkey", "error")


@query(f"""WITH {REGISTRY}, o AS (SELECT id, updated_at AS created_at, title, filename FROM registry WHERE source_type = 'sec_filing' OR id % 3 = 0),
n AS (SELECT id, DATE '2024-02-01' AS created_at, CASE WHEN chunks > 1000 THEN filename END AS title FROM registry WHERE source_type = 'user_pdf')
SELECT coalesce(o.id, n.id) AS id, least(o.created_at, n.created_at) AS created_at, coalesce(n.title, o.title) AS title, o.filename FROM o FULL JOIN n ON o.id = n.id""")
def registry_merge(spark, d):
    rows = T.registry(spark, d)
    old = rows.where((F.col("source_type") == "sec_filing") | (F.col("id") % 3 == 0)).select("id", F.col("updated_at").alias("created_at"), "title", "filename")
    new = rows.where(F.col("source_type") == "user_pdf").select("id", F.to_date(F.lit("2024-02-01")).alias("created_at"), F.when(F.col("chunks") > 1000, F.col("filename")).alias("title"))
    return documents.merge_registry(old, new)


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, md5(source || '_' || doc_id || '_' || chunk_index) AS chunk_id FROM chunks")
def user_chunk_ids(spark, d):
    rows = documents.chunk_rows(T.scan(spark, d, "documents").select("doc_id", "source", "text"), documents.fixed_chunks(F.col("text")))
    return rows.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), documents.user_chunk_id(F.col("source"), text("doc_id"), F.col("chunk_index")).alias("chunk_id"))


@query("SELECT doc_id, md5('user_pdf:' || upper(source) || ':' || CASE WHEN doc_id % 2 = 0 THEN lang || '.pdf' ELSE 'unknown' END) AS registry_id FROM documents")
def registry_ids(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(".pdf"))).otherwise("")
    none = F.lit(None).cast("string")
    return T.scan(spark, d, "documents").select("doc_id", documents.registry_id(F.lit("user_pdf"), F.col("source"), none, name, none).alias("registry_id"))


@query("SELECT p_name AS name, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY lpad(CAST(p_size AS VARCHAR), 5, '0')) AS versions FROM (SELECT DISTINCT p_name, p_size FROM part) GROUP BY 1".replace("DISTINCT CAST", "CAST"))
def prompt_versions(spark, d):
    rows = prompts.versions(T.scan(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("version")))
    return rows.select("name", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions"))


@query(f"WITH {CALLS} SELECT analysis_id, string_agg(ts || ':' || model || ':' || total_tokens, ' ' ORDER BY ts) AS calls FROM costs GROUP BY 1")
def telemetry_calls(spark, d):
    rows = telemetry.calls_in_order(T.llm_calls(spark, d))
    one = lambda c: F.concat_ws(":", c["ts"].cast("string"), c["model"], c["total_tokens"].cast("string"))
    return rows.select("analysis_id", F.array_join(F.transform("calls", one), " ").alias("calls"))


@query(f"WITH {REGISTRY} SELECT id, symbol, source_type = 'user_pdf' AS has_pdf, true AS has_text_preview FROM registry WHERE id = 10")
def document_detail(spark, d):
    rows = T.registry(spark, d).withColumn("source_url", F.lit(None).cast("string"))
    previews = T.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(100)).alias("preview_text"))
    return catalog.document_detail(rows, previews, 10).select("id", "symbol", "has_pdf", "has_text_preview")


@query(f"WITH {REGISTRY} SELECT c_custkey AS analysis_id, id, filename FROM customer JOIN registry ON analysis_id = c_custkey")
def analysis_documents(spark, d):
    analyses = T.scan(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return catalog.analysis_documents(analyses, T.registry(spark, d)).select("analysis_id", "id", "filename")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE CAST(user_id % 6 AS INTEGER) END AS relevance_score, CASE WHEN event_type = 'view' THEN 0 ELSE 3 END AS accuracy_score,
CASE WHEN event_type = 'click' THEN 'comparison' ELSE 'stock_analysis' END AS intent, CASE WHEN event_type = 'click' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN event_type = 'click' THEN 'ABC' END AS symbol FROM events""")
def answer_parsing(spark, d):
    kind = F.col("event_type")
    judge = F.when(kind == "view", "no json").otherwise(F.concat(F.lit('```json\n{"relevance_score": '), (F.col("user_id") % 6).cast("string"), F.lit(', "accuracy_score": 3}\n```')))
    intent = F.when(kind == "click", '{"intent": "comparison", "confidence": 0.8, "ticker": "abc"}').otherwise('{"intent": "weather", "ticker": "too long"}')
    rows = T.scan(spark, d, "events").select("event_id", model_steps.judged(judge).alias("j"), model_steps.intent(intent).alias("i"), model_steps.resolved_query(intent).alias("q"))
    return rows.select("event_id", "j.relevance_score", "j.accuracy_score", "i.intent", "i.confidence", "q.symbol")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'Unable to identify risks' ELSE 'r1|r' || user_id || '|r3|r4|r5' END AS risks FROM events""")
def key_risks(spark, d):
    listed = F.concat(F.lit('```\n{"risks": ["r1", "r'), text("user_id"), F.lit('", "r3", "r4", "r5", "r6"]}\n```'))
    answer = F.when(F.col("event_type") == "view", "sorry").otherwise(listed)
    return T.scan(spark, d, "events").select("event_id", F.array_join(model_steps.key_risks(answer), "|").alias("risks"))


@query("""WITH v(name, dr, dp) AS (VALUES ('bull', 0.2::DOUBLE, 0.3::DOUBLE), ('base', 0.05, 0.5), ('bear', -0.15, 0.2))
SELECT CAST(c_custkey AS VARCHAR) AS symbol, name, CASE WHEN c_nationkey % 3 = 0 THEN dr ELSE CASE name WHEN 'bull' THEN 0.25 WHEN 'base' THEN 0.0 ELSE -0.5 END END AS ret,
round(CASE WHEN c_nationkey % 3 = 0 THEN dp ELSE CASE name WHEN 'bull' THEN 1.0::DOUBLE WHEN 'base' THEN 2.0 ELSE c_nationkey END / (3.0::DOUBLE + c_nationkey) END, 9) AS prob FROM customer, v""")
def scenario_answers(spark, d):
    good = F.concat(F.lit('{"bull": {"return": 0.25, "prob": 1}, "base": {"return": 0, "prob": 2}, "bear": {"return": -0.5, "prob": '), text("c_nationkey"), F.lit("}}"))
    rows = T.scan(spark, d, "customer").select(text("c_custkey").alias("symbol"), F.when(F.col("c_nationkey") % 3 == 0, "none").otherwise(good).alias("answer"))
    return model_steps.scenario_rows(rows).withColumn("prob", F.round("prob", 9))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE props END AS body FROM events""")
def marked_output(spark, d):
    kind = F.col("event_type")
    output = F.when(kind == "view", "nothing").when(kind == "click", F.concat(F.lit("log\n===JSON_START===\n"), F.col("props"), F.lit("\n===JSON_END===\nbye"))).otherwise(F.concat(F.lit("log "), F.col("props"), F.lit(" end")))
    body = F.regexp_replace(X.marked_json(output, "===JSON_START===", "===JSON_END==="), r"^\s+|\s+$", "")
    return T.scan(spark, d, "events").select("event_id", body.alias("body"))


@query("""SELECT c_custkey, 'Buy' AS recommendation, round(c_nationkey / 100.0::DOUBLE, 4) AS confidence, round(c_nationkey / 100.0::DOUBLE, 4) AS bull_return, 0.3::DOUBLE AS bull_prob, round(-c_nationkey / 100.0::DOUBLE, 4) AS bear_return FROM customer""")
def report_parsing(spark, d):
    n = text("c_nationkey")
    output = F.concat(F.lit("Recommendation: Buy\nConfidence Score: "), n, F.lit("%\nBull: +"), n, F.lit("% (Prob: 30%)\nBase: +5% (Prob: 50%)\nBear: -"), n, F.lit("% (Prob: 20%)"))
    rows = T.scan(spark, d, "customer").select("c_custkey", X.report_fields(output).alias("r"))
    return rows.select("c_custkey", "r.recommendation", *(F.round(f"r.{c}", 4).alias(c) for c in ("confidence", "bull_return", "bull_prob", "bear_return")))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://base' || regexp_replace(url, '^https?://[^/]*', '') END AS url FROM pages""")
def absolute_urls(spark, d):
    given = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://[^/]*", ""))
    return T.scan(spark, d, "pages").select("page_id", X.absolute_url(given, "https://base").alias("url"))


@query("SELECT event_id, props AS last_line FROM events")
def last_json_line(spark, d):
    output = F.concat(F.lit('log {\n{"old": 1}\n'), F.col("props"), F.lit("\ndone"))
    return T.scan(spark, d, "events").select("event_id", X.last_json_line(output).alias("last_line"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS from_ts, event_type AS step, count(*) AS events FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extension: tumbling windows over events, in batch as in the stream."""
    rows = T.scan(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("step")).agg(F.count("*").alias("events"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("from_ts"), "step", "events")


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS listed FROM lineitem GROUP BY 1")
def key_list(spark, d):
    flags = T.scan(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    return flags.select("l_orderkey", X.key_list(F.col("flags")).alias("listed"))


@query("""SELECT p_partkey AS symbol, p_retailprice AS pe_ratio, CAST(NULL AS DOUBLE) AS forward_pe, CAST(p_size AS DOUBLE) AS pb_ratio, CAST(NULL AS DOUBLE) AS ps_ratio, CAST(NULL AS DOUBLE) AS peg_ratio, CAST(NULL AS DOUBLE) AS dividend_yield,
p_retailprice * 1e6 AS market_cap, CAST(NULL AS DOUBLE) AS enterprise_value, CAST(NULL AS DOUBLE) AS current_price, CAST(NULL AS DOUBLE) AS "52_week_high", CAST(NULL AS DOUBLE) AS "52_week_low" FROM part""")
def valuation_fields(spark, d):
    price = F.col("p_retailprice")
    info = F.create_map(F.lit("trailingPE"), price.cast("string"), F.lit("priceToBook"), F.col("p_size").cast("string"), F.lit("marketCap"), (price * 1e6).cast("string"), F.lit("currentPrice"), F.lit("n/a"))
    return T.valuation_metrics(T.scan(spark, d, "part").select(F.col("p_partkey").alias("symbol"), info.alias("info")))
