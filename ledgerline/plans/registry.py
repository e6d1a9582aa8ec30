"""Named queries over the driver's tables and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import html
from ledgerline.functions import text as X
from ledgerline.operators import catalog, decision, documents, evaluation, macro, prices, progress, prompts, recursive, resolve, risk, telemetry, vectors
from ledgerline.plans import evaluations, lookups, parts, report, round_trips, stores, streams  # noqa: F401
from ledgerline.plans.oracle import ORACLE as WHOLE
from ledgerline.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(parts.QUERIES)
ORACLE: dict[str, str] = WHOLE | parts.ORACLE
LETTERS = ("Apple stock outlook", "coca-cola risk", "aapl", "brk-b", "what about tesla and nvidia", "some unknown firm", "  ", "pineapple farms and intel")
TEMPLATE = "Report on {name} ({ticker}): confidence {confidence}, {missing} and {{braces}}"


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query
def price_bars(spark, d):
    return T.bars(spark, d)


@query
def simple_returns(spark, d):
    return rounded(prices.enriched(T.bars(spark, d)).where(F.col("ret").isNotNull()).select("symbol", "dt", "ret"), 8, "ret")


@query
def sma_50_200(spark, d):
    return rounded(prices.enriched(T.bars(spark, d)).select("symbol", "dt", "sma_50", "sma_200"), 6, "sma_50", "sma_200")


@query
def ma_signal(spark, d):
    return rounded(report.market(T.bars(spark, d)).select("symbol", "price", "sma_50", "sma_200", "ma_signal"), 6, "sma_50", "sma_200")


@query
def price_trend(spark, d):
    return rounded(prices.price_trend(T.bars(spark, d)), 6, "change_pct")


@query
def bollinger_signal(spark, d):
    last = prices.latest(prices.enriched(T.bars(spark, d)).select("symbol", "dt", "close", "upper_20", "lower_20"))
    return rounded(last.select("symbol", "dt", "upper_20", "lower_20", prices.band_signal(F.col("close"), F.col("upper_20"), F.col("lower_20")).alias("band_signal")), 4, "upper_20", "lower_20")


@query
def macd_signal(spark, d):
    found = recursive.indicators(T.bars(spark, d))
    return rounded(found.select("symbol", F.col("macd.line").alias("macd_line"), F.col("macd.signal").alias("macd_smooth"), recursive.macd_signal(F.col("macd")).alias("macd_signal")), 4, "macd_line", "macd_smooth")


@query
def rsi_14(spark, d):
    return rounded(recursive.indicators(T.bars(spark, d)).select("symbol", F.col("rsi").alias("rsi_14")), 6, "rsi_14")


@query
def range_position_52w(spark, d):
    v = T.valuation(T.bars(spark, d)).withColumn("position", prices.range_position(F.col("price"), F.col("high"), F.col("low")))
    return rounded(v.withColumn("range_label", prices.range_label(F.col("position"))), 6, "position")


@query
def volatility(spark, d):
    return rounded(risk.volatility(T.bars(spark, d)), 4, "volatility")


@query
def beta(spark, d):
    return rounded(risk.beta(T.bars(spark, d), T.benchmark(spark, d)), 6, "beta")


@query
def max_drawdown(spark, d):
    found = risk.max_drawdown(T.bars(spark, d))
    return rounded(found.withColumn("severity", risk.severity(F.col("max_drawdown_pct"))), 4, "max_drawdown_pct")


@query
def risk_metrics(spark, d):
    return rounded(rounded(risk.risk_metrics(T.bars(spark, d), T.benchmark(spark, d)), 6, "beta"), 4, "volatility", "max_drawdown_pct")


@query
def market_data(spark, d):
    names = ("symbol", "dt", "price", "ma_signal", "band_signal", "rsi", "macd_line", "macd_signal", "high_52w", "low_52w", "position", "range_label", "change_pct", "trend")
    return rounded(rounded(report.market_data(T.bars(spark, d)).select(*names), 6, "rsi", "position", "change_pct"), 4, "macd_line")


@query
def bars_since(spark, d):
    return T.bars(spark, d, T.since("1997-06-30", "6mo"))


@query
def rate_trend_since(spark, d):
    return rounded(macro.rate_trend(T.macro(spark, d, T.since("1996-03-01"))), 8, "last", "reference")


@query
def memo_prompt(spark, d):
    template = "Memo on {ticker}: {recommendation} at {confidence}, {price_trend}, {interest_rate_trend}, {market_trend}, bull {bull_return} at {bull_prob}"
    memo = spark.range(1).select(F.lit("memo_writer").alias("name"), F.lit(1).alias("version"), F.lit(template).alias("template"))
    return report.memo(full_report(spark, d), decision.normalized(scenario_rows(spark, d)), memo, [lambda prompts: prompts]).select("symbol", F.col("memo").alias("prompt"))


@query
def chunk_count(spark, d):
    rows = documents.chunk_rows(T.scan(spark, d, "documents").select(F.upper("source").alias("symbol"), "text"), documents.fixed_chunks(F.col("text")))
    return documents.count_chunks(rows.withColumn("collection", F.lit("sec_filings")), "src0")


@query
def rate_trend(spark, d):
    return rounded(macro.rate_trend(T.macro(spark, d)), 8, "last", "reference")


@query
def inflation_trend(spark, d):
    return rounded(macro.inflation_trend(T.macro(spark, d)), 6, "change_pct")


@query
def sector_performance(spark, d):
    return macro.sector_performance(T.sectors(spark, d))


@query
def market_trend(spark, d):
    return rounded(macro.market_trend(macro.sector_performance(T.sectors(spark, d))), 6, "mean_return_pct")


def scenario_rows(spark, d):
    return T.scenarios(prices.enriched(T.bars(spark, d)).select("symbol", "ret"))


@query
def scenario_normalize(spark, d):
    return rounded(decision.normalized(scenario_rows(spark, d)), 6, "ret", "prob")


@query
def expected_return(spark, d):
    return rounded(decision.expected_return(decision.normalized(scenario_rows(spark, d))), 6, "expected_return")


def full_report(spark, d):
    return report.report(T.bars(spark, d), T.benchmark(spark, d), T.macro(spark, d), T.sectors(spark, d), scenario_rows(spark, d))


@query
def confidence_score(spark, d):
    return full_report(spark, d).select("symbol", "confidence")


@query
def recommendation(spark, d):
    return rounded(full_report(spark, d).select("symbol", "expected_return", "recommendation"), 6, "expected_return")


@query
def research_report(spark, d):
    names = ("symbol", "dt", "price", "ma_signal", "band_signal", "volatility", "beta", "max_drawdown_pct", "severity", "trend", "expected_return", "interest_rate_trend", "inflation_trend", "market_trend", "confidence", "recommendation")
    return rounded(rounded(full_report(spark, d).select(*names), 6, "beta", "expected_return"), 4, "volatility", "max_drawdown_pct")


@query
def token_estimate(spark, d):
    rows = T.scan(spark, d, "conversations").withColumn("tokens", telemetry.estimated_tokens(F.col("text")))
    return rows.groupBy("role").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns"))


@query
def call_cost(spark, d):
    return rounded(telemetry.with_cost(T.llm_calls(spark, d)).select("analysis_id", "ts", "model", "total_tokens", "cost_usd"), 9, "cost_usd")


@query
def telemetry_summary(spark, d):
    return telemetry.summary(T.llm_calls(spark, d))


def eval_rows(spark, d):
    return T.scan(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(T.scan(spark, d, "labels"), "doc_id")


@query
def eval_summary(spark, d):
    rows = eval_rows(spark, d).select(F.col("source").alias("agent"), (F.col("quality") * 5).alias("relevance_score"), (F.lit(5) - F.col("toxic") * 4).alias("accuracy_score"), F.col("n_chars").cast("double").alias("latency_ms"))
    return rounded(evaluation.judge_means(rows, ["agent"]), 6, "avg_relevance", "avg_accuracy", "avg_latency_ms")


@query
def resolver_accuracy(spark, d):
    rows = eval_rows(spark, d).select(F.col("lang").alias("intent"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("skipped"))
    return rounded(evaluation.accuracy(rows, ["intent"]), 6, "accuracy_pct")


@query
def html_to_text(spark, d):
    return T.scan(spark, d, "pages").select("page_id", "url", html.html_to_text(F.col("html")).alias("text"))


@query
def extract_sections(spark, d):
    found = documents.sections(T.filing_texts(T.scan(spark, d, "documents")).select("doc_id", "text"))
    return found.select("doc_id", "section", F.length("section_text").cast("long").alias("chars"), F.md5("section_text").alias("digest"))


@query
def chunk_fixed(spark, d):
    rows = documents.chunk_rows(T.scan(spark, d, "documents").select("doc_id", "text"), documents.fixed_chunks(F.col("text")))
    return rows.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "total_chunks", F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("digest"))


@query
def chunk_sentence(spark, d):
    rows = documents.sentence_chunk_rows(T.scan(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "total_chunks", F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("digest"))


@query
def chunk_ids(spark, d):
    rows = documents.chunk_rows(T.scan(spark, d, "documents").select("doc_id", "source", "lang", "text"), documents.fixed_chunks(F.col("text")))
    key = documents.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("chunk_index"))
    return rows.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), key.alias("chunk_id"))


@query
def upsert_latest(spark, d):
    orders = T.scan(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    old, new = orders.where(F.col("o_orderstatus") == "F"), orders.where(F.col("o_orderstatus") != "F")
    return documents.upsert(old, new, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def search_sides(spark, d):
    rows = T.scan(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("section"))
    return rows.where(F.col("id") % 20 == 0), rows


@query
def vector_topk(spark, d):
    return rounded(vectors.cosine_top_k(*search_sides(spark, d), 3), 5, "score")


@query
def vector_topk_approx(spark, d):
    return rounded(vectors.cosine_top_k(*search_sides(spark, d), 3, breadth=100), 5, "score")


def ranked_documents(spark, d, *keys):
    docs = T.scan(spark, d, "documents").withColumn("part", F.when(F.col("lang") == "en", 0).otherwise(1))
    order = Window.partitionBy(*keys).orderBy(F.desc("n_chars"), "doc_id")
    return docs.withColumn("rank", F.row_number().over(order))


@query
def context_build(spark, d):
    top = ranked_documents(spark, d, "source").where(F.col("rank") <= 3).select("source", "rank", "text")
    return documents.context(top, ["source"]).select("source", F.length("context").cast("long").alias("chars"), F.md5("context").alias("digest"))


@query
def document_preview(spark, d):
    top = ranked_documents(spark, d, "source", "part").where(F.col("rank") <= 4).select("source", "part", "rank", "text")
    return documents.preview(top, "source").select("source", "preview_chunks", F.md5("preview_text").alias("digest"))


@query
def freshness_check(spark, d):
    date = F.when(F.col("analysis_id") % 11 == 0, "n/a").otherwise(F.date_format("updated_at", "yyyy-MM-dd"))
    chunks = T.registry(spark, d).select(F.concat_ws("-", "symbol", (F.col("id") % 50).cast("string")).alias("symbol"), date.alias("filing_date"))
    return documents.has_recent(chunks, "2025-04-25")


@query
def catalog_list(spark, d):
    return catalog.list_documents(T.registry(spark, d), symbol="src0", source_type="sec_filing").select("id", "symbol", "updated_at", "filename")


@query
def catalog_search(spark, d):
    return catalog.search_documents(T.registry(spark, d), "Report 1").select("id", "display_title", "kind")


@query
def history_page(spark, d):
    orders = T.scan(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("memo"), F.col("o_totalprice").alias("score"))
    return catalog.list_analyses(orders, symbol="2-high", limit=20, skip=40)


@query
def delete_cascade(spark, d):
    customers = T.scan(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    orders = T.scan(spark, d, "orders").select(F.col("o_custkey").alias("analysis_id"), "o_orderkey")
    kept, calls = catalog.delete_analyses(customers, orders, customers.where(F.col("c_acctbal") < 0))
    return kept.select(F.lit("analyses").alias("part"), F.col("id").alias("key")).unionByName(calls.select(F.lit("telemetry").alias("part"), F.col("o_orderkey").alias("key")))


@query
def ticker_shape(spark, d):
    words = T.scan(spark, d, "part").select("p_partkey", F.explode(F.array("p_type", "p_brand", F.upper(F.substring_index("p_name", " ", 1)), F.concat(F.upper(F.substring_index("p_name", " ", -1)), F.lit("-B")))).alias("word"))
    return words.select("p_partkey", "word", resolve.is_symbol(F.col("word")).alias("is_symbol"), resolve.typed_symbol(F.col("word")).alias("typed"))


@query
def resolve_company(spark, d):
    names = F.array(*map(F.lit, LETTERS))
    asked = T.scan(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")), F.when(F.col("p_partkey") % 16 < 8, "").otherwise(F.concat(F.lit(" "), F.col("p_name")))).alias("query"))
    return resolve.resolve(asked).select("id", "query", "symbol", "route", "confidence", "error")


def answers(spark, d):
    kind = F.col("event_type")
    fenced = F.when(kind == "purchase", '```json\n{"sentiment": "positive"}\n```').when(kind == "error", '{"sentiment": "negative"}').when(kind == "click", "Looks Bullish to me").when(kind == "view", "a bearish outlook").otherwise("flat")
    return T.scan(spark, d, "events").select("event_id", fenced.alias("answer"), F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```\nDone")).alias("fenced"))


@query
def sentiment_label(spark, d):
    return answers(spark, d).select("event_id", X.sentiment(F.col("answer")).alias("sentiment"))


@query
def json_fence_parse(spark, d):
    return answers(spark, d).select("event_id", F.from_json(X.unfenced(F.col("fenced")), "struct<k: bigint>")["k"].alias("k"))


@query
def prompt_render(spark, d):
    rows = T.scan(spark, d, "customer")
    prompt = spark.range(1).select(F.lit("memo").alias("name"), F.lit(1).alias("version"), F.lit(TEMPLATE).alias("template"))
    name = F.when(F.col("c_custkey") % 5 == 0, "{ticker} }}{{").otherwise(F.col("c_name"))
    values = {"name": name, "ticker": F.col("c_mktsegment"), "confidence": F.concat(F.col("c_nationkey").cast("string"), F.lit("%"))}
    return prompts.render(rows, prompt, "memo", values).select("c_custkey", "prompt")


@query
def prompt_latest_version(spark, d):
    rows = T.scan(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("version"), F.col("p_brand").alias("template"))
    return prompts.latest(rows)


@query
def filing_zip(spark, d):
    items = T.scan(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag").alias("i"))
    lists = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))
    accession = F.transform("items", lambda i: F.concat_ws("-", i["l_partkey"].cast("string"), i["l_suppkey"].cast("string"), i["l_linenumber"].cast("string")))
    name = F.transform("items", lambda i: F.concat(i["l_linenumber"].cast("string"), F.lit(".htm")))
    submissions = lists.select(F.col("l_orderkey").alias("symbol"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("cik"), F.col("items.l_returnflag").alias("forms"), F.col("items.day").alias("dates"), accession.alias("accessions"), name.alias("documents"))
    return T.zipped_filings(submissions, "R", 2)


@query
def progress_events(spark, d):
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("  plain "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("["), F.col("event_type"), F.lit("] step "), F.col("event_id").cast("string"), F.lit(" [x]")))
    lines = T.scan(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", line.alias("line"))
    return progress.events(lines).select("run_id", "ts", "step", "message")


@query
def stale_gaps(spark, d):
    return progress.gaps(T.scan(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts"))


@query
def terminal_events(spark, d):
    return progress.terminal(T.scan(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_type").alias("step")))
