"""Scans, and the derived views that stand in for market, macro, filing and telemetry feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Months of a history's period.
PERIODS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60, "10y": 120}


def since(day: str | None, period: str | None = None) -> Column | None:
    """First day of a history: `day` itself, or `period` (of PERIODS) before it; null where all counts."""
    if day is None or period == "max":
        return None
    return F.to_date(F.lit(day)) if period is None else F.add_months(F.to_date(F.lit(day)), -PERIODS[period])


def bars(spark: SparkSession, sf_dir: str, start: Column | None = None) -> DataFrame:
    """Daily bars: orders of a market segment by day, first and last by order key, from `start` on.

    The start reaches the scan, as it is a bound of the stored column.
    Grouped before the join would be by customer; the join is on a narrow projection, and the
    aggregation is partial before its shuffle.
    """
    orders = scan(spark, sf_dir, "orders")
    if start is not None:
        orders = orders.where(F.col("o_orderdate") >= start.cast("timestamp_ntz"))
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("dt"))
    customers = scan(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    price = F.col("o_totalprice")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("symbol", "dt").agg(
        F.min_by(price, "o_orderkey").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, "o_orderkey").alias("close"), F.count("*").alias("volume"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, close): the mean order price of each day."""
    return scan(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.avg("o_totalprice").alias("close"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sector, dt, close): mean price of a part type by month of shipping."""
    items = scan(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", F.to_date(F.date_trunc("month", "l_shipdate")).alias("dt"))
    parts = scan(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("sector"))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("sector", "dt").agg(F.avg("l_extendedprice").alias("close"))


def macro(spark: SparkSession, sf_dir: str, start: Column | None = None) -> DataFrame:
    """(series_id, dt, value): by month, the mean tax as rate and the mean unit price as price index; from `start` on."""
    items = scan(spark, sf_dir, "lineitem")
    if start is not None:
        items = items.where(F.col("l_shipdate") >= start.cast("timestamp_ntz"))
    monthly = items.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("dt")).agg(
        F.avg("l_tax").alias("rate"), F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("price_index")
    )
    return monthly.selectExpr("stack(2, 'rate', rate, 'price_index', price_index) AS (series_id, value)", "dt").select("series_id", "dt", "value")


#: Valuation fields and the names that feeds give them (fixed values).
VALUATION_FIELDS = {
    "pe_ratio": "trailingPE", "forward_pe": "forwardPE", "pb_ratio": "priceToBook", "ps_ratio": "priceToSalesTrailing12Months", "peg_ratio": "pegRatio",
    "dividend_yield": "dividendYield", "market_cap": "marketCap", "enterprise_value": "enterpriseValue", "current_price": "currentPrice",
    "52_week_high": "fiftyTwoWeekHigh", "52_week_low": "fiftyTwoWeekLow",
}


def valuation_metrics(quotes: DataFrame) -> DataFrame:
    """(symbol, eleven fields as double) of quotes (symbol, info map<string, string>); null where missing or no number."""
    return quotes.select("symbol", *(F.expr("info").getItem(key).try_cast("double").alias(name) for name, key in VALUATION_FIELDS.items()))


def valuation(bars: DataFrame, last: int = 252) -> DataFrame:
    """(symbol, price, high, low): newest close, and the extremes of the last `last` closes."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))
    kept = bars.select("symbol", "dt", "close", newest.alias("rn")).where(F.col("rn") <= last)
    return kept.groupBy("symbol").agg(F.max_by("close", "dt").alias("price"), F.max("close").alias("high"), F.min("close").alias("low"))


def scenarios(returns: DataFrame) -> DataFrame:
    """(symbol, name, ret, prob) in long form: means of the rising, middle and falling days, and their counts."""
    name = F.when(F.col("ret") > 0.5, "bull").when(F.col("ret") < -0.3, "bear").otherwise("base")
    scale = F.when(F.col("name") == "base", 0.1).otherwise(0.2)
    named = returns.where(F.col("ret").isNotNull()).withColumn("name", name)
    return named.groupBy("symbol", "name").agg(F.avg("ret").alias("mean"), F.count("*").cast("double").alias("prob")).select("symbol", "name", (F.col("mean") * scale).alias("ret"), "prob")


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry rows from conversation turns: the role tells prompt from completion."""
    models = F.array(*map(F.lit, ("gemini-2.5-flash", "gemini-2.0-flash", "gemini-2.5-pro", "gemini-1.5-flash", "gemini-pro", "mistralai/Mistral-7B-Instruct-v0.2", "unlisted-model")))
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")
    own = F.col("role") == "assistant"
    zero = F.lit(0).cast("long")
    return scan(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("analysis_id"), F.col("turn").alias("ts"), F.col("role").alias("agent_name"),
        F.element_at(models, (F.col("conv_id") % 7 + 1).cast("int")).alias("model"),
        F.when(own, zero).otherwise(tokens).alias("prompt_tokens"), F.when(own, tokens).otherwise(zero).alias("completion_tokens"),
        F.length("text").cast("double").alias("latency_ms"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document registry rows: source as symbol, language as source type."""
    docs = scan(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "sec_filing").otherwise("user_pdf")
    return docs.select(
        F.col("doc_id").alias("id"), kind.alias("source_type"), F.upper("source").alias("symbol"), (F.col("doc_id") % 97).alias("analysis_id"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("source"), F.lit(" report ")  , F.col("doc_id").cast("string"))).alias("title"),
        F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 400).cast("int")).alias("updated_at"), F.col("n_chars").alias("chunks"),
    )


def filing_texts(docs: DataFrame) -> DataFrame:
    """docs with their text in place of two sections of a filing."""
    parts = (F.lit("Item 1. Business "), F.col("lang"), F.lit(" Item 1A. Risk Factors "), F.col("text"), F.lit(" Item 2. Properties Item 7. Management's Discussion and Analysis "), F.col("text"), F.lit(" Item 8."))
    return docs.withColumn("text", F.concat(*parts))


def binary_files(spark: SparkSession, path: str, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Uploads as (path, file name made safe, content) up to a size, PDF by extension."""
    files = spark.read.format("binaryFile").load(path).where((F.col("length") <= most_bytes) & F.lower("path").endswith(".pdf"))
    return files.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[^a-zA-Z0-9._-]", "_").alias("file_name"), "content", "modificationTime")


def stored_name(file_name: Column, at: Column) -> Column:
    """Name under which an upload is stored: its time in milliseconds, then the name made safe."""
    return F.concat(F.unix_millis(at).cast("string"), F.lit("-"), F.regexp_replace(file_name, "[^a-zA-Z0-9._-]", "_"))


def stored_file(files: DataFrame, file_id: str) -> DataFrame:
    """(path, file_name, content) of the stored file with an id (its name), one row or none."""
    return files.where(F.col("file_name") == file_id).select("path", "file_name", "content").limit(1)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, for downloaded filings and templates."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a JSON array file under an explicit schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


def zipped_filings(submissions: DataFrame, form: str, count: int) -> DataFrame:
    """Filings of one form from parallel arrays, the first `count` of each symbol, with their URL.

    submissions: (symbol, cik, forms, dates, accessions, documents), a row a symbol. The arrays are
    filtered and cut before they become rows. Leading zeros of cik and dashes of the accession number
    don't appear in the URL.
    """
    first = F.slice(F.filter(F.arrays_zip("forms", "dates", "accessions", "documents"), lambda f: f["forms"] == form), 1, count)
    kept = submissions.select("symbol", "cik", F.posexplode(first).alias("pos", "f"))
    url = F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.ltrim("cik", F.lit("0")), F.regexp_replace("f.accessions", "-", ""), "f.documents")
    return kept.select("symbol", (F.col("pos") + 1).alias("rank"), url.alias("url"), F.col("f.dates").alias("filing_date"), F.col("f.accessions").alias("accession_number"))
