"""Filing sources: company numbers, search results, PDF texts, taxonomy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import absolute_url

SEARCH_HITS = "hits struct<hits: array<struct<_id: string, _source: struct<form: string, file_date: string, file_num: string, file_url: string>>>>"
ARCHIVE = "https://www.sec.gov"


def company_numbers(symbols: DataFrame, companies: DataFrame) -> DataFrame:
    """symbols with cik, ten digits with leading zeros, by symbol in any letter case; null where unknown.

    companies: (ticker, cik_str). Of repeated tickers the least number counts, so no row multiplies.
    """
    known = companies.groupBy(F.upper("ticker").alias("_ticker")).agg(F.min(F.col("cik_str").cast("long")).alias("_cik"))
    joined = symbols.join(known, F.upper("symbol") == F.col("_ticker"), "left")
    return joined.withColumn("cik", F.lpad(F.col("_cik").cast("string"), 10, "0")).drop("_ticker", "_cik")


def cik_of_feed(atom: Column) -> Column:
    """Company number of an Atom feed, as the fallback source."""
    return F.lpad(F.nullif(F.regexp_extract(atom, r"CIK=(\d+)", 1), F.lit("")), 10, "0")


def search_results(answers: DataFrame, count: int = 2) -> DataFrame:
    """(symbol, rank, url, filing_date, accession_number) of search answers (symbol, body), a row a symbol, the first `count`."""
    hits = F.slice(F.from_json("body", SEARCH_HITS)["hits"]["hits"], 1, count)
    kept = answers.select("symbol", F.posexplode(hits).alias("pos", "h"))
    source = F.col("h._source")
    return kept.select("symbol", (F.col("pos") + 1).alias("rank"), absolute_url(source["file_url"], ARCHIVE).alias("url"), source["file_date"].alias("filing_date"), source["file_num"].alias("accession_number"))


def joined_pages(pages: Column) -> Column:
    """Page texts stripped, blank ones dropped, a blank line between."""
    stripped = F.transform(pages, lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(stripped, lambda p: p != ""), "\n\n")


def pdf_texts(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """files (path, content, ...) with text from reader(content), a list of page texts; null if it fails.

    No PDF library is part of this engine, so the reader is a parameter.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda content: reader(bytes(content)) if content is not None else None)

    return files.withColumn("text", joined_pages(read("content")))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, examples, default_agents) of a YAML taxonomy; a few rows, parsed on the driver."""
    import yaml

    from ledgerline.sources.schemas import TAXONOMY
    from ledgerline.sources.tables import whole_texts

    data = yaml.safe_load(whole_texts(spark, path).first()["text"]) or {}
    rows = [(c["name"], c.get("description"), c.get("examples") or [], c.get("default_agents") or []) for c in data.get("categories") or data.get("intents") or []]
    return spark.createDataFrame(rows, TAXONOMY)
