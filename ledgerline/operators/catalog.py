"""Catalog and history queries over the registry, analyses and telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import first_given


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows where each given column has its value; empty and missing ones don't filter; symbols in upper case."""
    for name, value in equal.items():
        if value not in (None, ""):
            rows = rows.where(F.col(name) == (value.upper() if name == "symbol" else value))
    return rows


def list_documents(registry: DataFrame, symbol=None, source_type=None, analysis_id=None, limit: int = 200) -> DataFrame:
    """The newest documents that match, `limit` at most and one at least asked for."""
    kept = filtered(registry, symbol=symbol, source_type=source_type, analysis_id=analysis_id)
    return kept.orderBy(F.desc("updated_at"), "id").limit(max(1, limit))


def search_documents(registry: DataFrame, query: str) -> DataFrame:
    """Documents whose symbol and title (or file name) hold the text, letter case apart; kind tells filings from uploads."""
    name = first_given(F.col("title"), F.col("filename"), default="")
    found = registry.where(F.lower(F.concat_ws(" ", "symbol", name)).contains(query.lower()))
    return found.withColumns({"display_title": first_given(F.col("title"), F.col("filename"), default="Untitled document"), "kind": F.when(F.col("source_type") == "sec_filing", "sec").otherwise("other")})


def document_detail(registry: DataFrame, previews: DataFrame, doc_id) -> DataFrame:
    """One document with its preview, which may be missing, and what it offers; file_url where its file is stored."""
    own = registry.where(F.col("id") == doc_id).join(previews, "id", "left")
    if "file_id" in registry.columns:
        url = F.concat(F.lit("/api/documents/"), url_part(F.col("id").cast("string")), F.lit("/pdf"))
        own = own.withColumn("file_url", F.when(F.coalesce("file_id", F.lit("")) != "", url))
    return own.withColumns({"has_pdf": (F.col("source_type") == "user_pdf") | F.col("source_url").isNotNull(), "has_text_preview": F.coalesce(F.length("preview_text") > 0, F.lit(False))})


def url_part(text: Column) -> Column:
    """A text as one part of an address: all but letters, digits and - _ . ! ~ * ' ( ) in hexadecimal."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def by_any_id(rows: DataFrame, value: str, columns: tuple[str, ...] = ("id", "object_id")) -> DataFrame:
    condition = F.lit(False)
    for c in columns:
        condition = condition | (F.col(c) == value)
    return rows.where(condition)


def list_analyses(analyses: DataFrame, symbol=None, limit: int = 20, skip: int = 0) -> DataFrame:
    """A page of the newest analyses without their memo."""
    return filtered(analyses, symbol=symbol).drop("memo").orderBy(F.desc("created_at"), "id").offset(skip).limit(limit)


def analysis_documents(analyses: DataFrame, registry: DataFrame) -> DataFrame:
    """Each analysis's documents."""
    return analyses.select(F.col("id").alias("analysis_id")).join(registry, "analysis_id")


def delete_analyses(analyses: DataFrame, telemetry: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given (id) rows; documents and chunks stay."""
    return analyses.join(ids.select("id"), "id", "left_anti"), telemetry.join(ids.select(F.col("id").alias("analysis_id")), "analysis_id", "left_anti")
