"""Document retrieval of a report: sections, chunks, vectors, ranked context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import documents, vectors


def filing_chunks(filings: DataFrame, model=vectors.hashed_embedding) -> DataFrame:
    """Chunk rows of filings (symbol, filing_date, text): id, section, chunk and its vector."""
    cut = documents.sections(filings).withColumnRenamed("section_text", "text")
    rows = documents.sentence_chunk_rows(cut)
    key = documents.chunk_id(F.col("symbol"), F.col("section"), F.col("filing_date"), F.col("chunk_index"))
    rows = rows.select(key.alias("id"), F.upper("symbol").alias("symbol"), "section", "filing_date", "chunk_index", "total_chunks", F.col("chunk").alias("text"), F.lit("sec_filings").alias("collection"))
    return vectors.embed(rows, "text", model)


def user_chunks(uploads: DataFrame, model=vectors.hashed_embedding) -> DataFrame:
    """Chunk rows of uploads (analysis_id, doc_id, symbol, filename, text)."""
    rows = documents.sentence_chunk_rows(uploads)
    key = documents.user_chunk_id(F.col("analysis_id"), F.col("doc_id"), F.col("chunk_index"))
    rows = rows.select(key.alias("id"), F.upper("symbol").alias("symbol"), "analysis_id", "doc_id", "filename", "chunk_index", "total_chunks", F.col("chunk").alias("text"), F.lit("user_pdf").alias("collection"))
    return vectors.embed(rows, "text", model)


def nearest_chunks(chunks: DataFrame, questions: DataFrame, keys: list[str], k: int = 3, model=vectors.hashed_embedding) -> DataFrame:
    """(keys, rank, text, filing_date) of the k chunks nearest to each question (keys, question) among those of its keys.

    chunks: (id, keys, text, embedding) and filing_date, if there is one. A search section is one choice
    of keys, so only its own chunks are compared.
    """
    section = lambda df: df.withColumn("section_key", F.concat_ws("\u0001", *keys))
    date = F.col("filing_date") if "filing_date" in chunks.columns else F.lit(None).cast("string")
    rows = section(chunks).select(F.xxhash64("id").alias("id"), F.col("embedding").alias("vector"), "section_key", *keys, "text", date.alias("filing_date"))
    asked = section(vectors.embed(questions, "question", model)).select(F.xxhash64("section_key", F.lit("question")).alias("id"), F.col("embedding").alias("vector"), "section_key")
    found = vectors.cosine_top_k(asked, rows.select("id", "vector", "section_key"), k, "section_key")
    return found.join(rows.drop("vector", "section_key"), "id").select(*keys, "rank", "text", "filing_date")


def contexts(chunks: DataFrame, questions: DataFrame, k: int = 3, model=vectors.hashed_embedding) -> DataFrame:
    """(symbol, part, context) for questions (symbol, part, question): the k nearest chunks of symbol and part.

    Questions without chunks get no row; readers take that as not available.
    """
    parts = chunks.withColumns({"symbol": F.upper("symbol"), "part": F.col("section")})
    ranked = nearest_chunks(parts, questions.withColumn("symbol", F.upper("symbol")), ["symbol", "part"], k, model)
    return documents.context(ranked, ["symbol", "part"])


#: Questions that are asked for each symbol, by part (fixed values); uploads are asked for an analysis's symbol.
QUESTIONS = {"risk_factors": "What are the key risk factors for {}?", "mda": "What is the management discussion and outlook for {}?"}
UPLOAD_QUESTION = "Summarize important fundamental and risk insights for {}"
MISSING = "Not available"


def asked_of(symbol: str, text: str):
    return F.replace(F.lit(text), F.lit("{}"), F.col(symbol))


def retrieve(requests: DataFrame, filed: DataFrame, uploaded: DataFrame, k: int = 3, model=vectors.hashed_embedding) -> DataFrame:
    """One row for each request (analysis_id, symbol): what its report is told from filings and uploads.

    filed and uploaded are rows of filing_chunks and user_chunks. Risk factors and discussion come from
    the symbol's filings, each with its k nearest chunks in order, and are asked once a symbol however
    many requests name it; uploads are the analysis's own. Contexts are cut with a marker, the uploaded
    one too, and say so where there is nothing. filing_date is that of the first risk chunk, else of the
    first of the discussion. document_sources lists the stored sources, filings before uploads, with
    their chunks; a source without chunks isn't one.
    """
    requests = requests.select("analysis_id", F.upper("symbol").alias("symbol")).distinct()
    symbols = requests.select("symbol").distinct()
    part = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), asked_of("symbol", q).alias("question")) for p, q in QUESTIONS.items()))).alias("q")
    from_filings = nearest_chunks(filed.withColumns({"symbol": F.upper("symbol"), "part": F.col("section")}), symbols.select("symbol", part).select("symbol", "q.*"), ["symbol", "part"], k, model)
    from_uploads = nearest_chunks(uploaded.withColumn("symbol", F.upper("symbol")), requests.select("analysis_id", "symbol", asked_of("symbol", UPLOAD_QUESTION).alias("question")), ["analysis_id", "symbol"], k, model)

    def told(name: str, where) -> list:
        return [
            documents.context_of(where).alias(f"{name}_context"), F.count_if(where).cast("int").alias(f"num_{name}_chunks"),
            F.min_by(F.when(where, F.col("filing_date")), F.when(where, F.col("rank"))).alias(f"{name}_date"),
        ]

    by_symbol = from_filings.groupBy("symbol").agg(*told("risk", F.col("part") == "risk_factors"), *told("mda", F.col("part") == "mda"))
    by_analysis = from_uploads.groupBy("analysis_id", "symbol").agg(*told("uploaded", F.lit(True)))
    out = requests.join(by_symbol, "symbol", "left").join(by_analysis, ["analysis_id", "symbol"], "left")
    sources = filed.groupBy(F.upper("symbol").alias("symbol")).agg(F.count("*").alias("chunks")).join(requests, "symbol").withColumn("source_type", F.lit("sec_filing"))
    own = uploaded.groupBy("analysis_id", F.upper("symbol").alias("symbol")).agg(F.count("*").alias("chunks")).join(requests, ["analysis_id", "symbol"], "left_semi").withColumn("source_type", F.lit("user_pdf"))
    listed = F.sort_array(F.collect_list(F.struct("source_type", "chunks")))
    out = out.join(sources.unionByName(own).groupBy("analysis_id", "symbol").agg(listed.alias("document_sources")), ["analysis_id", "symbol"], "left")
    counts = [F.coalesce(f"num_{n}_chunks", F.lit(0)).alias(f"num_{n}_chunks") for n in ("risk", "mda", "uploaded")]
    return out.select(
        "analysis_id", "symbol", *(F.coalesce(f"{n}_context", F.lit(MISSING)).alias(f"{n}_context") for n in ("risk", "mda", "uploaded")), *counts,
        F.coalesce("risk_date", "mda_date", F.lit("")).alias("filing_date"), (F.coalesce("num_risk_chunks", F.lit(0)) + F.coalesce("num_mda_chunks", F.lit(0)) + F.coalesce("num_uploaded_chunks", F.lit(0)) > 0).alias("available"),
        F.coalesce("document_sources", F.array().cast("array<struct<source_type: string, chunks: bigint>>")).alias("document_sources"),
    )
