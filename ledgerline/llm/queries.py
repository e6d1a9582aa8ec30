"""One query per operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, chat, fim, lexical, media, minhash, oracle, packing, pii, quality, search, secret_scan, toxicity, url_filter

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against dated lists that follow from the table: see captures_and_lists."""
    return url_filter.filter_urls(*captures_and_lists(table(spark, sf_dir, "pages")))


def captures_and_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages table has neither fetch dates nor lists, so both are made by a rule.

    Page p was fetched on day p mod 365 of 2024. A host whose length is a multiple of 3 is added on
    the day (7 * length) mod 365 and removed 120 days later; its parent domain (all but the first
    label, of hosts of three labels and more) is added 200 days after that host's own date.
    """
    start = F.to_date(F.lit("2024-01-01"))
    captures = pages.select("page_id", "url", F.date_add(start, (F.col("page_id") % 365).cast("int")).alias("fetch_date"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).distinct().where(F.col("host").isNotNull() & (F.length("host") % 3 == 0))
    day = F.date_add(start, (7 * F.length("host")) % 365)
    entry = lambda domain, date, action, category: F.struct(domain.alias("domain"), date.alias("entry_date"), F.lit(action).alias("action"), F.lit(category).alias("category"))
    parent = F.when(F.size(F.split("host", r"\.")) >= 3, F.regexp_replace("host", r"^[^.]*\.", ""))
    rows = F.array(entry(F.col("host"), day, "add", "host"), entry(F.col("host"), F.date_add(day, 120), "remove", "host"), entry(parent, F.date_add(day, 200), "add", "parent"))
    return captures, hosts.select(F.explode(rows).alias("e")).select("e.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify_toxicity(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train_pii(docs))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as WAV files; about half are declared as text, by the text's checksum, and so are corrected."""
    declared = F.when(F.crc32(F.coalesce("text", F.lit(""))) % 2 == 0, "audio/wav").otherwise("text/plain")
    found = media.inspect_media(media.encode_media(table(spark, sf_dir, "documents"), declared))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected", "corrected")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that follow from the table: see preference_pairs."""
    return chat.format_turns(preference_pairs(table(spark, sf_dir, "conversations")))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, c, r): chosen is conversation c; rejected has c's turns but its last, and then the last turn of c + 1.

    The table has no preferences, so this makes pairs that share all turns but the last. Of every third
    pair the rejected side asks back at an earlier turn, the (c mod number of turns)th from 0, so those
    part there. All turns are shuffled once, when they are gathered; besides that only last turns move.
    """
    turns = turns.withColumnRenamed("conv_id", "pair_id")
    whole = chat.ordered_turns(turns, "c")
    ends = chat.last_turns(turns, "end").withColumn("pair_id", F.col("pair_id") - 1)
    both = whole.join(ends, "pair_id").select("pair_id", "c", F.concat(F.slice("c", F.lit(1), F.size("c") - 1), F.array("end")).alias("r"))
    here = lambda i: (F.col("pair_id") % 3 == 1) & (i == F.col("pair_id") % F.size("c"))
    asked = F.transform("r", lambda t, i: F.struct(t["role"].alias("role"), F.when(here(i), F.concat(t["text"], F.lit("?"))).otherwise(t["text"]).alias("text")))
    return both.select("pair_id", "c", asked.alias("r"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are owners; the documents of a source in one language are a repository."""
    repository = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), F.col("source"), repository)


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_topk, op3_url_filter, op4_quality, op5_bpe, op6_toxicity, op7_pii, op8_minhash, op9_media, op10_chat, op11_secrets, op12_middle, op13_lexical)
}
ORACLE: dict[str, str] = oracle.ORACLE
