"""The corpus pipeline: toxicity, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import minhash, packing, pii, quality, toxicity
from ledgerline.llm.common import written
from ledgerline.llm.queries import tokenizer_path
from ledgerline.session import lean_workers

#: Documents at or over this toxicity go; so do documents under this quality.
TOXIC, GOOD = 0.7, 0.5
#: Near duplicates share so many percent of their five-word shingles.
SIMILAR = 80
#: Up to so many dropped ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SCORE = "_pipeline_score"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under TOXIC; null and empty texts stay."""
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels(spark, sf_dir)), SCORE)
    return scored.where(F.col(SCORE) < TOXIC).drop(SCORE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least GOOD."""
    scored = quality.score_quality(docs, quality.train_quality(docs, labels(spark, sf_dir)), SCORE)
    return scored.where(F.col(SCORE) >= GOOD).drop(SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Rows are judged one by one: those that share a doc_id stay unless their own texts have a near
    duplicate that stays. Of a group's rows with the least doc_id, the one with the least class and
    then the least text stays. Rows without doc_id stand for a group only where it has no others, by
    class and text. Texts without words are in no group; they stay, once for each doc_id and text.
    """
    rows, members = minhash.grouped(docs, SIMILAR)
    members = written(members, "members")
    found = written(rows.select("doc_id", "class").join(members, "class", "left"), "groups")
    head = F.col("class").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    per_id = written(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(head).alias("kept"), F.count("*").alias("n")).where(~F.col("kept") | (F.col("n") > 1)), "dropped")
    named = docs.where(F.col("doc_id").isNotNull())
    out = named.join(few(per_id.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    repeated = few(per_id.where(F.col("kept") & (F.col("n") > 1)).select("doc_id"))
    heads = found.where(F.col("class").isNotNull() & head)
    unclear, own = docs.where(F.col("doc_id").isNull()), heads.where(F.col("doc_id").isNull())
    if repeated.limit(1).count():
        unclear = unclear.unionByName(named.join(repeated, "doc_id", "left_semi").select(docs.columns))
        own = own.unionByName(heads.join(repeated, "doc_id", "left_semi").select(heads.columns))
    return out.unionByName(survivors(unclear, own))


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast unless they are too many."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def survivors(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Of docs, the rows whose doc_id doesn't tell what stays: one row for each root of heads.

    heads: (doc_id, class, root) of rows with a component's least doc_id. Copies are aggregated before
    the join, partly before the shuffle, so neither an id nor a class of very many rows is a hot key.
    """
    chosen = heads.groupBy("root").agg(F.min("class").alias("chosen"), F.min("doc_id").alias("chosen_id"))
    rows = minhash.classed(docs, SCORE)
    own = rows.where(F.col(SCORE).isNotNull()).groupBy("doc_id", SCORE).agg(F.min_by(F.struct(*docs.columns), "text").alias("row"))
    own = own.join(chosen, (F.col(SCORE) == F.col("chosen")) & F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi")
    bare = rows.where(F.col(SCORE).isNull()).select(docs.columns).dropDuplicates(["doc_id", "text"])
    return own.select("row.*").unionByName(bare)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    out = pii.redact_pii(docs, pii.train_pii(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, tokenizer_path())


def lean(stage):
    """The stage, in workers that give memory back: all stages run in the same executors."""

    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean_workers(spark)
        return stage(spark, docs, sf_dir)

    return run_lean


STAGES = [("toxicity", lean(drop_toxic)), ("quality", lean(keep_quality)), ("near_duplicates", lean(drop_near_duplicates)), ("pii", lean(redact)), ("packing", lean(pack))]
#: The stages learn models and follow links, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
