"""Versioned prompt templates as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import rendered
from ledgerline.sources import schemas
from ledgerline.sources.tables import whole_texts


def load_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of name_vN.yaml files in a folder; a few files, parsed on the driver."""
    import yaml

    files = whole_texts(spark, f"{folder.rstrip('/')}/*_v*.yaml").select(F.regexp_extract("path", r"([^/]+)_v(\d+)\.yaml$", 1).alias("name"), F.regexp_extract("path", r"_v(\d+)\.yaml$", 1).cast("int").alias("version"), "text")
    rows = []
    for r in files.collect():
        data = yaml.safe_load(r["text"]) or {}
        rows.append((r["name"], r["version"], data.get("template"), data.get("model_target"), data.get("temperature"), data.get("description"), data.get("variables") or []))
    return spark.createDataFrame(rows, schemas.PROMPTS)


def latest(prompts: DataFrame) -> DataFrame:
    """The newest version of each name."""
    rest = [c for c in prompts.columns if c not in ("name", "version")]
    return prompts.groupBy("name").agg(F.max("version").alias("version"), *(F.max_by(c, "version").alias(c) for c in rest))


def versions(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"))


def metadata(prompts: DataFrame) -> DataFrame:
    return prompts.drop("template")


def prompt(prompts: DataFrame, name: str, version: int | None = None) -> DataFrame:
    own = prompts.where(F.col("name") == name)
    return latest(own) if version is None else own.where(F.col("version") == version)


def render(rows: DataFrame, prompts: DataFrame, name: str, values: dict, version: int | None = None, column: str = "prompt") -> DataFrame:
    """rows with the rendered template; values maps placeholders to columns of rows. One template row is joined."""
    template = prompt(prompts, name, version).select(F.col("template").alias("_template"))
    return rows.crossJoin(F.broadcast(template)).withColumn(column, rendered(F.col("_template"), values)).drop("_template")
