"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    It is spark.checkpoint.dir, which the driver and all executors share. Only a local master may
    go without that setting; it then gets a temporary folder that ends with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back.

    The files outlive a lost executor and end the lineage. They stay until the folder is cleared,
    as a lazy result may still read them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/ledgerline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
