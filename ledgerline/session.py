"""Session defaults: UTC, adaptive execution, ANSI, Arrow."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "ledgerline", **conf: str) -> SparkSession:
    """A session with this library's settings; a cluster's own master and settings win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Lets Python workers find this package where its folder is theirs too.

    On other machines the path does no harm; there the package is installed or sent with --py-files.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


#: Settings of a process's allocators under which large pieces go back to the system as soon as they are free.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144"}


def lean_workers(spark: SparkSession) -> None:
    """Python workers of functions made from now on keep little memory that they don't use; settings that are there win.

    For jobs of many steps, whose workers share an executor's memory with what earlier steps have left.
    """
    for name, value in LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)
