"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "matchloom") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.shuffle.partitions": str(n), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.sql.warehouse.dir": os.environ.get("MATCHLOOM_WAREHOUSE", "/tmp/matchloom/warehouse"), "spark.checkpoint.dir": os.environ.get("MATCHLOOM_STAGED", "/tmp/matchloom/staged"),
    }
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
