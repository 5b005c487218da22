"""Session helper. The settings are the ones every operator assumes; a cluster sets the rest."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.parquet.inferTimestampNTZ.enabled", "true")
    )
    if master:
        cores = master.removeprefix("local[").removesuffix("]")
        width = cores if cores.isdigit() else str(os.cpu_count() or 8)
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", width)
            .config("spark.default.parallelism", width)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
