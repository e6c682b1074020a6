"""Readers for the parquet tables the engine runs on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a DataFrame; parquet scans prune columns and push filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Bytes of a Parquet row group, which no split divides.
ROW_GROUP = 128 << 20


def dealt(scan: DataFrame) -> DataFrame:
    """The rows of a scan, dealt round robin over the session's cores where the files are fewer than cores and
    smaller than a row group a core: such files are read by a task or two, however much work their rows mean.
    Other scans, as on a cluster, stay as they are and shuffle nothing."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if len(scan.inputFiles()) >= cores:
        return scan
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size < cores * ROW_GROUP else scan


def read_prices_csv(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The shipped model price list as ``model_price`` (pico-USD per token).

    Prices are kept per 10M tokens in the file; 1 USD / 10M tokens = 1e5 pico-USD per token.
    """
    if path is None:
        path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "prices.csv")
    raw = (spark.read.option("header", True).option("comment", "#")
           .schema("model string, prompt_usd_per_10m_tokens decimal(20,6), "
                   "completion_usd_per_10m_tokens decimal(20,6), request_usd decimal(20,9)")
           .csv(path))
    return raw.select(
        "model",
        (F.col("prompt_usd_per_10m_tokens") * 100000).cast("long").alias("prompt_pico"),
        (F.col("completion_usd_per_10m_tokens") * 100000).cast("long").alias("completion_pico"),
        (F.col("request_usd") * 1000000000000).cast("long").alias("request_pico"),
    )
