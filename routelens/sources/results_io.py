"""Result sinks and readers: CSV/parquet tables of ``eval_results`` and collections of them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.session import path_exists


def save_results(df: DataFrame, root: str, base_name: str, data_name: str, fmt: str = "parquet",
                 if_absent: bool = False) -> str:
    """Write a results table to ``root/base_name/data_name=<name>/`` (partitioned by data set).

    ``if_absent`` keeps an existing table untouched (``mode('ignore')``), the way results were
    uploaded to object stores only when missing; any Hadoop URI works as ``root``.
    """
    path = os.path.join(root, base_name)
    out = df.withColumn("data_name", F.lit(data_name))
    if if_absent:
        # partition-level "write only if absent": skip when this data set's folder exists
        part = os.path.join(path, f"data_name={data_name}")
        if path_exists(df.sparkSession, part):
            return path
    w = out.write.mode("append").partitionBy("data_name")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def load_results(spark: SparkSession, path: str, data_name: str | None = None, fmt: str = "parquet",
                 schema: str | None = None) -> DataFrame:
    """Read a results collection back; rows from repeated saves are removed (``distinct``)."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if schema:
        r = r.schema(schema)
    df = r.load(path)
    if data_name is not None:
        df = df.where(F.col("data_name") == data_name)
    if "accuracy" in df.columns and "performance" not in df.columns:
        df = df.withColumnRenamed("accuracy", "performance")   # the column's name in old results
    return df.drop("data_name").distinct()


def to_reference_layout(results: DataFrame) -> DataFrame:
    """``eval_results`` in the surveyed tool's long CSV layout: ``model_name`` (router family or
    model), ``performance``, ``total_cost`` in USD, and one nullable column per router parameter
    under its name in variant strings (``willingness_to_pay``, ``neighbors``, ...)."""
    from routelens.constants import PICO_PER_USD, ROUTER_PARAMS
    cols = {
        "eval_name": F.col("eval_name"),
        "model_name": F.col("router"),
        "performance": F.col("performance"),
        "total_cost": F.col("total_cost_pico").cast("double") / F.lit(float(PICO_PER_USD)),
    }
    named = [p for router in ROUTER_PARAMS.values() for p in router if p != "willingness_to_pay"]
    optional = list(dict.fromkeys([*named, "fraction"]))
    for c in optional:
        cols[c] = F.col(c) if c in results.columns else F.lit(None).cast("string")
    cols["willingness_to_pay"] = F.col("wtp") if "wtp" in results.columns else F.lit(None).cast("double")
    return results.select(*[v.alias(k) for k, v in cols.items()])
