"""Convertors: how graded answers in some format become the typed long table.

A convertor is a function ``(spark, path) -> DataFrame`` that gives the columns of ``LONG``, registered
under the name of its format.  A format without a convertor is a data source that Spark knows, its own or
one registered with ``spark.dataSource.register``, whose rows have the columns of ``LONG_COLUMNS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.functions.logs import parse_list_literal
from routelens.operators.logs import attach_header, fold_events, parse_log_lines, scan_run_logs
from routelens.operators.reshape import complete_samples, dedupe_first

LONG_COLUMNS = ["sample_id", "eval_name", "model_name", "prompt", "model_response", "performance"]
LONG = ["sample_id", "eval_name", "model", "prompt", "response", "performance"]

Convertor = Callable[[SparkSession, str], DataFrame]
CONVERTORS: dict[str, Convertor] = {}


def convertor(name: str) -> Callable[[Convertor], Convertor]:
    """Registers a convertor under the name of its format; a later one replaces an earlier one."""
    def deco(fn: Convertor) -> Convertor:
        CONVERTORS[name] = fn
        return fn
    return deco


def _as_list(c: F.Column, dtype: str) -> F.Column:
    return parse_list_literal(c) if dtype == "string" else c


def typed_long(raw: DataFrame) -> DataFrame:
    """A stored long table (lists printed or not, unknown grades NaN or null) with the columns of ``LONG``."""
    raw = raw.select(*LONG_COLUMNS)
    types = dict(raw.dtypes)
    return raw.select("sample_id", "eval_name", F.col("model_name").alias("model"),
                      _as_list(F.col("prompt"), types["prompt"]).alias("prompt"),
                      _as_list(F.col("model_response"), types["model_response"]).alias("response"),
                      F.nanvl(F.col("performance").cast("double"), F.lit(None).cast("double")).alias("performance"))


@convertor("csv")
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed_long(spark.read.option("header", True).option("escape", '"')
                      .schema("sample_id string, eval_name string, model_name string, prompt string, "
                              "model_response string, performance double").csv(path))


@convertor("runlogs")
def read_runlogs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs: one file per model and eval; a sample meets its other models by eval name and sample id."""
    ev = attach_header(parse_log_lines(scan_run_logs(spark, path))).where(F.col("run_id").isNotNull())
    f = fold_events(ev, extra_keys=("model", "eval_name")).where(F.col("correct").isNotNull())
    f = f.select("file", "sample_id", "eval_name", "model", "prompt", F.col("sampled").alias("response"),
                 F.col("correct").alias("performance"))
    f = dedupe_first(f, ["sample_id", "eval_name", "model", "prompt"], ["file"]).drop("file")
    return complete_samples(f, LONG)


def read_answers(spark: SparkSession, path: str, input_format: str) -> DataFrame:
    """The long table at ``path`` in a registered format, or in any other that Spark can read."""
    known = CONVERTORS.get(input_format)
    long = known(spark, path) if known else typed_long(spark.read.format(input_format).load(path))
    missing = [c for c in LONG if c not in long.columns]
    if missing:
        raise ValueError(f"format {input_format} gives no column {', '.join(missing)}")
    return long.select(*LONG)
