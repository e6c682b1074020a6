"""Long <-> wide reshapes and row filters of graded-answer tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER_FIELDS = ("model_idx", "model", "performance", "cost_pico")


def to_wide(long_df: DataFrame, models: list[str], keys: tuple = ("sample_id", "eval_name")) -> DataFrame:
    """One row per prompt, ``<model>_perf`` (mean over duplicates) and ``<model>_cost`` per model.

    The model list is passed to ``pivot`` so Spark does not run a separate
    distinct job; duplicate keys never multiply rows (cost: the smallest).
    """
    return (long_df.groupBy(*keys).pivot("model", models)
            .agg(F.avg("performance").alias("perf"), F.min("cost_pico").alias("cost")))


def wide_to_long(wide: DataFrame, models: list[str], keys: tuple = ("sample_id", "eval_name")) -> DataFrame:
    """Inverse of :func:`to_wide` with a generator (``inline``), no shuffle."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}_perf`").alias("performance"),
                              F.col(f"`{m}_cost`").alias("cost_pico")) for m in models])
    return wide.select(*keys, F.inline(rows))


def to_answers(long_df: DataFrame, keys: tuple = ("sample_id", "eval_name"),
               fields: tuple = ANSWER_FIELDS) -> DataFrame:
    """One row per prompt with ``answers``: array of per-model structs sorted by ``model_idx``.

    The array is bounded by the number of models; all later per-prompt logic
    (arg-max routing, cascades) runs as array expressions on this row.
    """
    return long_df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("answers"))


def model_list(long_df: DataFrame) -> DataFrame:
    """Models present in the data with their order (smallest index seen)."""
    return long_df.groupBy("model").agg(F.min("model_idx").alias("model_idx"))


def complete_samples(long_df: DataFrame, cols: list[str] | None = None, key: str = "sample_id") -> DataFrame:
    """Drop every row of a prompt if any of its rows has a NULL in any of ``cols``.

    The per-prompt flag is a partial aggregate (tiny shuffle); the rows are then
    kept with a left-semi join, which AQE can split if one key is hot.
    """
    cols = cols or long_df.columns
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    ok = (long_df.groupBy(key).agg(F.max(bad.cast("int")).alias("_bad"))
          .where(F.col("_bad") == 0).select(key))
    return long_df.join(ok, key, "left_semi")


def drop_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a NULL in any of the named columns are dropped."""
    return df.na.drop(how="any", subset=cols)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key by an explicit order.

    ``min_by`` aggregates partially on the map side, so a hot key costs one
    row per partition in the shuffle instead of all its rows in one window.
    """
    payload = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def family_of(eval_name: str = "eval_name", sep: str = "-") -> F.Column:
    return F.substring_index(F.col(eval_name), sep, 1)


def eval_from_sample_id(sample_id: str = "sample_id") -> F.Column:
    """Eval name = text before the first '.' of the sample id."""
    return F.substring_index(F.col(sample_id), ".", 1)


def filter_family(df: DataFrame, prefix: str, col: str = "eval_name") -> DataFrame:
    """Rows whose eval belongs to a family: a prefix test, pushed to the scan when possible."""
    return df.where(F.col(col).startswith(prefix))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Key coverage of two tables (one row): keys only left, only right, and duplicated on either
    side.  All zeros means a 1:1 correspondence (a full outer join of the distinct keys)."""
    lk = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    rk = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    j = lk.join(rk, key, "full_outer")
    return j.agg(F.sum(F.col("_r").isNull().cast("long")).alias("only_left"),
                 F.sum(F.col("_l").isNull().cast("long")).alias("only_right"),
                 F.sum(((F.col("_l") > 1) | (F.col("_r") > 1)).cast("long")).alias("duplicated"))
