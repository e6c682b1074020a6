"""Leak-free train/test splits per eval family (by sample or by source group).

Exactly ``floor(n * fraction)`` members of each family go to train: those
first in the seeded order ``(u, id)`` with ``u = uniform01(seed, id)``.

Scale: sorting a whole family in one window task would put a hot family (a
third of all prompts) into one task.  Instead members with ``u`` clearly below
or above ``fraction`` are decided by comparison alone; only a narrow band
``|u - fraction| <= 6 / sqrt(n)`` around the cut is ranked with a window, and
its size grows like ``sqrt(n)``.  A family whose cut falls outside its band
(probability ~1e-9, or tiny families) ranks all of its members instead, so
the result is always exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.constants import SPLIT_SEED, TRAIN_FRACTION
from routelens.functions.hashing import uniform01


def split_members(members: DataFrame, group: str, member: str, fraction: float = TRAIN_FRACTION,
                  seed: str = SPLIT_SEED, band_sigmas: float = 6.0) -> DataFrame:
    """``(group, member)`` distinct pairs -> ``(group, member, split)`` with split in {train, test}."""
    m = members.select(group, member).distinct().withColumn("_u", uniform01(F.lit(seed), F.col(member)))
    n = F.count(F.lit(1))
    stats0 = m.groupBy(group).agg(n.alias("_n"))
    half = F.lit(band_sigmas) / F.sqrt(F.col("_n").cast("double"))
    stats0 = stats0.select(group, "_n", (F.floor(F.col("_n") * F.lit(fraction))).cast("long").alias("_k"),
                           (F.lit(fraction) - half).alias("_lo"), (F.lit(fraction) + half).alias("_hi"))
    j = m.join(stats0, group)
    below = F.col("_u") < F.col("_lo")
    inband = (F.col("_u") >= F.col("_lo")) & (F.col("_u") <= F.col("_hi"))
    counts = j.groupBy(group).agg(F.sum(below.cast("long")).alias("_nb"), F.sum(inband.cast("long")).alias("_nm"))
    # a family whose cut is not inside its band ranks everything (lo = -inf, hi = +inf)
    stats = stats0.join(counts, group).select(
        group, "_k",
        F.when((F.col("_nb") <= F.col("_k")) & (F.col("_k") <= F.col("_nb") + F.col("_nm")), F.col("_lo"))
        .otherwise(F.lit(-1.0)).alias("_lo"),
        F.when((F.col("_nb") <= F.col("_k")) & (F.col("_k") <= F.col("_nb") + F.col("_nm")), F.col("_hi"))
        .otherwise(F.lit(2.0)).alias("_hi"),
        F.when((F.col("_nb") <= F.col("_k")) & (F.col("_k") <= F.col("_nb") + F.col("_nm")), F.col("_nb"))
        .otherwise(F.lit(0).cast("long")).alias("_nb"))
    j = m.join(stats, group)
    sure = j.where((F.col("_u") < F.col("_lo")) | (F.col("_u") > F.col("_hi"))).select(
        group, member, F.when(F.col("_u") < F.col("_lo"), F.lit("train")).otherwise(F.lit("test")).alias("split"))
    band = j.where((F.col("_u") >= F.col("_lo")) & (F.col("_u") <= F.col("_hi")))
    r = F.row_number().over(Window.partitionBy(group).orderBy("_u", member))
    ranked = band.select(group, member, F.when(F.col("_nb") + r <= F.col("_k"), F.lit("train"))
                         .otherwise(F.lit("test")).alias("split"))
    return sure.unionByName(ranked)


def split_samples(samples: DataFrame, family: str = "family", sample: str = "sample_id",
                  fraction: float = TRAIN_FRACTION, seed: str = SPLIT_SEED) -> DataFrame:
    """In-distribution split of the prompts of every family."""
    return split_members(samples, family, sample, fraction, seed)


def split_by_source(samples: DataFrame, family: str = "family", source: str = "source",
                    sample: str = "sample_id", fraction: float = TRAIN_FRACTION, seed: str = SPLIT_SEED) -> DataFrame:
    """Split source groups of each family (restricted to the family's own evals), then give
    every prompt its source's side, so no source is on both sides."""
    src = split_members(samples.select(family, source), family, source, fraction, seed)
    return samples.select(family, source, sample).distinct().join(src, [family, source]).select(
        family, sample, "split")


def split_out_of_distribution(samples: DataFrame, wanted: str, family: str = "family",
                              sample: str = "sample_id", fraction: float = TRAIN_FRACTION,
                              seed: str = SPLIT_SEED) -> DataFrame:
    """Train on the train part of every other family, test on the test part of ``wanted``."""
    s = split_samples(samples, family, sample, fraction, seed)
    return s.where(((F.col(family) != wanted) & (F.col("split") == "train"))
                   | ((F.col(family) == wanted) & (F.col("split") == "test")))


def leak_check(split: DataFrame, family: str = "family", sample: str = "sample_id") -> DataFrame:
    """Per family: train and test sizes and the number of prompts on both sides (must be 0)."""
    train, test = [(F.col("split") == s).cast("long") for s in ("train", "test")]
    per_prompt = split.groupBy(family, sample).agg(F.sum(train).alias("_tr"), F.sum(test).alias("_te"))
    both = F.least(F.col("_tr"), F.lit(1)) * F.col("_te") * (F.col("_tr") > 0).cast("long")
    return per_prompt.groupBy(family).agg(F.sum("_tr").alias("n_train"), F.sum("_te").alias("n_test"),
                                          F.sum(F.when(both > 0, F.col("_tr")).otherwise(0)).alias("n_overlap"))


def families(df: DataFrame, family: str = "family") -> list[str]:
    """The eval families that the rows hold, in order: as many names as there are evals, not rows."""
    names = df.where(F.col(family).isNotNull()).select(family).distinct().collect()
    return sorted(r[0] for r in names)
