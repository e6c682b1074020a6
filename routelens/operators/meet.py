"""Groups of reference rows met by streams of other rows, in bounded tasks.

``meet`` is a replicated equi-join followed by a function: the few reference rows of a key are copied to
as many tasks as the key's other rows need, and every task reads the reference rows first and then
streams the others past them.  A hot key is spread over many tasks; a task holds one key's reference rows
and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stream(build: Callable, answer: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of, parts, made = None, [], None
        for b in batches:
            keys, salt, role = b.column("key").to_pylist(), b.column("salt").to_numpy(), b.column("role").to_numpy()
            cut = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or salt[i] != salt[i - 1] or role[i] != role[i - 1]]
            for a, e in zip([0, *cut], [*cut, len(keys)], strict=True):
                if a == e:
                    continue
                if (keys[a], salt[a]) != key_of:
                    key_of, parts, made = (keys[a], salt[a]), [], None
                if role[a] == 0:
                    parts.append(b.slice(a, e - a))
                elif parts:
                    made = build(pa.Table.from_batches(parts).combine_chunks()) if made is None else made
                    yield from answer(made, b.slice(a, e - a))
    return run


def meet(reference: DataFrame, others: DataFrame, build: Callable, answer: Callable, schema, spread: str,
         task_rows: int = 4096, least_partitions: int = 0) -> DataFrame:
    """Both sides carry ``key``; all other column names must agree in type where they are shared.

    ``build`` makes an object from the Arrow table of a key's reference rows, ``answer(object, batch)``
    yields record batches of ``schema`` for batches of that key's other rows.  A key's other rows are dealt
    by ``spread`` to as many tasks as they need at about ``task_rows`` each, and only so often are its
    reference rows copied; reference rows of keys without other rows do not move.
    """
    partitions = max(least_partitions, int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = others.groupBy(F.col("key").alias("_k")).agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("_salts"))
    same = F.col("key") == F.col("_k")
    reference = (reference.join(sizes, same).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
                 .drop("_k", "_salts").withColumn("role", F.lit(0)))
    others = (others.join(sizes, same).withColumn("salt", F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))
              .drop("_k", "_salts").withColumn("role", F.lit(1)))
    return (reference.unionByName(others, allowMissingColumns=True).repartition(partitions, "key", "salt")
            .sortWithinPartitions("key", "salt", "role").mapInArrow(_stream(build, answer), schema))


def matrix(column, dim: int | None = None) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if dim is None else dim) if len(column) else np.zeros((0, dim or 0))
