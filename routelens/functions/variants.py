"""Variant names ``algo|k:v|...|value_type`` <-> typed parameter columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_name(algo: str | Column, params: list[tuple[str, Column]], value_type: str | None = None) -> Column:
    """``algo|p1:v1|p2:v2[...]|value_type`` from typed columns (display / export only)."""
    a = F.lit(algo) if isinstance(algo, str) else algo
    parts = [a] + [F.concat(F.lit(f"{k}:"), v) for k, v in params]
    if value_type is not None:
        parts.append(F.lit(value_type))
    return F.concat_ws("|", *parts)


def parse_variant(name: Column) -> Column:
    """Strict parse: first part = algorithm, last part = value type, middle parts ``k:v`` (split at the
    first ':'; a repeated key raises).  Returns ``struct(algorithm, value_type, params map)``."""
    parts = F.split(name, r"\|")
    n = F.size(parts)
    middle = F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))
    kv = F.transform(middle, lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"),
                                                F.substr(p, F.instr(p, ":") + 1, F.length(p)).alias("value")))
    return F.struct(F.element_at(parts, 1).alias("algorithm"),
                    F.when(n >= 2, F.element_at(parts, -1)).alias("value_type"),
                    F.map_from_entries(kv).alias("params"))


def parse_params_tolerant(name: Column) -> Column:
    """Tolerant parse: every part that contains ':' gives key = before the first ':',
    value = between the first and second ':'; names without ':' give an empty map."""
    parts = F.filter(F.split(name, r"\|"), lambda p: p.contains(":"))
    kv = F.transform(parts, lambda p: F.struct(F.split(p, ":")[0].alias("key"), F.split(p, ":")[1].alias("value")))
    return F.map_from_entries(kv)
