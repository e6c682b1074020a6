"""Token counts by pluggable tokenizers.

A tokenizer is a name and a factory: ``factory()`` is called once per task, when a row first asks for the
name, and returns a function from a text to its number of tokens.  ``whitespace`` is built in and its
texts never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from routelens.functions.text import n_tokens_all

WHITESPACE = "whitespace"


def token_counter(tokenizers: dict[str, Callable]) -> Callable[[Column, Column], Column]:
    """``count(name, texts)``: tokens of an ``array<string>`` under the tokenizer that the row names.

    Null arrays and arrays with a null text count null, as whitespace tokens do; a name that is neither
    ``whitespace`` nor in ``tokenizers`` fails the job.
    """
    @F.pandas_udf("long")
    def plugged(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded = {}
        for names, lists in batches:
            out = []
            for name, texts in zip(names, lists):
                if texts is None:
                    out.append(None)
                    continue
                if name not in loaded:
                    if name not in tokenizers:
                        raise ValueError(f"no tokenizer {name}")
                    loaded[name] = tokenizers[name]()
                out.append(None if any(t is None for t in texts) else sum(loaded[name](t) for t in texts))
            yield pd.Series(out, dtype=object)

    def count(name: Column, texts: Column) -> Column:
        return F.when(name == WHITESPACE, n_tokens_all(texts)).otherwise(plugged(name, F.when(name != WHITESPACE, texts)))

    return count
