"""Token counting and token pricing as Catalyst expressions (no Python rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_tokens(text: Column | str) -> Column:
    """Number of ``\\S+`` runs in ``text`` (whitespace tokens), 0 for ''.

    One regex pass that only counts matches: no token array or rewritten string
    is materialised, which matters for 20,000-word texts.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def n_tokens_all(texts: Column | str) -> Column:
    """Token count summed over an ``array<string>`` (prompt or response turns)."""
    c = F.col(texts) if isinstance(texts, str) else texts
    return F.aggregate(F.transform(c, lambda s: n_tokens(s)), F.lit(0).cast("long"), lambda a, b: a + b)


def token_cost_pico(prompt_tokens: Column, response: Column, prompt_pico: Column, completion_pico: Column,
                    request_pico: Column) -> Column:
    """pico-USD cost of one answer: prompt tokens, completion tokens and a request fee (default 0)."""
    return (prompt_tokens * prompt_pico + n_tokens_all(response) * completion_pico
            + F.coalesce(request_pico, F.lit(0).cast("long")))


def split_tokens(text: Column) -> Column:
    """Whitespace tokens of ``text`` as an array (empty tokens removed)."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")
