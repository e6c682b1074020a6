"""Token pricing of answers (price lookup + token counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.functions.text import n_tokens_all, token_cost_pico
from routelens.operators.tokens import WHITESPACE, token_counter


def with_token_cost(long_df: DataFrame, prices: DataFrame, prompt_col: str = "prompt",
                    response_col: str = "response", out_col: str = "cost_pico") -> DataFrame:
    """Price every (prompt, model) answer: tokens x per-token prices + request fee.

    ``prices(model, prompt_pico, completion_pico, request_pico)`` is a dimension
    table with one row per model; Catalyst broadcasts it when its measured size
    is under ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a
    sort-merge join otherwise.  A model without a price fails the job, as an
    unknown model must.  A prompt may come as its whitespace tokens (type long), counted before its rows
    were repeated for every model.
    """
    asked = F.col(prompt_col) if isinstance(long_df.schema[prompt_col].dataType, T.LongType) else n_tokens_all(F.col(prompt_col))
    p = prices.select("model", "prompt_pico", "completion_pico", "request_pico")
    j = long_df.join(p, "model", "left")
    cost = F.when(F.col("prompt_pico").isNull(),
                  F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("long")
                  ).otherwise(token_cost_pico(asked, F.col(response_col), F.col("prompt_pico"),
                                              F.col("completion_pico"), F.col("request_pico")))
    return j.withColumn(out_col, cost).drop("prompt_pico", "completion_pico", "request_pico")


def response_length(long_df: DataFrame, response_col: str = "response", by: tuple = ("model",)) -> DataFrame:
    """Mean response length in tokens per model (partial + final aggregate)."""
    return long_df.groupBy(*by).agg(F.avg(n_tokens_all(F.col(response_col))).alias("avg_response_tokens"))


def price_answers(samples: DataFrame, prices: DataFrame, keys: tuple = ("sample_id",), prompt_col: str = "prompt",
                  answers_col: str = "answers", out_col: str = "cost_pico", tokenizers: dict | None = None) -> DataFrame:
    """Price per-prompt rows (``prompt`` + ``answers`` array of structs with ``model`` and
    ``response``): the prompt's token count is counted ONCE per prompt (whitespace tokens do not
    depend on the model), then the answers are exploded and priced.  Returns one row per
    (prompt, answer) with every answer field and the cost.

    ``tokenizers`` (name -> factory, see :func:`token_counter`) lets models count tokens their own way:
    ``prices`` then has a column ``tokenizer`` (null: whitespace), a prompt is counted once for each
    tokenizer, an answer by its model's, and its count is returned as ``response_tokens``.

    Without ``tokenizers`` a prompt or answer may come as its whitespace tokens, counted before the rows
    were grouped: a ``prompt_col`` or ``response`` of type long."""
    names = [WHITESPACE, *sorted(tokenizers or {})]

    def whitespace(kind, c):
        return c if isinstance(kind, T.LongType) else n_tokens_all(c)

    if tokenizers:
        count = token_counter(tokenizers)
        asked = F.create_map(*[x for n in names for x in (F.lit(n), count(F.lit(n), F.col(prompt_col)))])
    else:
        asked = whitespace(samples.schema[prompt_col].dataType, F.col(prompt_col))
    pt = samples.select(*keys, asked.alias("_pt"), answers_col)
    x = pt.select(*keys, "_pt", F.explode(answers_col).alias("_a")).select(*keys, "_pt", "_a.*")
    p = prices.select("model", "prompt_pico", "completion_pico", "request_pico", *(["tokenizer"] if tokenizers else []))
    j = x.join(p, "model", "left")
    prompt_tokens, said = F.col("_pt"), whitespace(x.schema["response"].dataType, F.col("response"))
    if tokenizers:
        own = F.coalesce(F.col("tokenizer"), F.lit(WHITESPACE))
        j = j.withColumn("response_tokens", count(own, F.col("response")))
        prompt_tokens, said = F.col("_pt")[own], F.col("response_tokens")
    cost = F.when(F.col("prompt_pico").isNull(),
                  F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("long")
                  ).otherwise(prompt_tokens * F.col("prompt_pico") + said * F.col("completion_pico")
                              + F.coalesce(F.col("request_pico"), F.lit(0).cast("long")))
    return j.withColumn(out_col, cost).drop("_pt", "prompt_pico", "completion_pico", "request_pico", "tokenizer")
