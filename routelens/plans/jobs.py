"""The three end-to-end jobs: convert, evaluate, analyse (options as dataclasses).

Each job reads tables, runs the operators as Spark jobs and writes tables; paths may be any
Hadoop URI.  Nothing but small option values and fitted weights passes through the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.constants import ROUTER_PARAMS, TRAIN_FRACTION
from routelens.functions.hashing import cache_key
from routelens.functions.text import n_tokens_all
from routelens.operators.cost import price_answers
from routelens.operators.embed import embed_with_cache, encoder_embed, hash_embed
from routelens.operators.frontier import aiq, aiq_ranking, ndch
from routelens.operators.oracle import oracle_label
from routelens.operators.results import best_variant, family_series
from routelens.operators.split import families
from routelens.plans.convertors import read_answers
from routelens.plans.evaluate import ROUTERS, Grid, evaluate_grid, in_space, prepare
from routelens.session import arrow_batches, materialize, path_exists
from routelens.sources.results_io import to_reference_layout
from routelens.sources.tables import read_prices_csv

#: Rows of whole texts that travel to a Python tokenizer at once.
TEXT_ROWS = 500


@dataclass
class ConvertOptions:
    input_path: str
    output_path: str
    input_format: str = "parquet"            # a registered convertor (csv, runlogs, ...) or any format Spark reads
    store_path: str | None = None            # embedding store (parquet, partitioned by embedding model)
    embedding_models: list[str] = field(default_factory=lambda: ["hash32"])
    prices_path: str | None = None           # default: the shipped price list
    encoders: dict = field(default_factory=dict)   # embedding model -> (encoder factory, width)
    tokenizers: dict = field(default_factory=dict)         # tokenizer -> factory of a token counter
    model_tokenizers: dict[str, str] = field(default_factory=dict)   # model -> tokenizer; others: whitespace


@dataclass
class EvaluateOptions:
    data_path: str
    store_path: str
    output_path: str
    wanted_evals: list[str] | None = None    # eval families (name prefixes); None: every eval
    embedding_models: list[str] = field(default_factory=lambda: ["hash32"])
    fraction: float = TRAIN_FRACTION
    out_of_distribution: bool = False
    split_by: str = "sample"                 # sample | source (whole source groups on one side)
    grid: Grid = field(default_factory=Grid)
    prices_path: str | None = None
    routers: tuple = ("knn", "svm", "mlp", "cascading router")   # names of registered routers, or the cascade
    weights_path: str | None = None          # where every router's fitted weights are kept
    encoders: dict = field(default_factory=dict)   # embedding model -> (encoder factory, width)
    csv_path: str | None = None              # also write the results in the surveyed CSV layout


@dataclass
class AnalyseOptions:
    results_path: str
    output_path: str


def options_from(spark: SparkSession, path: str, kind: type):
    """Options of a job (``kind``) from a JSON file on any file system that Spark reads: the options' names
    with their values, ``grid`` an object of :class:`Grid` options.  Unknown names fail."""
    raw = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    if "grid" in raw:
        raw["grid"] = Grid(**raw["grid"])
    return kind(**raw)


def _prompt_text(prompt: F.Column) -> F.Column:
    """The text an embedding is computed from: the prompt's turns joined by newlines."""
    return F.concat_ws("\n", prompt)


def convert_long(long: DataFrame, prices: DataFrame, model_idx: F.Column, tokenizers: dict | None = None,
                 texts: bool = True) -> DataFrame:
    """Long answers -> one row per (sample, eval, model) with mean performance, cost, oracle and prompt.

    A prompt is known by its sample id and eval name together (evals may share ids).  Rows that repeat
    a (sample, eval, model) are averaged (missing grades skipped) and keep their cheapest cost.  One
    shuffle of the answers: every later group and join uses the same keys.  With ``tokenizers`` the price
    list names each model's (see :func:`price_answers`) and the response's tokens are kept.
    """
    if tokenizers and not texts:
        raise ValueError("tokenizers count the responses' texts")
    said = F.col("response") if texts else n_tokens_all("response").alias("response")
    keys = ["sample_id", "eval_name"]
    samples = long.withColumn("model_idx", model_idx).groupBy(*keys).agg(
        F.min("prompt").alias("prompt"),
        F.collect_list(F.struct("model", "model_idx", "performance", said)).alias("answers"))
    priced = price_answers(samples, prices, keys=(*keys, "prompt"), tokenizers=tokenizers)
    counted = [F.min_by("response_tokens", "response").alias("response_tokens")] if tokenizers else []
    per_model = priced.groupBy(*keys, "prompt", "model", "model_idx").agg(
        F.avg("performance").alias("performance"), F.min("cost_pico").alias("cost_pico"),
        *([F.min("response").alias("response")] if texts else []), *counted)
    lab = oracle_label(per_model, keys=tuple(keys)).select(*keys, "oracle")
    return per_model.join(lab, keys).withColumn("performance", F.coalesce(F.col("performance"), F.lit(0.0)))


def embedder(name: str, encoders: dict) -> tuple:
    """How prompts are embedded under a model name: ``hash<d>`` is the hash embedder of width d, any
    other name must be registered in ``encoders`` as (factory, width); see ``encoder_embed``."""
    if name in encoders:
        factory, dim = encoders[name]
        return lambda m: encoder_embed(m, "prompt", "hash", factory, dim)
    if name.startswith("hash") and name[4:].isdigit():
        return lambda m: hash_embed(m, "prompt", "hash", int(name[4:]))
    raise ValueError(f"no encoder for embedding model {name}")


def fill_store(spark: SparkSession, texts: DataFrame, store_path: str, name: str, encoders: dict) -> None:
    """Embeds the prompts that the store lacks for this model and appends them; an absent store is empty."""
    store = (spark.read.parquet(store_path) if path_exists(spark, store_path) else
             spark.createDataFrame([], "hash string, embedding_model string, prompt string, embedding array<float>"))
    embed_with_cache(texts, store, name, embedder(name, encoders), append_to=store_path)


def convert_job(spark: SparkSession, opts: ConvertOptions) -> str:
    """Price every answer, label the oracle, fill missing grades with 0 and make sure every
    prompt has its embeddings in the store; writes the converted long table."""
    long = materialize(read_answers(spark, opts.input_path, opts.input_format), "convert-long")     # scanned and parsed once
    # model order: by name (a tiny distinct list), the tie-break order of the oracle and routers
    names = sorted(r.model for r in long.select("model").distinct().collect())
    idx = F.element_at(F.create_map(*[x for i, m in enumerate(names) for x in (F.lit(m), F.lit(i))]), F.col("model"))
    prices = read_prices_csv(spark, opts.prices_path)
    if opts.tokenizers:
        chosen = F.create_map(*[F.lit(x) for pair in sorted(opts.model_tokenizers.items()) for x in pair])
        prices = prices.withColumn("tokenizer", F.element_at(chosen, F.col("model")) if opts.model_tokenizers
                                   else F.lit(None).cast("string"))
    elif opts.model_tokenizers:
        raise ValueError("model_tokenizers names tokenizers, but tokenizers holds none")
    with arrow_batches(spark, TEXT_ROWS):
        convert_long(long, prices, idx, opts.tokenizers).write.mode("overwrite").parquet(opts.output_path)
    if opts.store_path:
        texts = spark.read.parquet(opts.output_path).select(_prompt_text(F.col("prompt")).alias("prompt")).distinct()
        for model in opts.embedding_models:
            fill_store(spark, texts, opts.store_path, model, opts.encoders)
    return opts.output_path


def _family(eval_name: F.Column, wanted: list[str] | None) -> F.Column:
    if not wanted:
        return eval_name
    fam = F.lit(None).cast("string")
    for w in sorted(wanted, key=len):          # longest matching prefix wins
        fam = F.when(eval_name.startswith(w), F.lit(w)).otherwise(fam)
    return fam


def evaluate_job(spark: SparkSession, opts: EvaluateOptions) -> str:
    """Split, fit and route every router family over the wtp grid, run the cascade and write
    the long results table with the LLM and oracle baselines."""
    long = spark.read.parquet(opts.data_path)
    # look every prompt up in the store; misses are embedded once and appended (as the cache does)
    text = _prompt_text(F.col("prompt"))
    texts = long.select(text.alias("prompt")).distinct()
    for model in opts.embedding_models:
        fill_store(spark, texts, opts.store_path, model, opts.encoders)
    store = spark.read.parquet(opts.store_path)
    long = long.withColumn("family", _family(F.col("eval_name"), opts.wanted_evals)).where(F.col("family").isNotNull())
    # prompts carry their cache keys; every vector space is joined to them on its own
    long = long.withColumn("embedding", F.struct(*[cache_key(text, F.lit(m)).alias(m) for m in opts.embedding_models]))
    n_models = long.agg(F.max("model_idx")).first()[0] + 1
    prices = read_prices_csv(spark, opts.prices_path)
    # out of distribution every wanted family at once: train prompts carry each other wanted family's label
    wanted = (list(opts.wanted_evals or families(long))) if opts.out_of_distribution else None
    rd = prepare(long, n_models, opts.fraction, ood_wanted=wanted, split_by=opts.split_by)
    spaces = {m: in_space(rd, store, m) for m in opts.embedding_models}
    res = evaluate_grid(rd, spaces, prices, opts.grid, tuple(opts.routers), opts.fraction, opts.weights_path)
    res.write.mode("overwrite").parquet(opts.output_path)
    if opts.csv_path:
        # the same results in the surveyed tool's CSV layout (USD costs, parameter columns)
        to_reference_layout(spark.read.parquet(opts.output_path)).write.mode("overwrite") \
            .option("header", True).csv(opts.csv_path)
    return opts.output_path


def analyse_job(spark: SparkSession, opts: AnalyseOptions) -> dict[str, str]:
    """Best variants, frontiers (NDCH per variant and of the plain models) and AIQ ranking."""
    res = spark.read.parquet(opts.results_path)
    for c in ("wtp", "max_cost_per_response", "evaluator_error_rate"):     # absent if nothing swept it
        if c not in res.columns:
            res = res.withColumn(c, F.lit(None).cast("double"))
    routers = res.where(F.col("wtp").isNotNull())
    # what names a variant: the parameters of the router families that are swept over wtp
    params = list(dict.fromkeys(p for r in ("knn", "mlp", "svm") for p in ROUTER_PARAMS[r] if p != "willingness_to_pay"))
    # other registered routers' own parameters, as text
    own = [p for r in ROUTERS.values() if r.name not in ROUTER_PARAMS for p in r.params if p not in params]
    for p in own:
        routers = routers.withColumn(p, F.col(p).cast("string") if p in routers.columns else F.lit(None).cast("string"))
    params += list(dict.fromkeys(own))
    variant = ["router", *params]
    blank = {p: {"neighbors": -1, "learning_rate": -1.0}.get(p, "") for p in params}
    kinds = {int: "int", float: "double", str: "string"}
    for p, value in blank.items():
        if p not in routers.columns:     # no router family of the results has it
            routers = routers.withColumn(p, F.lit(None).cast(kinds[type(value)]))
    routers = routers.fillna(blank)
    points = routers.select("eval_name", *variant, F.col("wtp").alias("willingness_to_pay"), "performance",
                            F.col("total_cost_pico").alias("total_cost"))
    llm = res.where(F.col("wtp").isNull() & F.col("max_cost_per_response").isNull()
                    & (F.col("router") != "oracle")).select("eval_name", "router", "performance",
                                                            F.col("total_cost_pico").alias("total_cost"))
    out = {
        "best_variants": best_variant(points, variant, ["router", "embedding"]),
        "frontiers": ndch(points, ["eval_name"] + variant),
        "zero_router": ndch(llm, ["eval_name"]),
        "aiq": aiq(points.where(F.col("router") == "knn"), ["eval_name"], ["embedding"]),
    }
    out["aiq_ranking"] = aiq_ranking(out["aiq"], ["embedding"])
    # plot series: best variant of each router family (SVR not plotted) with its points by wtp,
    # and the cascade at judge error rate 0.2 with its points by budget
    casc = res.where(F.col("max_cost_per_response").isNotNull()).select(
        "eval_name", "router", *[F.lit(v).alias(p) for p, v in blank.items()], "max_cost_per_response", "evaluator_error_rate",
        F.col("total_cost_pico").alias("total_cost"), "performance")
    out["plot_series"] = family_series(points, casc, variant)
    out["eval_names"] = res.select("eval_name").distinct()
    out["router_names"] = routers.select(*variant).distinct()
    paths = {}
    for name, df in out.items():
        paths[name] = f"{opts.output_path}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths
