"""The evaluation job: split, fit/score routers, sweep wtp, aggregate per eval family.

Composes the operators into the long ``eval_results`` table
``(eval_name, router, neighbors, metric, embedding, wtp, performance, total_cost_pico, ...)``
where LLM baselines and the oracle have NULL router parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.constants import (CASCADE_BUDGETS, CASCADE_ERROR_RATES, CASCADE_ROUTER, KNN_METRICS, KNN_NEIGHBORS, MLP_ACTIVATIONS, MLP_HIDDEN_LAYERS,
                                 MLP_LEARNING_RATES, MLP_MAX_ITER, MONEY, ORACLE, TRAIN_FRACTION, WTP_GRID)
from routelens.operators.cascade import accept_thresholds, cascade_results, order_chains, simulate
from routelens.operators.learned import fit_linear_abs, fit_mlp_grid, linear_scores, linear_weights_table, mlp_scores
from routelens.functions.text import n_tokens_all
from routelens.operators.knn import knn_topk, neighbor_scores
from routelens.operators.oracle import fill_performance, oracle_label
from routelens.operators.reshape import to_answers
from routelens.operators.routing import price_vectors, route, with_choice
from routelens.operators.split import split_by_source, split_samples
from routelens.session import materialize


@dataclass
class RoutingData:
    long: DataFrame        # one row per answer (explode of samples.answers) with split and response_tokens
    samples: DataFrame     # one row per prompt: family, sample_id, eval_name, embedding, answers, perf, split
    n_models: int


def prepare(long_with_embedding: DataFrame, n_models: int, fraction: float = TRAIN_FRACTION,
            checkpoint: bool = True, ood_wanted: str | list[str] | None = None,
            split_by: str = "sample", answers: bool = True, tokens: bool = True,
            vectors: DataFrame | None = None) -> RoutingData:
    """Per-prompt rows with the answers array, dense performance vector and split side.

    ``answers=False`` is for plans that need grades and vectors alone: no response is derived or counted
    in tokens, and the answers array holds the grades only.  ``tokens=False`` is for plans that price no
    router: answers keep model, grade and cost.

    ``vectors`` (doc_id, embedding): the prompts' vectors where the answers' rows hold none but a doc_id.
    They meet the prompts once answers are counted, so that no response is shuffled; the prompts are those
    of the answers joined with the vectors, an answer as often as its doc_id has vectors.

    ``ood_wanted``: out-of-distribution routing for that family -- routers train on the train
    part of every other family and are evaluated on the test part of the wanted family; all
    kept prompts are labelled with the wanted family (the eval being evaluated).
    ``split_by="source"``: whole source groups go to one side (no source on both sides).
    """
    filled = fill_performance(long_with_embedding)
    # one aggregate per prompt builds the answers array (with each answer's response length in
    # tokens) and keeps the prompt's embedding and source
    extra = [F.first("source").alias("source")] if "source" in filled.columns else []
    # a converted table may hold the tokens as the models' own tokenizers count them
    said = F.col("response_tokens") if "response_tokens" in filled.columns else n_tokens_all(F.col("response"))
    detail = ["model", "performance", "cost_pico", *([said.alias("response_tokens")] if tokens else [])] if answers else ["performance"]
    gathered = F.array_sort(F.collect_list(F.struct("model_idx", *detail))).alias("answers")
    if vectors is None:
        ans = filled.groupBy("family", "sample_id", "eval_name").agg(gathered, F.first("embedding").alias("embedding"), *extra)
    else:
        ans = filled.groupBy("family", "sample_id", "eval_name", "doc_id").agg(gathered, *extra)
        held = vectors.groupBy("doc_id").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).cast("int").alias("_times"))
        often = F.array_sort(F.flatten(F.array_repeat("answers", F.col("_times"))))
        ans = (ans.join(held, "doc_id").withColumn("answers", F.when(F.col("_times") > 1, often).otherwise(F.col("answers")))
               .drop("doc_id", "_times"))
    perf = F.transform(F.sequence(F.lit(0), F.lit(n_models - 1)),
                       lambda i: F.element_at(F.filter(F.col("answers"), lambda a: a["model_idx"] == i), 1)["performance"])
    samples = ans.withColumn("perf", perf)
    if checkpoint:
        # the split reads the ids several times: from a written table, not from the prompts' whole lineage
        samples = materialize(samples, "routing-prompts")
    if split_by == "source":
        split = split_by_source(samples.select("family", "source", "sample_id"), fraction=fraction)
    else:
        split = split_samples(samples.select("family", "sample_id"), fraction=fraction)
    if ood_wanted is None:
        samples = samples.join(split.select("family", "sample_id", "split"), ["family", "sample_id"])
    else:
        # each wanted family W: train on the train part of every other family, test on W's test
        # part.  A train prompt is labelled with every wanted family but its own (an explode over
        # the short list of wanted families), so all of them are fitted in the same passes.
        wanted = [ood_wanted] if isinstance(ood_wanted, str) else list(ood_wanted)
        fam, side = F.col("family"), F.col("split")
        targets = F.when(side == "train", F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: w != fam)) \
            .otherwise(F.when(fam.isin(*wanted), F.array(fam)).otherwise(F.array().cast("array<string>")))
        keep = split.select(fam.alias("own"), "sample_id", "split", F.explode(targets).alias("family"))
        samples = samples.withColumnRenamed("family", "own").join(keep, ["own", "sample_id"]).drop("own")
    if checkpoint:
        # the per-prompt table feeds several jobs (block sizing, kNN, prices, routing, baselines):
        # cut the lineage once with a table written in the shared folder
        samples = materialize(samples, "routing-samples")
    # the long view (one row per answer) is an explode of the per-prompt table, not another table
    long = samples.select("family", "sample_id", "eval_name", "split", F.explode("answers").alias("_a")).select(
        "family", "sample_id", "eval_name", "split", "_a.*")
    return RoutingData(long, samples, n_models)


def knn_neighbors(rd: RoutingData, k: int, metric: str = "cosine") -> DataFrame:
    train = rd.samples.where(F.col("split") == "train")
    test = rd.samples.where(F.col("split") == "test")
    return knn_topk(test, train, k, ["family"], metric=metric, payload="perf")


def knn_scores(rd: RoutingData, ks: list[int] = KNN_NEIGHBORS, metric: str = "cosine") -> DataFrame:
    """``(family, k, query_id, scores)``: one ranking at max k serves every k of the grid."""
    nb = knn_neighbors(rd, max(ks), metric)
    return neighbor_scores(nb, ks, rd.n_models, ["family"])


def family_prices(rd: RoutingData, prices: DataFrame) -> DataFrame:
    """USD-per-token price score vector per family, mean response length over the train split."""
    tr = rd.long.where(F.col("split") == "train")
    lengths = tr.groupBy("family", "model", "model_idx").agg(F.avg("response_tokens").alias("avg_response_tokens"))
    return price_vectors(prices, lengths, rd.n_models, ["family"])


def _answers(rd: RoutingData) -> DataFrame:
    """The test prompts' answers; a prompt is known by its family and id (families may share ids)."""
    return rd.samples.where(F.col("split") == "test").select("family", F.col("sample_id").alias("query_id"), "answers")


def knn_routed(rd: RoutingData, prices: DataFrame, ks: list[int] = KNN_NEIGHBORS,
               wtp_values: list[float] = WTP_GRID, metric: str = KNN_METRICS[0]) -> DataFrame:
    """``(family, k, query_id, wtp, chosen_idx, chosen, performance, cost_pico)`` for every test prompt."""
    # answers join one row per (k, prompt) before the 32-way wtp explode
    sc = knn_scores(rd, ks, metric).join(family_prices(rd, prices), "family").join(_answers(rd), ["family", "query_id"])
    return with_choice(route(sc, wtp_values))


def knn_results(rd: RoutingData, prices: DataFrame, ks: list[int] = KNN_NEIGHBORS,
                wtp_values: list[float] = WTP_GRID, embedding: str = "given", fraction: float = TRAIN_FRACTION,
                metric: str = KNN_METRICS[0]):
    """The sweep of one vector space and metric; one ranking at the largest k serves every k."""
    r = knn_routed(rd, prices, ks, wtp_values, metric)
    g = r.groupBy("family", "k", "wtp").agg(F.avg("performance").alias("performance"),
                                           F.sum(F.col("cost_pico").cast(MONEY)).alias("total_cost_pico"))
    return g.select(F.col("family").alias("eval_name"), F.lit("knn").alias("router"),
                    F.col("k").cast("int").alias("neighbors"), F.lit(metric).alias("metric"),
                    F.lit(embedding).alias("embedding"), F.lit(float(fraction)).alias("fraction"),
                    F.col("wtp"), "performance", "total_cost_pico")


def baseline_results(rd: RoutingData) -> DataFrame:
    """LLM and oracle rows on the test split, per family."""
    te = rd.long.where(F.col("split") == "test")
    llm = te.groupBy("family", "model").agg(F.avg("performance").alias("performance"),
                                           F.sum(F.col("cost_pico").cast(MONEY)).alias("total_cost_pico"))
    orc = oracle_label(te, keys=("family", "sample_id")).groupBy("family").agg(
        F.avg("oracle_performance").alias("performance"), F.sum(F.col("oracle_cost_pico").cast(MONEY)).alias("total_cost_pico")
    ).select("family", F.lit(ORACLE).alias("model"), "performance", "total_cost_pico")
    return llm.unionByName(orc).select(F.col("family").alias("eval_name"), F.col("model").alias("router"),
                                       "performance", "total_cost_pico")


def eval_results(rd: RoutingData, prices: DataFrame, ks: list[int] = KNN_NEIGHBORS) -> DataFrame:
    """Router variants x wtp plus the LLM / oracle baselines; unused parameters are NULL."""
    return knn_results(rd, prices, ks).unionByName(baseline_results(rd), allowMissingColumns=True)


MLP_EPOCHS = MLP_MAX_ITER          # an upper bound: nets stop early by the reference's loss rule


def _scored_results(rd: RoutingData, prices: DataFrame, scored: DataFrame, extra_cols=(),
                    wtp_values: list[float] = WTP_GRID) -> DataFrame:
    """``scored(family, query_id, scores[, extra...])`` -> per (family, extra..., wtp) results."""
    sc = scored.join(family_prices(rd, prices), "family").join(_answers(rd), ["family", "query_id"])
    r = with_choice(route(sc, wtp_values))
    g = r.groupBy("family", *extra_cols, "wtp").agg(F.avg("performance").alias("performance"),
                                                    F.sum(F.col("cost_pico").cast(MONEY)).alias("total_cost_pico"))
    return g.select(F.col("family").alias("eval_name"), *extra_cols, "wtp", "performance", "total_cost_pico")


def svr_results(rd: RoutingData, prices: DataFrame, embedding: str = "given",
                wtp_values: list[float] = WTP_GRID) -> DataFrame:
    """Linear absolute-error predictors per family and model, routed over the wtp grid."""
    return routed_results(rd, prices, ROUTERS["svm"], Grid(wtp_values=wtp_values), embedding)


def mlp_configs(hidden=MLP_HIDDEN_LAYERS, activations=MLP_ACTIVATIONS, rates=MLP_LEARNING_RATES) -> list[tuple]:
    """The grid of (hidden sizes, activation, learning rate)."""
    return [(tuple(h), a, lr) for h in hidden for a in activations for lr in rates]


def mlp_results(rd: RoutingData, prices: DataFrame, epochs: int = MLP_EPOCHS, embedding: str = "given",
                wtp_values: list[float] = WTP_GRID) -> DataFrame:
    """MLP predictors for every configuration of the grid, all trained in the same passes."""
    return routed_results(rd, prices, ROUTERS["mlp"], Grid(mlp_epochs=epochs, wtp_values=wtp_values), embedding)


def cascade_split_results(rd: RoutingData, prices: DataFrame, budgets: list[float] = CASCADE_BUDGETS,
                          error_rates: list[float] = CASCADE_ERROR_RATES) -> DataFrame:
    """The cascade over the budget x judge-error grid on the test split of every family."""
    te = rd.long.where(F.col("split") == "test").withColumn("eval_name", F.col("family"))
    thr = accept_thresholds(te)
    lengths = te.groupBy("eval_name", "model", "model_idx").agg(F.avg("response_tokens").alias("avg_response_tokens"))
    price = price_vectors(prices, lengths, rd.n_models, ["eval_name"])
    res = cascade_results(simulate(order_chains(to_answers(te), price, thr), budgets, error_rates))
    return res.withColumn("router", F.lit(CASCADE_ROUTER))


ROUTER_FAMILIES = ("knn", "svm", "mlp", CASCADE_ROUTER)


@dataclass
class Grid:
    """Every router family's hyper-parameter grid; the defaults are the surveyed evaluator's."""

    neighbors: list[int] = field(default_factory=lambda: list(KNN_NEIGHBORS))
    metrics: list[str] = field(default_factory=lambda: list(KNN_METRICS))
    mlp_hidden_layers: list = field(default_factory=lambda: list(MLP_HIDDEN_LAYERS))
    mlp_activations: list[str] = field(default_factory=lambda: list(MLP_ACTIVATIONS))
    mlp_learning_rates: list[float] = field(default_factory=lambda: list(MLP_LEARNING_RATES))
    mlp_epochs: int = MLP_EPOCHS
    wtp_values: list[float] = field(default_factory=lambda: list(WTP_GRID))
    cascade_budgets: list[float] = field(default_factory=lambda: list(CASCADE_BUDGETS))
    cascade_error_rates: list[float] = field(default_factory=lambda: list(CASCADE_ERROR_RATES))
    fraction: float = TRAIN_FRACTION         # the split's; the job's own option sets it


@dataclass(frozen=True)
class Router:
    """A router that predicts every model's performance on a prompt from other prompts' vectors.

    ``fit(train, n_models, grid)`` gives its weights as a table that can be written and read back;
    ``score(test, weights, n_models, grid)`` gives ``(family, query_id, scores array<double>)`` and a column
    for every name in ``params``, one row per prompt and point of the grid.  The rows of ``train`` and
    ``test`` are prompts: family, sample_id, embedding, perf (grades by model index), answers.
    """

    name: str
    fit: Callable[[DataFrame, int, Grid], DataFrame]
    score: Callable[[DataFrame, DataFrame, int, Grid], DataFrame]
    params: tuple[str, ...] = ()


ROUTERS: dict[str, Router] = {}


def register_router(router: Router) -> Router:
    """Makes a router known to the evaluation by its name; a later one replaces an earlier one."""
    if router.name == CASCADE_ROUTER:
        raise ValueError(f"{CASCADE_ROUTER} predicts nothing from vectors and can't be replaced")
    ROUTERS[router.name] = router
    return router


def _width(rows: DataFrame) -> int:
    return rows.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()[0]


def _fit_knn(train: DataFrame, n_models: int, grid: Grid) -> DataFrame:
    return train.select("family", "sample_id", "embedding", "perf")


def _score_knn(test: DataFrame, weights: DataFrame, n_models: int, grid: Grid) -> DataFrame:
    """One ranking at the largest k serves every k of a metric."""
    parts = [neighbor_scores(knn_topk(test, weights, max(grid.neighbors), ["family"], metric=m, payload="perf"),
                             grid.neighbors, n_models, ["family"]).withColumn("metric", F.lit(m)) for m in grid.metrics]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({"neighbors": F.col("k").cast("int"), "fraction": F.lit(float(grid.fraction))}).drop("k")


def _fit_svm(train: DataFrame, n_models: int, grid: Grid) -> DataFrame:
    return fit_linear_abs(train, n_models, _width(train), group="family", key="sample_id")


def _score_svm(test: DataFrame, weights: DataFrame, n_models: int, grid: Grid) -> DataFrame:
    return test.join(linear_weights_table(weights, "family"), "family").select(
        "family", F.col("sample_id").alias("query_id"), linear_scores().alias("scores"))


def _mlp_grid(grid: Grid) -> list[tuple]:
    return mlp_configs(grid.mlp_hidden_layers, grid.mlp_activations, grid.mlp_learning_rates)


def _fit_mlp(train: DataFrame, n_models: int, grid: Grid) -> DataFrame:
    return fit_mlp_grid(train, n_models, _width(train), _mlp_grid(grid), epochs=grid.mlp_epochs, group="family", key="sample_id")


def _score_mlp(test: DataFrame, weights: DataFrame, n_models: int, grid: Grid) -> DataFrame:
    configs = _mlp_grid(grid)
    # printed as configured: 100 -> "(100,)", [100, 100] -> "([100, 100],)"
    named = F.array(*[F.struct(F.lit(f"({h[0]},)" if len(h) == 1 else f"({list(h)},)").alias("hidden_layer_sizes"),
                               F.lit(a).alias("activation_function"), F.lit("constant").alias("learning_rate_method"),
                               F.lit(float(lr)).alias("learning_rate")) for h, a, lr in configs])
    return (mlp_scores(test, weights, configs, n_models, _width(test), "sample_id", group="family")
            .withColumn("c", named[F.col("net")])
            .select("family", F.col("sample_id").alias("query_id"), "scores", "c.*"))


register_router(Router("knn", _fit_knn, _score_knn, ("neighbors", "metric", "fraction")))
register_router(Router("svm", _fit_svm, _score_svm))
register_router(Router("mlp", _fit_mlp, _score_mlp,
                       ("hidden_layer_sizes", "activation_function", "learning_rate_method", "learning_rate")))


def weights_of(weights_path: str, router: str, embedding: str) -> str:
    """Where the weights of a router in a vector space are kept."""
    return f"{weights_path}/router={router}/embedding={embedding}"


def saved_scores(test: DataFrame, weights_path: str, router: str, embedding: str, n_models: int,
                 grid: Grid | None = None) -> DataFrame:
    """Scores of prompts (family, sample_id, embedding) by a router's kept weights, nothing fitted anew;
    ``grid`` is the one that the weights were fitted with."""
    known = ROUTERS[router]
    weights = test.sparkSession.read.parquet(weights_of(weights_path, router, embedding))
    return known.score(test, weights, n_models, Grid() if grid is None else grid)


def routed_results(rd: RoutingData, prices: DataFrame, router: Router, grid: Grid, embedding: str = "given",
                   weights_path: str | None = None) -> DataFrame:
    """A router fitted on the train prompts, its scores on the test prompts routed over the wtp grid.
    With ``weights_path`` the weights are written there first and read back for scoring."""
    weights = router.fit(rd.samples.where(F.col("split") == "train"), rd.n_models, grid)
    if weights_path:
        path = weights_of(weights_path, router.name, embedding)
        weights.write.mode("overwrite").parquet(path)
        weights = rd.samples.sparkSession.read.parquet(path)
    scored = router.score(rd.samples.where(F.col("split") == "test"), weights, rd.n_models, grid)
    out = _scored_results(rd, prices, scored, router.params, grid.wtp_values)
    return out.select("eval_name", F.lit(router.name).alias("router"), *router.params, F.lit(embedding).alias("embedding"),
                      "wtp", "performance", "total_cost_pico")


def in_space(rd: RoutingData, store: DataFrame, name: str) -> RoutingData:
    """``rd`` with the prompts' vectors of one embedding model.

    The prompts carry their cache keys (``embedding`` is a struct with a key per model); the store is
    partitioned by model, so a space reads its own vectors only, whatever their width.
    """
    vectors = (store.where(F.col("embedding_model") == name).dropDuplicates(["hash"])
               .select(F.col("hash").alias("_h"), F.col("embedding").alias("_v")))
    keyed = rd.samples.withColumn("_h", F.col("embedding")[name]).drop("embedding")
    return RoutingData(rd.long, materialize(keyed.join(vectors, "_h").drop("_h").withColumnRenamed("_v", "embedding"), "routing-space"),
                       rd.n_models)


def evaluate_grid(rd: RoutingData, spaces: dict[str, RoutingData], prices: DataFrame, grid: Grid | None = None,
                  routers: tuple = ROUTER_FAMILIES, fraction: float = TRAIN_FRACTION,
                  weights_path: str | None = None) -> DataFrame:
    """The evaluation job end to end: the chosen routers' variants x wtp in every vector space (kNN also
    under every metric; any registered router by its name), the cascade over its own grid, and the LLM /
    oracle baselines, in one long table.  Baselines and cascade need no vectors and are worked out once."""
    grid = replace(Grid() if grid is None else grid, fraction=fraction)
    unknown = set(routers) - set(ROUTERS) - {CASCADE_ROUTER}
    if unknown:
        raise ValueError(f"unknown router families {sorted(unknown)}")
    parts = [routed_results(own, prices, ROUTERS[r], grid, name, weights_path)
             for name, own in spaces.items() for r in routers if r != CASCADE_ROUTER]
    if CASCADE_ROUTER in routers:
        parts.append(cascade_split_results(rd, prices, grid.cascade_budgets, grid.cascade_error_rates))
    out = baseline_results(rd)
    for part in parts:
        out = part.unionByName(out, allowMissingColumns=True)
    return out


def evaluate_all(rd: RoutingData, prices: DataFrame, ks: list[int] = KNN_NEIGHBORS,
                 mlp_epochs: int = MLP_EPOCHS, routers: tuple = ROUTER_FAMILIES) -> DataFrame:
    """:func:`evaluate_grid` in the one vector space that the prompts carry ("given")."""
    return evaluate_grid(rd, {"given": rd}, prices, Grid(neighbors=list(ks), mlp_epochs=mlp_epochs), routers)
