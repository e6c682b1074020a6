"""Registered queries: splits, leak check, embedding cache keys/misses/fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.operators.cost import with_token_cost
from routelens.operators.embed import cache_misses, embed_with_cache, encoder_embed, hash_embed, with_cache_key
from routelens.operators.oracle import oracle_label
from routelens.functions.text import n_tokens
from routelens.operators.split import families, leak_check, split_by_source, split_samples
from routelens.plans.registry import query
from routelens.session import scratch_path
from routelens.sources.fixtures import eval_long, eval_long_from, model_price
from routelens.sources.tables import dealt, read_table

EMBED_MODEL = "hash32"


def _samples(spark, sf_dir):
    """The prompts, straight from the documents (an answer per model would repeat each five times)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("family"), "source",
                    F.concat_ws(".", "lang", "source", F.col("doc_id").cast("string")).alias("sample_id"))


@query("q_split_samples")
def q_split_samples(spark, sf_dir):
    return split_samples(_samples(spark, sf_dir)).select("family", "sample_id", "split")


@query("q_split_sources")
def q_split_sources(spark, sf_dir):
    return split_by_source(_samples(spark, sf_dir)).select("family", "sample_id", "split")


@query("q_split_ood")
def q_split_ood(spark, sf_dir):
    """Every family as the wanted one: the train parts of the others and its own test part."""
    samples = _samples(spark, sf_dir)
    wanted = F.array(*map(F.lit, families(samples))).cast("array<string>")
    split = split_samples(samples).select("*", F.explode(wanted).alias("wanted"))
    own = F.col("family") == F.col("wanted")
    return split.where(own & (F.col("split") == "test") | ~own & (F.col("split") == "train")).select(
        "wanted", "family", "sample_id", "split")


@query("q_split_leak_check")
def q_split_leak_check(spark, sf_dir):
    return leak_check(split_samples(_samples(spark, sf_dir)))


def _prompts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))


def _initial_store(spark, sf_dir):
    """The cache as it stands before the run: prompts of every third document, embedded."""
    held = _prompts(spark, sf_dir).where(F.col("doc_id") % 3 == 0)
    keyed = with_cache_key(held, "prompt", EMBED_MODEL)
    emb = hash_embed(keyed.select("hash", "prompt").dropDuplicates(["hash"]), "prompt", "hash")
    return keyed.select("hash", "prompt").dropDuplicates(["hash"]).join(emb, "hash").select(
        "hash", F.lit(EMBED_MODEL).alias("embedding_model"), "prompt", "embedding")


@query("q_cache_keys")
def q_cache_keys(spark, sf_dir):
    return with_cache_key(_prompts(spark, sf_dir), "prompt", EMBED_MODEL).select("doc_id", "hash")


@query("q_cache_misses")
def q_cache_misses(spark, sf_dir):
    return cache_misses(_prompts(spark, sf_dir), _initial_store(spark, sf_dir), EMBED_MODEL).select("hash")


@query("q_embed_cache")
def q_embed_cache(spark, sf_dir):
    path = scratch_path(spark, "embedding-store")
    _initial_store(spark, sf_dir).write.mode("overwrite").partitionBy("embedding_model").parquet(path)
    store = spark.read.parquet(path)
    out = embed_with_cache(_prompts(spark, sf_dir), store, EMBED_MODEL,
                           lambda m: hash_embed(m, "prompt", "hash"), append_to=path)
    x = out.select("doc_id", F.posexplode("embedding").alias("bucket", "v"))
    return x.where(F.col("v") != 0).select("doc_id", "bucket", F.round(F.col("v").cast("double"), 6).alias("value"))


def hash32_encoder():
    """A user-style encoder (Python, per task): the hash embedder written with hashlib/numpy.
    Whitespace is the ASCII set, as in the JVM tokeniser."""
    import hashlib
    import re

    import numpy as np
    tok = re.compile(r"[^ \t\n\x0b\f\r]+")

    def enc(texts):
        out = np.zeros((len(texts), 32))
        for r, t in enumerate(texts):
            for w in tok.findall(t.lower()):
                h = hashlib.md5(w.encode("utf-8")).hexdigest()
                out[r, int(h[:4], 16) % 32] += 1.0 if h[4] < "8" else -1.0
            n = np.sqrt((out[r] ** 2).sum())
            if n > 0:
                out[r] /= n
        return out
    return enc


@query("q_encoder_embed")
def q_encoder_embed(spark, sf_dir):
    """Embedding through the encoder plug-in (Arrow batches); must equal the built-in embedder."""
    d = _prompts(spark, sf_dir)
    e = encoder_embed(d, "prompt", "doc_id", hash32_encoder, 32)
    x = e.select("doc_id", F.posexplode("embedding").alias("bucket", "v"))
    return x.where(F.col("v") != 0).select("doc_id", "bucket", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("q_convert_and_embed")
def q_convert_and_embed(spark, sf_dir):
    """Convert (price + oracle) and attach each prompt's embedding from the cache."""
    d = dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    # a prompt's tokens are counted once, not for every model's answer
    el = eval_long_from(d.withColumn("prompt_tokens", n_tokens("text")), keep=("prompt_tokens",)).drop("cost_pico")
    lab = oracle_label(with_token_cost(el, model_price(spark), "prompt_tokens")).select("sample_id", "oracle")
    prompts = el.where(F.col("model_idx") == 0).select("sample_id", F.element_at("prompt", 1).alias("prompt"))
    emb = embed_with_cache(prompts, _initial_store(spark, sf_dir), EMBED_MODEL,
                           lambda m: hash_embed(m, "prompt", "hash"))
    return emb.join(lab, "sample_id").select(
        "sample_id", "oracle", "hash", F.size(F.filter("embedding", lambda v: v != 0)).alias("n_nonzero"))
