"""Graded-answer tables derived from the driver's parquet tables.

The evaluator's real inputs (graded answers of many models to benchmark
prompts) are derived deterministically from ``documents``, ``embeddings``,
``conversations`` and ``labels`` so that Spark and DuckDB see identical data.
Every derivation is a projection/explode of the source rows: its size grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.constants import WTP_GRID, WTP_TEXT
from routelens.functions.hashing import uniform01
from routelens.operators.embed import hash_embed
from routelens.sources.tables import dealt, read_table

N_MODELS = 5
EMBEDDING_DIM = 64


def eval_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval_long``: one row per (prompt, model) with performance, response and cost.

    documents x models m = 0..4 (a generator, not a join).
    """
    return eval_long_from(dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def eval_long_from(d: DataFrame, keep: tuple = ()) -> DataFrame:
    """``eval_long`` rows for the given documents (extra columns in ``keep`` are carried)."""
    # the words do not depend on the model: split once per document
    d = d.withColumn("_words", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))
    d = d.withColumns({"_n": F.size("_words").cast("long"), "_joined": F.array_join("_words", " ")}).drop("_words")
    x = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("m"))
    m = F.col("m")
    u = uniform01(F.col("doc_id"), m)
    # model m answers with the words whose position leaves a remainder of at most m by five: m4 with all
    # of every five words (the last may be fewer) those behind the first m + 1 are cut out of the joined text
    rest = F.concat(F.lit(r"(?<!\S)((?:\S++ ){"), m.cast("string"), F.lit(r"}\S++)(?: \S++){1,"), (N_MODELS - 1 - m).cast("string"), F.lit("}"))
    resp = F.when(m == N_MODELS - 1, F.col("_joined")).otherwise(F.regexp_replace(F.col("_joined"), rest, F.lit("$1")))
    n = F.col("_n")
    n_said = F.when(n < 0, n).otherwise(F.floor(n / N_MODELS) * (m + 1) + F.least(n % N_MODELS, (m + 1).cast("long")))
    perf = (F.when(((F.col("doc_id") + m) % 97) == 0, F.lit(None).cast("double"))
            .when(u < F.lit(0.15) + F.lit(0.12) * m, F.lit(1.0))
            .when(u < F.lit(0.20) + F.lit(0.12) * m, F.lit(0.5))
            .otherwise(F.lit(0.0)))
    mm = (m + 1).cast("long")
    cost = (n * 100000 * mm + n_said * 200000 * mm
            + F.when(m == 4, F.lit(5000000000)).otherwise(F.lit(0)).cast("long"))
    return x.select(
        F.col("doc_id"),
        F.concat_ws(".", "lang", "source", F.col("doc_id").cast("string")).alias("sample_id"),
        F.concat_ws("-", "lang", "source").alias("eval_name"),
        F.col("lang").alias("family"),
        F.col("source"),
        F.array(F.col("text")).alias("prompt"),
        F.concat(F.lit("m"), m.cast("string")).alias("model"),
        m.cast("int").alias("model_idx"),
        perf.alias("performance"),
        F.array(resp).alias("response"),
        cost.alias("cost_pico"),
        *keep,
    )


def model_price(spark: SparkSession) -> DataFrame:
    """Price list of the fixture models (pico-USD per token); m4 has a request fee."""
    m = F.col("id")
    return spark.range(N_MODELS).select(
        F.concat(F.lit("m"), m.cast("string")).alias("model"),
        (F.lit(100000) * (m + 1)).cast("long").alias("prompt_pico"),
        (F.lit(200000) * (m + 1)).cast("long").alias("completion_pico"),
        F.when(m == 4, F.lit(5000000000)).cast("long").alias("request_pico"),
    )


def router_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long answers of every prompt with its embedding: the held vector (``doc_id = vec_id``) where
    there is one, else the hash embedder's of the same width."""
    d = dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    # join before deriving answers: the vectors are carried, not repeated work per answer
    return eval_long_from(d.join(router_vectors(spark, sf_dir), "doc_id"), keep=("embedding",))


def router_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, embedding)`` as :func:`router_samples` has them.  Texts are embedded where they are read and
    the held vectors' ids met by vectors, so that no text is shuffled."""
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = hash_embed(d, "text", "doc_id", EMBEDDING_DIM)
    return emb.unionByName(made.join(emb.select("doc_id"), "doc_id", "left_anti"))


def log_file_no(conv_id):
    """Which run log a conversation is in: seven for every 5,000 ids, so their number grows with the table."""
    return conv_id % 7 + F.floor(conv_id / 5000) * 7


def _conv_file(conv_id):
    return F.concat(F.lit("conv"), log_file_no(conv_id).cast("string"), F.lit(".jsonl"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log events derived from ``conversations``.

    file = conv<k>.jsonl (k: :func:`log_file_no`), sample = conversation, event position = turn;
    user and system turns are sampling events carrying a prompt, assistant turns
    carry a sampled answer; the grade (``labels.quality``)
    is a final match event, NULL when the conversation has no label.
    """
    conv = read_table(spark, sf_dir, "conversations")
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"),
                                                    F.col("quality").cast("double").alias("correct"))
    asked = F.col("role") != "assistant"
    ev = conv.select(
        _conv_file(F.col("conv_id")).alias("file"),
        F.col("conv_id").cast("string").alias("sample_id"),
        F.col("turn").alias("pos"),
        F.lit("sampling").alias("type"),
        F.when(asked, F.array(F.col("text"))).alias("prompt"),
        F.when(asked, F.lit(False)).alias("is_completion"),
        F.when(F.col("role") == "assistant", F.array(F.col("text"))).alias("sampled"),
        F.lit(None).cast("double").alias("correct"),
        F.lit(None).cast("string").alias("created_at"),
    )
    last_turn = conv.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    match = last_turn.join(lab, "conv_id", "left").select(
        _conv_file(F.col("conv_id")).alias("file"),
        F.col("conv_id").cast("string").alias("sample_id"),
        (F.col("last_turn") + 1).alias("pos"),
        F.lit("match").alias("type"),
        F.lit(None).cast("array<string>").alias("prompt"),
        F.lit(None).cast("boolean").alias("is_completion"),
        F.lit(None).cast("array<string>").alias("sampled"),
        F.col("correct"),
        F.lit(None).cast("string").alias("created_at"),
    )
    return ev.unionByName(match)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run logs as JSON lines ``(file, pos, line)``.

    Each file conv<k>.jsonl starts with a spec record (model m<k % 5>, eval
    conv-<k>); events follow at pos = 100 * conv_id + turn + 1, the grade of
    labelled conversations last (a boolean ``correct``).  Three files must be
    skipped by readers: conv3.jsonl gets an unparsable line, a ``_bak`` copy of
    conv2 exists, and short.jsonl holds only two records.
    """
    conv = read_table(spark, sf_dir, "conversations")
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    k = log_file_no(F.col("conv_id"))
    files = conv.select("conv_id").select(k.alias("k")).distinct()
    header = files.select(
        F.concat(F.lit("conv"), F.col("k").cast("string"), F.lit(".jsonl")).alias("file"),
        F.lit(0).cast("long").alias("pos"),
        F.to_json(F.struct(F.struct(
            F.array(F.concat(F.lit("raw_models/m"), (F.col("k") % 5).cast("string"))).alias("completion_fns"),
            F.concat(F.lit("conv-"), F.col("k").cast("string")).alias("eval_name")).alias("spec"))).alias("line"))
    data = F.when(F.col("role") != "assistant", F.struct(
        F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("prompt"),
        F.lit(None).cast("array<string>").alias("sampled"))).otherwise(F.struct(
        F.lit(None).cast("array<struct<role:string,content:string>>").alias("prompt"),
        F.array(F.col("text")).alias("sampled")))
    events = conv.select(
        _conv_file(F.col("conv_id")).alias("file"),
        (F.col("conv_id") * 100 + F.col("turn") + 1).alias("pos"),
        F.to_json(F.struct(
            F.concat(F.lit("run"), k.cast("string")).alias("run_id"),
            F.col("conv_id").cast("string").alias("sample_id"),
            F.lit("sampling").alias("type"),
            data.alias("data"))).alias("line"))
    grades = (conv.select("conv_id").distinct().join(lab, "conv_id", "inner").select(
        _conv_file(F.col("conv_id")).alias("file"),
        (F.col("conv_id") * 100 + 99).alias("pos"),
        F.to_json(F.struct(
            F.concat(F.lit("run"), k.cast("string")).alias("run_id"),
            F.col("conv_id").cast("string").alias("sample_id"),
            F.lit("match").alias("type"),
            F.struct((F.col("quality") == 1).alias("correct")).alias("data"))).alias("line")))
    base = header.unionByName(events).unionByName(grades)
    broken = base.where(F.col("file") == "conv3.jsonl").where(F.col("pos") == 0).select(
        "file", F.lit(1).cast("long").alias("pos"), F.lit("{not json").alias("line"))
    bak = base.where(F.col("file") == "conv2.jsonl").select(
        F.lit("conv2_bak.jsonl").alias("file"), "pos", "line")
    short = base.where(F.col("file") == "conv1.jsonl").where(F.col("pos") == 0).select(
        F.lit("short.jsonl").alias("file"), "pos", "line").unionByName(
        base.where(F.col("file") == "conv1.jsonl").where(F.col("pos") == 0).select(
            F.lit("short.jsonl").alias("file"), F.lit(1).cast("long").alias("pos"), "line"))
    return base.unionByName(broken).unionByName(bak).unionByName(short)


def model_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs of three models for every conversation as JSON lines ``(file, pos, line)``.

    Each group of conversations (:func:`log_file_no`) has a file per model, models k, k + 1 and k + 3 modulo
    five.  The first two earn the label's grade (ties), the third says its answers twice and is right on
    every third conversation.  Some conversations lack the second model's grade, some put a further
    question to the third model only; in group 3 the second model's file has an unparsable line.
    """
    conv = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", log_file_no(F.col("conv_id")).alias("k"))
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    o, k, cid = F.col("o"), F.col("k"), F.col("conv_id")
    model = F.concat(F.lit("m"), ((k + F.when(o == 2, 3).otherwise(o)) % 5).cast("string"))
    file = F.concat(F.lit("conv"), k.cast("string"), F.lit("-"), model, F.lit(".jsonl"))

    def runs(rows):
        return rows.withColumn("o", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))

    def record(kind, data):
        return F.to_json(F.struct(F.concat(F.lit("run"), k.cast("string")).alias("run_id"), cid.cast("string").alias("sample_id"),
                                  F.lit(kind).alias("type"), data.alias("data"))).alias("line")

    said = F.when(o == 2, F.concat_ws(" ", "text", "text")).otherwise(F.col("text"))
    turns = runs(conv).select(file.alias("file"), (cid * 100 + F.col("turn") + 1).alias("pos"), record("sampling", F.struct(
        F.when(F.col("role") != "assistant", F.array(F.struct("role", F.col("text").alias("content")))).alias("prompt"),
        F.when(F.col("role") == "assistant", F.array(said)).alias("sampled"))))
    each = runs(conv.select("conv_id", "k").distinct())
    more = each.where((o == 2) & (cid % 11 == 5)).select(file.alias("file"), (cid * 100 + 98).alias("pos"), record(
        "sampling", F.struct(F.array(F.struct(F.lit("user").alias("role"), F.lit("again").alias("content"))).alias("prompt"))))
    right = F.when(o == 2, cid % 3 == 0).otherwise(F.col("quality") == 1)
    grades = each.where(~((o == 1) & (cid % 13 == 4))).join(lab, "conv_id").select(
        file.alias("file"), (cid * 100 + 99).alias("pos"), record("match", F.struct(right.alias("correct"))))
    files = runs(conv.select("k").distinct())
    header = files.select(file.alias("file"), F.lit(0).cast("long").alias("pos"), F.to_json(F.struct(F.struct(
        F.array(F.concat(F.lit("raw_models/"), model)).alias("completion_fns"),
        F.concat(F.lit("conv-"), k.cast("string")).alias("eval_name")).alias("spec"))).alias("line"))
    broken = files.where((k == 3) & (o == 1)).select(file.alias("file"), F.lit(1).cast("long").alias("pos"), F.lit("{not json").alias("line"))
    return header.unionByName(turns).unionByName(more).unionByName(grades).unionByName(broken)


def variant_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router results per (eval, variant, wtp point) aggregated from ``documents``.

    v = doc_id % 5 is the variant (kNN with 5 (v+1) neighbours, embedding e<v % 2>),
    w = floor(doc_id / 5) % 32 indexes the wtp grid.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    g = d.select(
        F.col("lang").alias("eval_name"),
        (F.col("doc_id") % 5).cast("int").alias("v"),
        (F.floor(F.col("doc_id") / 5) % 32).cast("int").alias("w"),
        (((F.col("doc_id") * 37 + F.col("doc_id") % 5) % 23).cast("double") / F.lit(23.0)).alias("score"),
        F.col("n_chars"),
    )
    wtp = F.element_at(F.array(*[F.lit(x) for x in WTP_GRID]), F.col("w") + 1)
    return (g.groupBy("eval_name", "v", "w")
            .agg(F.round(F.avg("score"), 9).alias("performance"), F.sum("n_chars").alias("total_cost"))
            .select(
                "eval_name",
                F.lit("knn").alias("router"),
                (F.col("v") * 5 + 5).alias("neighbors"),
                F.lit("cosine").alias("metric"),
                F.concat(F.lit("e"), (F.col("v") % 2).cast("string")).alias("embedding"),
                wtp.alias("willingness_to_pay"),
                "w", "v", "performance", "total_cost"))


def _py_repr(s):
    """Printed form of a string inside a printed list (quote choice and escapes of the
    surveyed pipeline's stringified lists)."""
    has_sq, has_dq = s.contains("'"), s.contains('"')
    dq = has_sq & ~has_dq
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(raw), F.lit(code))
    esc = F.when(dq, esc).otherwise(F.replace(esc, F.lit("'"), F.lit("\\'")))
    q = F.when(dq, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(q, esc, q)


def stringified_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, its user and system turns as a stringified list ``"['t1', 't2']"`` (as stored in
    pickled/CSV long tables)."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") != "assistant")
    g = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    texts = F.transform(F.col("_t"), lambda x: x["text"])
    return g.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform(texts, _py_repr), ", "), F.lit("]"))
                    .alias("prompt_text"))


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling events with the two prompt shapes of run logs: even conversations carry a chat
    list per user or system turn, odd ones a completion string (turn text + newline)."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") != "assistant")
    chat = F.to_json(F.struct(F.lit("sampling").alias("type"), F.col("conv_id").cast("string").alias("sample_id"),
                              F.struct(F.array(F.struct("role", F.col("text").alias("content")))
                                       .alias("prompt")).alias("data")))
    comp = F.to_json(F.struct(F.lit("sampling").alias("type"), F.col("conv_id").cast("string").alias("sample_id"),
                              F.struct(F.concat(F.col("text"), F.lit("\n")).alias("prompt")).alias("data")))
    return conv.select(F.lit("prompts.jsonl").alias("file"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"),
                       F.when(F.col("conv_id") % 2 == 0, chat).otherwise(comp).alias("line"))


def list_literal(arr):
    """Printed form of an ``array<string>`` column (``['a', "b's"]``), as stored in CSV long tables."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, _py_repr), ", "), F.lit("]"))


def fixture_variant_names() -> list[str]:
    """Every variant name of ``variant_results`` (its grid: v = 0..4, all 32 wtp points)."""
    return [f"knn|neighbors:{5 * v + 5}|metric:cosine|embedding:e{v % 2}|willingness_to_pay:{t}"
            for v in range(5) for t in WTP_TEXT]
