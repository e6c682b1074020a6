"""Run-log parsing and folding: JSON lines -> one graded answer per (file, sample)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.functions.logs import (chat_contents, completion_prompt, drop_last_response,
                                      metric_value)

CHAT = "array<struct<role:string,content:string>>"


def _get(v, path: str, typ: str):
    return F.try_variant_get(v, path, typ)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """``(file, pos, line)`` -> typed event columns; a line that is not JSON has ``bad = true``.

    Values are read through VARIANT so that fields whose JSON type varies
    (prompt as chat list or string, grade as bool or number) are typed per row.
    """
    v = F.try_parse_json(F.col("line"))
    prompt_chat = _get(v, "$.data.prompt", CHAT)
    # a list read as ``string`` yields its JSON text, so the chat form is tried first
    prompt_str = F.when(prompt_chat.isNull(), _get(v, "$.data.prompt", "string"))
    sampled = F.coalesce(_get(v, "$.data.sampled", "array<string>"),
                         F.when(_get(v, "$.data.sampled", "string").isNotNull(),
                                F.array(_get(v, "$.data.sampled", "string"))))
    typ = _get(v, "$.type", "string")
    correct = (F.when(typ == "match", _get(v, "$.data.correct", "double"))
               .when(typ == "metrics", metric_value(_get(v, "$.data.accuracy", "double"),
                                                    _get(v, "$.data.score", "double"),
                                                    _get(v, "$.data.choice", "string"),
                                                    _get(v, "$.data.sacrebleu_sentence_score", "double"))))
    return lines.select(
        "file", "pos",
        v.isNull().alias("bad"),
        F.element_at(_get(v, "$.spec.completion_fns", "array<string>"), 1).alias("completion_fn"),
        _get(v, "$.spec.eval_name", "string").alias("spec_eval_name"),
        _get(v, "$.run_id", "string").alias("run_id"),
        _get(v, "$.sample_id", "string").alias("sample_id"),
        typ.alias("type"),
        _get(v, "$.created_at", "string").alias("created_at"),
        F.when(typ == "sampling", F.coalesce(chat_contents(prompt_chat),
                                            F.when(prompt_str.isNotNull(), F.array(prompt_str)))).alias("prompt"),
        F.when(typ == "sampling", prompt_chat.isNull() & prompt_str.isNotNull()).alias("is_completion"),
        F.when(typ == "sampling", sampled).alias("sampled"),
        correct.alias("correct"),
    )


def attach_header(parsed: DataFrame, min_records: int = 3) -> DataFrame:
    """Keep files with no unparsable line and at least ``min_records`` records, and give every
    event the file's model (first record's completion fn, ``raw_models/`` removed) and eval.

    One partial aggregate per file (tiny) joined back on ``file``; AQE turns the
    join into a broadcast at run time because it sees the aggregate's real size.
    """
    per_file = parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.col("bad").cast("int")).alias("_bad"),
        F.min_by(F.struct(F.regexp_replace(F.col("completion_fn"), "^raw_models/", "").alias("model"),
                          F.col("spec_eval_name").alias("eval_name")), F.col("pos")).alias("_h"),
    ).where((F.col("_bad") == 0) & (F.col("_n") >= min_records)).select(
        "file", F.col("_h.model").alias("model"), F.col("_h.eval_name").alias("eval_name"))
    return parsed.join(per_file, "file", "inner")


def fold_events(events: DataFrame, extra_keys: tuple = ()) -> DataFrame:
    """Per (file, sample): prompts and responses of sampling events in position order, the
    first ``created_at``, and the last grade (match / metrics) by position.

    Completion-style prompts (strings) are joined and lose their final character;
    responses drop the final one when there are several.  ``extra_keys``: columns fixed per
    file (e.g. the header's model and eval) carried through the same aggregate.
    """
    has_p = F.col("prompt").isNotNull()
    has_s = F.col("sampled").isNotNull()
    g = events.groupBy("file", "sample_id", *extra_keys).agg(
        F.array_sort(F.collect_list(F.when(has_p, F.struct("pos", "prompt")))).alias("_p"),
        F.array_sort(F.collect_list(F.when(has_s, F.struct("pos", "sampled")))).alias("_s"),
        F.max_by(F.col("correct"), F.when(F.col("correct").isNotNull(), F.col("pos"))).alias("correct"),
        F.min_by(F.col("created_at"), F.col("pos")).alias("created_at"),
        F.max(F.coalesce(F.col("is_completion"), F.lit(False))).alias("_completion"),
    )
    prompts = F.flatten(F.transform(F.col("_p"), lambda x: x["prompt"]))
    sampled = F.flatten(F.transform(F.col("_s"), lambda x: x["sampled"]))
    return g.select(
        "file", "sample_id", *extra_keys, "created_at",
        F.when(F.col("_completion"), completion_prompt(prompts)).otherwise(prompts).alias("prompt"),
        drop_last_response(sampled).alias("sampled"),
        "correct",
    )


def meet_models(graded: DataFrame) -> DataFrame:
    """Graded answers of run logs of several models -> one row per prompt with all models' answers.

    ``graded(sample_id, eval_name, model, model_idx, prompt, response, performance)``.  Answers meet by eval,
    sample and the prompts themselves (their hash, ``prompt_key``): a model that was asked something else under
    the same ids is a prompt of its own.  ``answers`` is bounded by the number of models where each
    answered once (``dedupe_first``); a row of a null prompt or null ids meets its equals.
    """
    key = F.sha2(F.to_json("prompt"), 256)
    return graded.groupBy("sample_id", "eval_name", key.alias("prompt_key")).agg(
        F.first("prompt").alias("prompt"),
        F.collect_list(F.struct("model", "model_idx", "performance", "response")).alias("answers"))


def keep_log_path(c: str = "file") -> F.Column:
    """Run-log files: path contains ``.jsonl`` and not ``_bak``."""
    return F.col(c).contains(".jsonl") & ~F.col(c).contains("_bak")


def scan_run_logs(spark, path: str, whole_files: bool = False) -> DataFrame:
    """Read a directory tree of JSONL run logs into ``(file, pos, line)``; ``pos`` orders the
    lines of a file exactly (any orderable value; the first line has the smallest).

    Default: a splittable line scan, so one huge file is read by many tasks.  The order key is
    ``(split offset in the file, row id)``: a split's lines arrive in file order, and
    ``monotonically_increasing_id`` grows with them inside a partition (the same ids are
    produced on a task retry).  ``whole_files=True`` reads every file as one row instead
    (one task per file, files under 2 GB).  Paths without ``.jsonl`` or with ``_bak`` are
    skipped; blank lines are ignored.
    """
    if whole_files:
        # text() resets its own keyword options, so wholetext must be passed as an argument
        raw = (spark.read.text(path, wholetext=True, recursiveFileLookup=True)
               .select(F.col("value"), F.col("_metadata.file_path").alias("file")))
        raw = raw.where(keep_log_path("file"))
        lines = raw.select("file", F.posexplode(F.split(F.col("value"), "\n")).alias("pos", "line"))
    else:
        raw = spark.read.text(path, recursiveFileLookup=True).select(
            F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_row"))
        lines = raw.where(keep_log_path("file")).select(
            "file", F.struct(F.col("_blk").alias("block"), F.col("_row").alias("row")).alias("pos"), "line")
    return lines.where(F.trim(F.col("line")) != "")


def write_run_logs(lines: DataFrame, path: str) -> None:
    """Write ``(file, pos, line)`` as one JSONL file per ``file`` value, lines in ``pos`` order."""
    (lines.repartition("file").sortWithinPartitions("file", "pos")
     .select("file", "line").write.mode("overwrite").partitionBy("file").text(path))
