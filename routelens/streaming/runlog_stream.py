"""Incremental ingest of run logs that keep arriving in a directory (Structured Streaming).

Each micro-batch reads the lines of newly arrived JSONL files (a splittable
line scan; the order of a file's lines is the split offset plus the row id,
as in the batch reader) and runs the same batch operators as the offline
convertor -- parse, header join, file validation, fold -- then appends the
folded answers to a parquet table.  A file's lines always arrive in one batch.
Progress (which files were read) lives in the streaming checkpoint, so a
restarted query neither skips nor repeats files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.operators.logs import attach_header, fold_events, keep_log_path, parse_log_lines


def _lines_of(raw: DataFrame) -> DataFrame:
    f = raw.where(keep_log_path("file"))
    lines = f.select("file", F.struct(F.col("_blk").alias("block"), F.monotonically_increasing_id().alias("row"))
                     .alias("pos"), F.col("value").alias("line"))
    return lines.where(F.trim(F.col("line")) != "")


def fold_batch(raw: DataFrame) -> DataFrame:
    """Line rows ``(file, _blk, value)`` of one micro-batch -> folded answers with the file's
    model and eval."""
    ev = attach_header(parse_log_lines(_lines_of(raw))).where(F.col("run_id").isNotNull())
    return fold_events(ev, extra_keys=("model", "eval_name"))


def start_runlog_ingest(spark: SparkSession, source_dir: str, target_dir: str, checkpoint_dir: str,
                        available_now: bool = True):
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    stream = (spark.readStream.format("text").option("recursiveFileLookup", True).load(source_dir)
              .select(F.col("value"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("_blk")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # idempotent per micro-batch: a replayed batch overwrites its own partition only
        (fold_batch(batch).withColumn("batch_id", F.lit(batch_id)).write
         .option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch_id").parquet(target_dir))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
