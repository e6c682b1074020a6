"""The streaming run-log ingest folds the same answers as the batch scan."""

from pyspark.sql import functions as F

from routelens.operators.logs import attach_header, fold_events, parse_log_lines, scan_run_logs, write_run_logs
from routelens.session import scratch_path
from routelens.sources.fixtures import log_lines
from routelens.streaming.runlog_stream import start_runlog_ingest
from tests.conftest import SF0001


def test_stream_equals_batch(spark):
    src = scratch_path(spark, "stream-src")
    write_run_logs(log_lines(spark, SF0001), src)
    dst, ck = scratch_path(spark, "stream-dst"), scratch_path(spark, "stream-ck")
    q = start_runlog_ingest(spark, src, dst, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(dst).select("sample_id", "model", "correct", F.size("prompt").alias("n"))
    ev = attach_header(parse_log_lines(scan_run_logs(spark, src, whole_files=True))).where(F.col("run_id").isNotNull())
    hdr = ev.select("file", "model").distinct()
    want = fold_events(ev).join(hdr, "file").select("sample_id", "model", "correct", F.size("prompt").alias("n"))
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_replayed_batch_does_not_duplicate(spark):
    from routelens.streaming.runlog_stream import fold_batch
    src = scratch_path(spark, "replay-src")
    write_run_logs(log_lines(spark, SF0001), src)
    raw = spark.read.text(src, recursiveFileLookup=True).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"))
    dst = scratch_path(spark, "replay-dst")
    for _ in range(2):     # the same batch id written twice, as after a retry
        (fold_batch(raw).withColumn("batch_id", F.lit(0)).write.option("partitionOverwriteMode", "dynamic")
         .mode("overwrite").partitionBy("batch_id").parquet(dst))
    assert spark.read.parquet(dst).count() == fold_batch(raw).count()
