"""Run-log scan: the splittable line scan orders lines exactly like whole-file reading."""

from pyspark.sql import functions as F

import json

from routelens.operators.logs import attach_header, fold_events, parse_log_lines, scan_run_logs, write_run_logs
from routelens.session import scratch_path
from routelens.sources.fixtures import log_lines
from tests.conftest import SF0001


def _fold(spark, path, whole):
    ev = attach_header(parse_log_lines(scan_run_logs(spark, path, whole_files=whole)))
    f = fold_events(ev.where(F.col("run_id").isNotNull()))
    return sorted(map(tuple, f.select("file", "sample_id", F.md5(F.concat_ws("|", "prompt")),
                                      F.md5(F.concat_ws("|", "sampled")), "correct").collect()))


def test_line_scan_with_tiny_splits_equals_whole_files(spark):
    src = scratch_path(spark, "log-splits")
    write_run_logs(log_lines(spark, SF0001), src)
    want = _fold(spark, src, whole=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # many splits per file
    try:
        got = _fold(spark, src, whole=False)
        n_parts = scan_run_logs(spark, src).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert n_parts > 10
    assert got == want and len(got) > 0


def _log(model, rows, broken=False):
    """Lines of one model's run log; ``rows``: (sample, prompt, answer, grade or None)."""
    out = [json.dumps({"spec": {"completion_fns": [f"raw_models/{model}"], "eval_name": "e"}})]
    for sample, prompt, answer, grade in rows:
        rec = {"run_id": model, "sample_id": sample}
        out.append(json.dumps({**rec, "type": "sampling", "data": {"prompt": [{"role": "user", "content": prompt}], "sampled": [answer]}}))
        if grade is not None:
            out.append(json.dumps({**rec, "type": "match", "data": {"correct": grade}}))
    return [*out, "{oops"] if broken else out


def test_several_models_meet_by_prompt(spark, tmp_path):
    """Ties go to the cheaper model; another list of prompts under the same id stays apart; a broken file counts for no one."""
    from routelens.plans.queries_ingest import converted_models
    logs = {"m0": _log("m0", [("1", "a b", "x", True), ("2", "q", "x", False), ("3", "p", "x", True)]),
            "m1": _log("m1", [("1", "a b", "x y", True), ("2", "q", "x", True), ("3", "another", "x", False)]),
            "m2": _log("m2", [("1", "a b", "x", False), ("2", "q", "x", True), ("3", "p", "x", None)]),
            "m3": _log("m3", [("1", "a b", "x", True), ("2", "q", "", True)], broken=True),
            "m4": _log("m4", [("1", "a b", "", True), ("1", "a b", "", True)])}
    for name, lines in logs.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    got = {(r.sample_id, *r.prompt): r for r in converted_models(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == [("1", "a b"), ("1", "a b", "a b"), ("2", "q"), ("3", "another"), ("3", "p")]
    one, two, other, last = got["1", "a b"], got["2", "q"], got["3", "another"], got["3", "p"]
    assert (one.oracle, one.oracle_cost_pico) == ("m0", 2 * 100000 + 200000)
    assert got["1", "a b", "a b"].oracle == "m4"  # asked twice
    assert (one.m0_perf, one.m1_perf, one.m2_perf, one.m3_perf) == (1.0, 1.0, 0.0, None)
    assert (two.oracle, two.m2_cost) == ("m1", 3 * 300000)
    assert (other.oracle, other.oracle_cost_pico, other.m0_perf) == ("no_model_correct", 0, None)
    assert (last.oracle, last.m1_perf, last.m2_perf) == ("m0", None, None)
