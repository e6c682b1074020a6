"""The long CSV table of the convertor repeats every prompt for each model, its files do not."""

import glob
import os

from pyspark.sql import SparkSession

import __spark_entry__ as E
from routelens.plans import queries_ingest as Q


def test_long_csv_is_packed(spark: SparkSession, tmp_path, monkeypatch):
    words = ["it's", 'a "quoted"', "back\\slash", "tab\there", "line\nbreak", "comma, and", "ünïcode"]
    rows = [(i, " ".join(f"{words[(i + n) % 7]}{i * n % 997}" for n in range(400)) if i % 9 else ["", " "][i // 9 % 2],
             "en" if i % 2 else "de", f"s{i % 3}") for i in range(120)]
    text = sum(len(r[1]) for r in rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, E.queries()["q_convert_csv"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(map(tuple, E.queries()["q_convert_long"](spark, str(tmp_path)).collect()), key=str) and len(got) == 120
    files = glob.glob(f"{tmp_path}/long-csv/part-*")
    assert files and sum(map(os.path.getsize, files)) < 2 * text
