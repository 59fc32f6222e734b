"""Names that differ only in case, and staged tables that go."""

import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.llm.language import identify, keep_known
from tidemill.llm.licenses import license_scan
from tidemill.llm.mixing import mixed_documents
from tidemill.llm.near_dups import without_duplicates
from tidemill.llm.quality_rules import keep_clean


@pytest.mark.parametrize("stage", [keep_clean, keep_known, without_duplicates, mixed_documents])
def test_names_that_differ_in_case(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    twice = docs.select("*", F.lit("other").alias("Text"), F.lit("x").alias("DOC_ID"), F.lit(0).alias("Source"))
    got, want = stage(twice), stage(docs)
    assert got.columns == twice.columns
    plain = got.toDF(*docs.columns, "t2", "d2", "s2")
    assert sorted(map(str, plain.select("doc_id", "text").collect())) == sorted(map(str, want.select("doc_id", "text").collect()))
    assert {r.t2 for r in plain.collect()} <= {"other"}


def test_names_in_identify_and_licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).withColumn("path", F.col("doc_id").cast("string"))
    twice = docs.select("*", F.lit("other").alias("TEXT"), F.lit("x").alias("Doc_Id"), F.lit("y").alias("Lang"), F.lit("z").alias("PATH"))
    for f in (identify, license_scan):
        assert sorted(map(str, f(twice).collect())) == sorted(map(str, f(docs).collect()))


def test_staged_tables_go_with_the_driver(tmp_path):
    script = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
from tidemill.llm.common import staged
assert staged(spark.range(5), "a").count() == 5 and staged(spark.range(3), "b").count() == 3
import os
assert len([x for x in os.listdir("{tmp_path}") if x[:2] in ("a-", "b-")]) == 2
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=Path(__file__).parents[2], timeout=120)
    left = lambda: [x for x in tmp_path.iterdir() if x.name[:2] in ("a-", "b-")]
    for _ in range(60):
        if not left():
            break
        time.sleep(0.5)
    assert not left()
