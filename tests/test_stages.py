"""Stage tables end with their application."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from marlstone.operators.stages import drop_stages
from marlstone.plans import registry

CODE = """
import sys
from pyspark.sql import SparkSession
from marlstone.operators.stages import drop_stages, settled
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
one = settled(spark.range(5))
assert one.count() == 5
if sys.argv[2] == "drop":
    drop_stages(spark)
spark.stop()
"""


def test_no_stage_file_is_left(tmp_path):
    for how in ("drop", "exit"):
        at = tmp_path / how
        done = subprocess.run([sys.executable, "-c", CODE, str(at), how], cwd=Path(__file__).parent.parent, env=os.environ, capture_output=True, timeout=120)
        assert done.returncode == 0, done.stderr[-500:]
        for _ in range(50):
            if not list(at.glob("stages-*")):
                break
            time.sleep(0.2)
        assert not list(at.glob("stages-*")) and not list(at.rglob("*.parquet"))


@pytest.mark.parametrize("name", ["licence_totals", "index_totals"])
def test_licence_queries_read_their_table_each_time(spark, tmp_path, name):
    """Nothing of an earlier call is kept: stage tables may go, and a table may change."""
    query, sf = registry.queries()[name], str(tmp_path)
    customer = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    customer.filter("c_custkey < 20").write.parquet(f"{sf}/customer.parquet")
    assert query(spark, sf).first()["documents"] == 20
    drop_stages(spark)
    customer.filter("c_custkey < 7").write.mode("overwrite").parquet(f"{sf}/customer.parquet")
    assert query(spark, sf).first()["documents"] == 7


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {line for line in files.splitlines() if "/shuffle_" in line}


def test_shuffle_files_go_with_their_stage(spark):
    """Those of all rounds of a closure too, whose links are in buckets of their own and shuffled once."""
    from marlstone.operators.links import closure
    from marlstone.operators.stages import settled

    before, settled_rows = _shuffle_files(spark), settled(spark.range(1000).repartition(8))
    links = spark.createDataFrame([(str(k), str(k // 3), 1) for k in range(1, 30)], "source string, target string, ord int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = closure(links.selectExpr("source AS doc_id").distinct(), links)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert settled_rows.count() == 1000
    got = {(r.root, r.doc_id, r.depth, r.parent) for r in found.filter("root = '29'").collect()}
    assert got == {("29", "9", 1, "29"), ("29", "3", 2, "9"), ("29", "1", 3, "3"), ("29", "0", 4, "1")}
