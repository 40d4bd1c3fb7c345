from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.001"
QUICK = ["adj_symmetrize", "csr_indptr", "gcn_conv", "gat_dense_empty_rows", "sage_maxpool", "hin_mean", "appnp_k2", "link_concat", "walk_biased_weighted", "ppr_matrix"]


@pytest.mark.parametrize("name", QUICK)
def test_query_and_sql(spark, name):
    assert oracle.same(spark, oracle.duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


RUN = """
import __spark_entry__ as e
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
q = e.queries()
print("pipeline" in q, any(k.startswith("op") for k in q), q["sum_of_rows"](spark, "%s").count())
""" % SF


def test_without_the_training_data_folder(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("graphloom", "__spark_entry__.py"):
        os.system(f"cp -r {root / name} {tmp_path / name}")
    os.system(f"rm -r {tmp_path / 'graphloom' / 'llm'}")
    said = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0 and said.stdout.split()[-3:] == ["False", "False", "25"], said.stderr
