"""Queries run where workers cannot import the package: another working folder, no PYTHONPATH."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.append({root!r})  # of this process only
from pyspark.sql import SparkSession
from loomline.llm import registry
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "2g").getOrCreate()
for name in {names!r}:
    assert registry.QUERIES[name](s, {sf!r}).count() > 0, name
from loomline import cluster
from loomline.llm import packing, simhash, privacy
docs = cluster.table(s, {sf!r}, "documents")
for stage in (simhash.stage, privacy.stage, packing.stage):
    assert stage(s, docs, {sf!r}).count() > 0
print("all done")
"""
NAMES = ["op1_pseudo_likelihood", "op4_vector_packing", "op5_disclosure_terms", "op8_popcount_simhash", "op9_ppm_language", "op10_template_leaks"]


def test_workers_without_the_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, names=NAMES, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in got.stdout, got.stderr[-3000:]
