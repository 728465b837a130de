"""Operators that write tables, in a plain local session that names no folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as entry
from lectern.functions.tables import run_dir
from lectern.operators import clustering, trails
clustering.DENSITY_ROWS = trails.HEAP_EDGES = 0
import pyspark.sql.functions as F
for name in {names!r}:
    print("DONE", name, entry.queries()[name](spark, {data!r}).count(), flush=True)
import os
left = [f for f in os.listdir(run_dir(spark)) if f.startswith("rounds")]
print("LEFT", len(left))
"""


def test_no_folder_is_needed(tmp_path):
    names = ["op1_substring_dedup", "op5_mix_sources", "op6_pii", "op7_minhash_dedup", "op9_exact_dedup", "op10_token_counts", "op11_tokenizer_alignment", "op12_merkle_manifest", "op13_ngram_join", "pipeline"]
    root = str(Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    found = subprocess.run([sys.executable, "-c", RUN.format(root=root, names=names, data="/root/testdata/sf0.001")], capture_output=True, text=True, env=env, timeout=900)
    assert [line.split()[1] for line in found.stdout.splitlines() if line.startswith("DONE")] == names, found.stderr[-3000:]
