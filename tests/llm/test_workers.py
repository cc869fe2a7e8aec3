"""Operators called by themselves, by workers that start in another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from nodalis.llm import {module} as m
df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "doc_id long, text string")
print("rows", {call}.count())
"""

CALLS = {
    "simhash": "m.near_groups(m.fingerprints(df))",
    "ppm": "m.identify(df, m.learn(df.withColumn('lang', F.lit('en'))))",
    "html_text": "m.extract(df, 'doc_id', 'text')",
    "pieces": "m.encode_decode(df)",
    "decontaminate": "m.clean(df, df, item='doc_id').unionByName(df)",
}


def test_public_functions_need_no_preparation(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for module, call in CALLS.items():
        out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, module=module, call=call)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert "rows" in out.stdout, out.stderr[-2000:]
