import os
import subprocess
import sys

import corpus_pipeline


def test_stages_keep_columns_and_pack(spark, tmp_path):
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(f"word{i * 1009 + k * 31 + j}x" for j in range(8)) + "." for k in range(12))
        rows.append((i, text, "en", "s", len(text)))
    rows.append((60, rows[0][1], "en", "s", len(rows[0][1])))
    rows.append((61, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert packed and {r.doc_id for r in packed} <= set(range(61))


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import corpus_pipeline
docs = spark.createDataFrame([(i, "word " * 60, "en", "s", 300) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
docs.write.parquet("documents.parquet")
spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet("labels.parquet")
for name, stage in corpus_pipeline.STAGES:
    stage(spark, docs, ".").collect()
    print("ended", name)
"""


def test_stages_run_alone_outside_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    said = subprocess.run([sys.executable, "-c", ALONE, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [x.split()[1] for x in said.stdout.splitlines() if x.startswith("ended ")] == [k for k, _ in corpus_pipeline.STAGES], said.stderr[-2000:]
