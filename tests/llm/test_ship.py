"""Tasks import the package wherever they run."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_operators_travel_without_the_package(tmp_path):
    """Workers of a session started elsewhere find neither the repository nor its folder on their path."""
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from pyspark.sql import functions as F\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as entry\n"
        "from parcelweave.llm import lm, near, topk\n"
        "docs = spark.createDataFrame([(1, 'some words ' * 30), (2, None)], 'doc_id long, text string')\n"
        "print('LM', lm.score(docs, F.lit(True)).count())\n"
        "print('NEAR', near.near_duplicates(docs).count())\n"
        "vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], 'vec_id long, embedding array<double>')\n"
        "print('TOP', topk.top_k(vectors, F.col('vec_id') % 20 == 0).count())\n"
        "for name in ('op1_repetition', 'op3_packing', 'op5_toxicity', 'op8_secrets', 'op10_byte_bpe'):\n"
        "    print(name, entry.queries()[name](spark, '/root/testdata/sf0.001').count() >= 200)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    for said in ("LM 2", "NEAR 2", "TOP 1", *(f"{n} True" for n in ("op1_repetition", "op3_packing", "op5_toxicity", "op8_secrets", "op10_byte_bpe"))):
        assert said in done.stdout, done.stderr[-3000:]
