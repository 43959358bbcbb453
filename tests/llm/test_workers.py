import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys, tempfile
sys.path[:0] = [{repo!r}, {here!r}]
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-workers-")).getOrCreate()
)
def lacking(_):
    import importlib.util
    return [importlib.util.find_spec("skywait") is None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(lacking).collect() == [True]
import cases
from skywait.llm import collocations, ctw, forest, langid, merkle, minhash, mixing, packing, token_files
docs = cases.make(spark, n=30).limit(40)
vectors = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)], 0) for k in range(60)], "vec_id long, embedding array<double>, label int")
frames = [
    ctw.score(docs), langid.predict(docs, langid.fit(docs, rounds=1)), forest.near_vectors(vectors, leaf=8, sample=40), minhash.near_duplicates(docs),
    mixing.mixed_documents(docs), packing.pack(docs), token_files.packed_rows(docs), collocations.collocations(docs, least=2), merkle.manifest(docs),
]
print("rows", [f.count() for f in frames])
"""


def test_operators_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(repo=str(REPO), here=str(Path(__file__).parent))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "rows [40, 40, 60, 40" in done.stdout, done.stdout[-500:] + done.stderr[-2000:]
