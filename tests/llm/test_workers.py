"""Python workers without the package, as on executors that hold no copy of it."""

import os
import subprocess
import sys
from pathlib import Path

import public_tokenizers

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.append({root!r})  # the driver's path alone: workers do not inherit it
from voxtrail.session import local_session
from voxtrail.llm import queries
from pyspark.sql import functions as F

spark = local_session(2, 2)

@F.udf("string")
def sees(x):
    try:
        import voxtrail
    except ModuleNotFoundError:
        return "no"
    return "yes"

assert spark.range(1).select(sees("id").alias("s")).first().s == "no"
for name, query in queries.QUERIES.items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print(name, flush=True)
"""


def test_queries_run_where_workers_cannot_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k == "PATH" or k.startswith("JAVA")}
    env |= {"HOME": str(tmp_path), "PYTHONPATH": str(Path(public_tokenizers.__file__).parents[1])}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len([x for x in run.stdout.splitlines() if x.startswith("op")]) == 12
