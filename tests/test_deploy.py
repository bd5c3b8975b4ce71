import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_run_from_another_directory(tmp_path):
    """Python workers must import the package whatever the driver's working directory."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("entry_mod", "{REPO}/__spark_entry__.py")
        E = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(E)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        print("ROWS", E.entry(spark).count(), E.queries()["hash_embed"](spark, "/root/testdata/sf0.001").count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 2500 200" in out.stdout, out.stderr[-2000:]
