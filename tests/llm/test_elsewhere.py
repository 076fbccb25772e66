"""Workers without the package, and texts that are no UTF-8."""

import os
import subprocess
import sys
import textwrap

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_operators_run_where_workers_lack_the_package(tmp_path):
    """The driver alone has the repository on its path: it is put there in Python, and workers start in another folder."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
                 .config("spark.checkpoint.dir", "file://{tmp_path}/checkpoints").config("spark.python.worker.reuse", "false").getOrCreate())
        spark.sparkContext.setLogLevel("OFF")
        def there(_):
            try:
                import annalist
                return 1
            except ImportError:
                return 0
        assert spark.sparkContext.parallelize([0], 1).map(there).sum() == 0, "workers see the package"
        from annalist.llm import queries
        for name in sorted(queries.QUERIES):
            queries.QUERIES[name](spark, {SF!r}).write.format("noop").mode("overwrite").save()
            print("ran", name, flush=True)
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert done.stdout.count("ran op") == 13


def test_stages_pass_malformed_texts_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    said = [b"a clean text of a few words \xff\xfe and more", None, b"", b"one line\nanother line\nmore words", b"one line\nanother line\nmore words", b"\xc3"]
    n = len(said)
    columns = {"doc_id": pa.array([*range(n - 1), None], pa.int64()), "lang": ["en"] * n, "source": ["web"] * n, "n_chars": pa.array([1] * n, pa.int64())}
    pq.write_table(pa.table(columns | {"raw": pa.array(said, pa.binary())}), f"{tmp_path}/raw.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([0, 3], pa.int64()), "quality": [1, 1], "toxic": [0, 1]}), f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/raw.parquet").selectExpr("doc_id", "cast(raw as string) as text", "lang", "source", "n_chars")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.count()
        assert stage(spark, now.limit(0), str(tmp_path)).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
            now = out
