import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_without_a_session_and_without_the_training_data_parts(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tracequarry"), tmp_path / "tracequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and 'q07_flagship' in q and 'pipeline' not in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for again in range(2):
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert out.returncode == 0 and int(out.stdout) > 50, out.stderr
        os.makedirs(tmp_path / "tracequarry" / "llm" / "__pycache__", exist_ok=True)  # what a deleted folder may leave


def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"user_id", "count"}
