"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_in(folder):
    code = "import __spark_entry__ as e; print(*e.queries(), '|', *e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, sql = done.stdout.split("|")
    return set(queries.split()), set(sql.split())


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/wayfold", tmp_path / "wayfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    queries, sql = names_in(tmp_path)
    assert "decide_trace" in queries and sql <= queries
    assert not any(n.startswith("op") and n[2].isdigit() for n in queries) and "pipeline" not in queries


def test_queries_run_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/wayfold", tmp_path / "wayfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = (
        "from wayfold.session import local_session; s = local_session(cpus=2, memory='2g', app='alone'); import __spark_entry__ as e; q = e.queries()\n"
        "print('ROWS', e.entry(s).count(), *(q[n](s, e.SMOKE).count() for n in ('weak_report', 'replay_reports', 'gpx_text')))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(int(n) > 5 for n in done.stdout.split("ROWS")[1].split())


def test_other_missing_modules_are_told(tmp_path):
    """Only the absence of the subpackage and the pipeline is passed over."""
    shutil.copytree(f"{ROOT}/wayfold", tmp_path / "wayfold", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_nowhere\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode and "a_module_that_is_nowhere" in done.stderr


def test_flagship(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 5
