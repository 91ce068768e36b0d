import os
import shutil
import subprocess
import sys

import __spark_entry__ as e


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["vec_id", "label", "score"] and df.count() == 5


def test_names():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values()) and all(isinstance(s, str) and s.strip() for s in o.values())


def test_without_the_optional_subpackage(tmp_path):
    """With both folders and the pipeline deleted the entry point imports, and its queries are the engine's own."""
    for part in ("corpusgraph", "__spark_entry__.py"):
        source = os.path.join(e.ROOT, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    shutil.rmtree(tmp_path / "corpusgraph" / "llm")
    code = 'import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [n for n in q if n.startswith("op") or n == "pipeline"]'
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=60)
    (tmp_path / "corpusgraph" / "llm").mkdir()  # what bytecode leaves behind
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=60)
    (tmp_path / "corpusgraph" / "llm" / "registry.py").write_text("import something_that_is_not_there")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=60, capture_output=True).returncode
