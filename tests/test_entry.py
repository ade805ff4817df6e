import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["c_name", "o_totalprice"] and found.count() > 0


def test_works_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name == "graphloom":
            shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "graphloom/llm/__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/graphloom"):
        if "/llm" not in folder:
            for name in (n for n in names if n.endswith(".py")):
                with open(f"{folder}/{name}") as file:
                    assert "llm" not in file.read(), name
