import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_catalogue():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and all(map(callable, names.values()))


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test data here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "label", "removed", "in_leaking_texts"] and df.count() > 0


@pytest.mark.parametrize("left", [False, True])
def test_core_stands_alone(tmp_path, left):
    """Without the optional subpackage, or with no more than an empty folder of it, the rest imports and lists its queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/spanveil", tmp_path / "spanveil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if left:
        (tmp_path / "spanveil" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('p1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
