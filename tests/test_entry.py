from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from moraine.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["qid", "id", "label", "score", "rank"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_without_the_training_data_part(tmp_path):
    """The rest stands by itself when that subpackage and the pipeline are gone."""
    shutil.copytree(ROOT / "moraine", tmp_path / "moraine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not e.HAS_LLM; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(registry.QUERIES)
