import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "area_mean", "area_std", "height_max", "n"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_subpackage(tmp_path):
    """The rest imports, and registers its queries, when the subpackage and the pipeline are gone."""
    shutil.copytree(ROOT / "streetloom", tmp_path / "streetloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "streetloom/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for p in ROOT.glob("streetloom/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "streetloom.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
