import os
import subprocess
import sys
import types
from pathlib import Path

import pytest

import __spark_entry__ as entry
from gridcast import session

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_llm_folders(tmp_path):
    import shutil

    for name in ("gridcast", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "gridcast" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ModuleNotFoundError(\"No module named 'zstandard'\", name='zstandard')")
    code = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and q"
    path = os.pathsep.join([str(tmp_path), str(ROOT), os.environ.get("PYTHONPATH", "")])
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_shared_folder_must_be_set_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = types.SimpleNamespace(get=lambda k, d=None: d)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    for master in ("local-cluster[2,1,1024]", "spark://a:7077"):
        Context.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session())
    Context.master = "local[8]"
    assert session.shared_dir(Session()).startswith("file:")
