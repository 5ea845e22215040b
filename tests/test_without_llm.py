"""Nothing but the entry point knows of the corpus operators, and it works without them."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports():
    for path in (ROOT / "gleanery").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"gleanery\.llm|corpus_pipeline", path.read_text()), path


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "gleanery", tmp_path / "gleanery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
