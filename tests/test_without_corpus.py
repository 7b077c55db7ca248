"""The library and the entry point work where the corpus operators are absent."""

import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_point_without_the_corpus_operators():
    copy = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "repo"
    shutil.copytree(ROOT / "stormlane", copy / "stormlane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
