import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_meet():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 100
    assert entry.queries()["triage_queue"].__name__ == "triage_queue"


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "fathomline", tmp_path / "fathomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True)
    count, has, fits = out.stdout.split()[-3:]
    assert int(count) > 90 and has == "False" and fits == "True"


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "risk_score" in df.columns
