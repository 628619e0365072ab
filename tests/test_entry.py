"""The entry module without the optional training-data part."""
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_pipeline_module():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "names = set(e.queries()); assert 'tree_rows' in names and 'pipeline' not in names; "
            "assert not any(n.startswith('op') for n in names); assert set(e.oracle_sql()) <= names")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
