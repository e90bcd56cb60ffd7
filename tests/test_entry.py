"""The driver's entry points can be read without a session, and without the optional folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_without_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) > 100


def test_library_does_not_import_the_optional_folder():
    for path in (ROOT / "biblio").rglob("*.py"):
        if "llm" not in path.parts:
            assert "biblio.llm" not in path.read_text() and "from .llm" not in path.read_text()


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["author", "works", "citations", "h_index"]
