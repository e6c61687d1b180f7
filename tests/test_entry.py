"""The entry works without the training-data subpackage, and the library never imports it."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_library_does_not_import_the_subpackage():
    for f in (ROOT / "kinmatch").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"kinmatch\.llm|from kinmatch import .*llm|corpus_pipeline", f.read_text()), f


def test_entry_without_the_subpackage(tmp_path):
    for f in [ROOT / "__spark_entry__.py", *(ROOT / "kinmatch").rglob("*.py")]:
        to = tmp_path / f.relative_to(ROOT)
        if "llm" not in to.relative_to(tmp_path).parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 60 and "[]" in said.stdout


def test_every_sql_is_for_a_query():
    from kinmatch.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
