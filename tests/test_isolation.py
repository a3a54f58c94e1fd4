import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_library_stands_without_the_training_data_operators(tmp_path):
    ignored = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignored)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 150


def test_nothing_else_imports_the_training_data_operators():
    others = [p for p in (ROOT / "larkspur").rglob("*.py") if "llm" not in p.parts]
    assert others and not [p for p in others if "llm" in p.read_text()]
