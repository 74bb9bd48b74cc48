import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stands_without_the_optional_parts(tmp_path):
    """The rest imports with ctxweave/llm and corpus_pipeline.py gone."""
    import shutil
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "ctxweave", tmp_path / "ctxweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'q01_tool_usage_stats' in e.queries(); assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    for p in (root / "ctxweave").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "ctxweave.llm" not in p.read_text(), p
