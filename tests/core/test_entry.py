import ast
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


def ask(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_queries_with_and_without_the_corpus_tools(tmp_path):
    shutil.copytree(ROOT / "tallyloom", tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, tools, fits = ask(tmp_path)
    assert int(n) >= 59 and (tools, fits) == ("False", "True")


def test_nothing_else_imports_the_corpus_tools():
    for path in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            names.append(getattr(node, "module", None) or "")
            assert not any({"llm", "corpus_pipeline"} & set(n.split(".")) for n in names), path
