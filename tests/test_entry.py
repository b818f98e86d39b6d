"""The entry point without the corpus operators."""

import subprocess
import sys
import textwrap
from pathlib import Path

TOP = Path(__file__).parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=TOP, capture_output=True, text=True, check=True).stdout


def test_queries_without_the_corpus_operators():
    out = run("""
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "kindred.llm" or name.startswith("kindred.llm."):
                    raise ModuleNotFoundError(f"No module named {name!r}", name="kindred.llm")
        sys.meta_path.insert(0, Gone())
        import importlib.util
        real = importlib.util.find_spec
        importlib.util.find_spec = lambda name, *a: None if name.startswith("kindred.llm") else real(name, *a)
        import __spark_entry__ as e
        print(len(e.queries()), sum(k.startswith("op") for k in e.queries()), "pipeline" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
    """)
    n, ops, pipeline, known = out.split()
    assert int(n) >= 50 and ops == "0" and pipeline == "False" and known == "True"


def test_queries_are_told_apart():
    n, with_sql = run("import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))").split()
    assert int(n) >= 50 and with_sql == "0"
