"""The driver contract, and that the core stands without the optional subpackage."""

import os
import re
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_equivalent_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 60


def test_core_imports_without_the_optional_part():
    code = "import sys; sys.modules['quirespark.llm'] = None; import __spark_entry__ as e; assert not [k for k in e.queries() if k[0] == 'p'] and len(e.queries()) > 60"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_names_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "quirespark")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(folder, n)).read()), n
