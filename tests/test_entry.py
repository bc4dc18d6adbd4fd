"""The entry module without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None  # importing it raises ImportError
import __spark_entry__ as E
from tagflow.plans.registry import all_oracle_sql, all_queries
q, s = E.queries(), E.oracle_sql()
assert set(all_queries()) <= set(q) and set(all_oracle_sql()) <= set(s) and set(s) <= set(q)
print(sum(n.startswith("op") for n in q), "pipeline" in q)
"""


@pytest.mark.parametrize("blocked", [["tagflow.llm"], ["xxhash", "tokenizers", "tiktoken", "numpy"], ["corpus_pipeline"]])
def test_queries_without_the_optional_parts(blocked):
    done = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, pipeline = done.stdout.split()
    assert pipeline == "False"
    assert n == "0" or blocked == ["corpus_pipeline"]
