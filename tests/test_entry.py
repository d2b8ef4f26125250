import subprocess
import sys

CODE = """
import sys
for gone in {gone}:
    sys.modules[gone] = None
import __spark_entry__ as e
from datatrawl.checks.queries import QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES), e.queries().keys()
"""


def test_entry_without_the_corpus_files():
    for gone in (["corpus_pipeline", "datatrawl.llm"], ["corpus_pipeline"], ["datatrawl.llm"]):
        done = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
