"""The registry without the packages of the training-text queries."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["tiktoken", "ahocorasick", "foliospark.llm", "corpus_pipeline"])
def test_registry_loads_without(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) > 60 and 'document_chain' in q and set(e.oracle_sql()) <= set(q); "
            "assert 'pipeline' not in q")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
