"""The driver contract holds without the training-data operators or their libraries."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("hidden", ["xxhash", "public_tokenizers", "sendwatch.llm", "corpus_pipeline"])
def test_queries_without_a_library(hidden):
    code = (f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert 'account_rates' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op1_')]; "
            "assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
