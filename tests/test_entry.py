"""The entry module without the training-data part or what it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("absent", ["public_tokenizers", "marquee.llm", "xxhash"])
def test_core_queries_without(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'listing_page' in q and 'content_hashes' in q, q; assert not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
