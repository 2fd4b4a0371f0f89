import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["ahocorasick", "applause.llm", "corpus_pipeline", "public_tokenizers"])
def test_core_queries_stay_without_the_others(missing):
    code = (
        "import sys, warnings\n"
        f"sys.modules[{missing!r}] = None\n"
        "with warnings.catch_warnings(record=True) as seen:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as entry\n"
        "names = entry.queries()\n"
        "assert len(names) > 150 and names.keys() == entry.oracle_sql().keys(), len(names)\n"
        "assert any('training-data' in str(w.message) for w in seen)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
