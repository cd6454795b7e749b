"""The entry point without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["public_tokenizers", "studylake.llm", "corpus_pipeline"])
def test_entry_without_optional_parts(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print('m2_document_coverage' in e.queries(), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert out.split() == ["True", "False"]
