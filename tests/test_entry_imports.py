"""The entry module imports where packages of the optional operators are missing."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
known = entry.queries()
assert "flagship_severity_by_sid" in known and "pipeline" not in known
print(len(known))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "zstandard", "sentencepiece", "packetloom.llm", "corpus_pipeline"])
def test_import_without(name):
    # some packages are only imported inside tasks: then nothing is missing at import
    code = CODE.format(name=name)
    if name in ("zstandard", "sentencepiece"):
        code = code.replace('and "pipeline" not in known', "")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=ROOT)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) >= 100
