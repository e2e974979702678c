"""The entry module must work where the corpus operators are not installed."""
import os
import shutil
import subprocess
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [True, False])
@pytest.mark.parametrize("empty_folder", [True, False])
def test_entry_without_the_corpus_operators(with_pipeline, empty_folder):
    copy = os.path.join(tempfile.mkdtemp(prefix="convgraph-entry-"), "repo")
    gone = [".git", "__pycache__", "llm"] + ([] if with_pipeline else ["corpus_pipeline.py"])
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*gone))
    if empty_folder:  # as an uninstaller that leaves caches behind would
        os.makedirs(os.path.join(copy, "convgraph", "llm", "__pycache__"))
    code = ("import __spark_entry__ as E; q, s = E.queries(), E.oracle_sql(); "
            "assert len(q) >= 106 and set(s) <= set(q) and 'pipeline' not in q and not [n for n in q if n[:2] == 'op'], len(q)")
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
