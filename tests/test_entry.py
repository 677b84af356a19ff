"""The driver's entry points with the corpus operators and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; from pointquarry.plans.catalogue import QUERIES, ORACLES; q, o = e.queries(), e.oracle_sql(); print(len(q), set(QUERIES) <= set(q), set(ORACLES) <= set(o), set(o) <= set(q), [n for n in q if n not in QUERIES])"


def asked(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True, check=True)
    return out.stdout.strip()


@pytest.mark.parametrize("broken", ["no folder", "a missing library"])
def test_the_rest_works_without_the_corpus_operators(tmp_path, broken):
    folder = str(tmp_path / "copy")
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if broken == "no folder" else [])))
    if broken != "no folder":
        os.makedirs(f"{folder}/pointquarry/llm")
        for name, text in (("__init__", ""), ("queries", "import a_library_that_is_not_there\n")):
            with open(f"{folder}/pointquarry/llm/{name}.py", "w") as f:
                f.write(text)
    from pointquarry.plans.catalogue import QUERIES

    assert asked(folder) == f"{len(QUERIES)} True True True []"
