"""The rest works without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as E; q = set(E.queries()); print(len(q), len(E.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def copy_without(folder, *left_out):
    def skip(path, names):
        own = os.path.relpath(path, REPO)
        return {n for n in names if n in (".git", "__pycache__", ".pytest_cache") or os.path.normpath(f"{own}/{n}") in left_out}
    shutil.copytree(REPO, folder, ignore=skip)
    return folder


@pytest.mark.parametrize("left_out", [("gustline/llm", "tests/llm"), ("gustline/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_lists_all_other_queries(tmp_path, left_out):
    from gustline.plans import catalog

    copy = copy_without(tmp_path / "copy", *left_out)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    told = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=env, capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
    assert told.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql())), "False", "False"]


def test_other_missing_modules_are_errors(tmp_path):
    """Only the subpackage itself may be missing."""
    if not os.path.isdir(f"{REPO}/gustline/llm"):
        pytest.skip("the subpackage is left out")
    copy = copy_without(tmp_path / "copy")
    with open(copy / "gustline/llm/queries.py", "a") as f:
        f.write("\nimport no_such_module\n")
    told = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True)
    assert told.returncode != 0 and "no_such_module" in told.stderr
