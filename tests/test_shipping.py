"""Executors that were started elsewhere have no folder of this repository on their path."""

import os
import subprocess
import sys

from conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from corpusmill.session import local_session
spark = local_session(2)
print("ROWS", *[entry.queries()[name](spark, sys.argv[2]).count() for name in sys.argv[3:]])
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, f"{ROOT}/__spark_entry__.py", SF, "model_batch"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = next(line for line in done.stdout.splitlines() if line.startswith("ROWS"))
    assert int(rows.split()[1]) > 0
