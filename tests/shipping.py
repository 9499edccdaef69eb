"""Runs a script in an empty folder whose driver alone finds the package, as on a cluster."""

from __future__ import annotations

import os
import subprocess
import sys

HEAD = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(dir=".")).getOrCreate())
"""


def run(folder, body: str) -> str:
    """The script's output; its workers don't have the repository on their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = folder / "script.py"
    script.write_text(HEAD.format(root=root) + body)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout
