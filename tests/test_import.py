"""Importing the entry opens no file of Spark's and starts no session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import builtins, glob, os, sys, zipfile
def refuse(*a, **b):
    raise OSError("no archive may be opened at import")
zipfile.ZipFile = refuse
glob.glob = lambda *a, **b: []
import __spark_entry__ as entry
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
assert len(entry.queries()) >= 106 and set(entry.oracle_sql()) <= set(entry.queries())
"""


def test_import_is_safe():
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
