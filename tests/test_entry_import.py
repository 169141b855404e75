"""The driver contract imports on an interpreter whose pyspark has no ``jars`` folder."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import glob, os, zipfile
def refuse(*a, **k):
    raise OSError("no jar may be read at import")
zipfile.ZipFile = refuse
glob.glob = refuse
import __spark_entry__ as e
assert len(e.queries()) >= 70 and set(e.oracle_sql()) <= set(e.queries())
"""


def test_import_reads_no_jar():
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
