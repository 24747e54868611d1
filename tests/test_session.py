"""The registry must work in a session that knows nothing of this package."""

import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
assert entry.entry(spark).count() > 0
assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
print("works")
"""


def test_foreign_session():
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=300, check=False
    )
    assert "works" in done.stdout, done.stderr[-2000:]
