"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Call sites recorded per Column call cost more than building the plan itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A very long page is sorted on the executors instead of being gathered by the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def build_session(master: str | None = None, app: str = "eventloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply those settings that can still change to a session made by someone else."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the session names in `spark.checkpoint.dir`.

    Without that setting a temporary folder serves local sessions; on a cluster, where other
    machines would not see it, this fails.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="eventloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
