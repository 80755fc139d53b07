"""Sessions with the settings that the engine's semantics need."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Of meaning: without them results differ.
SEMANTICS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
#: Of speed: adaptive plans split skewed joins and join small partitions at run time.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Put what the semantics need on a session that exists."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark


def session(name: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session; the master and the sizes come from the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master or os.environ.get("LARKSPUR_MASTER"):
        builder = builder.master(master or os.environ["LARKSPUR_MASTER"])
    for key, value in {**SEMANTICS, **PLANNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
