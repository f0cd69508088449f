"""Session builder with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app_name: str = "vcspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; ``conf`` (dots as ``__``) overrides the defaults.

    On a cluster leave ``master`` unset, so that spark-submit decides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
