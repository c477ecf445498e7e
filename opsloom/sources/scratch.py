"""Folders for what a query writes and reads again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or one of our own in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "/tmp/checkpoints/opsloom"
    return f"{top.rstrip('/')}/opsloom-{uuid.uuid4().hex}/{name}"
