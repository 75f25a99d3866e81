"""Folders that queries write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or the session's own temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="brinewave-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
