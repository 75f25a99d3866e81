"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. UTC keeps TIMESTAMP_NTZ <-> microsecond
# conversion exact; AQE sizes the shuffles and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # array payloads are wide: batches are bounded by size, and by rows where a
    # short input row gives a long curve
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="brinewave-")) / "brinewave.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make the kernels importable on the executors."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def get_session(app: str = "brinewave", master: str | None = None, conf: dict | None = None):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_folder(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder the cluster names; without one, as in tests, one is made."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="brinewave-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder.

    Used where one table feeds many later jobs (cross-validation, search), so a
    lost executor costs a re-read and not a rebuild of the features.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
