"""Session defaults, and shipping this package to Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that results rely on (UTC, adaptive plans)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors; once a session."""
    if getattr(spark, "_tabloom_sent", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    out = os.path.join(tempfile.mkdtemp(prefix="tabloom-src-"), "tabloom_src.zip")
    Path(out).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(out)
    spark._tabloom_sent = True
