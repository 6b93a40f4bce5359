"""Session helpers: code shipping, checkpoint folder and defaults."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors of the session's context, once."""
    context = spark.sparkContext
    if not getattr(context, "_corpusloom_shipped", False):
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="corpusloom"), "corpusloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent).as_posix())
        context.addPyFile(target)  # the driver serves it to every executor
        context._corpusloom_shipped = True
    return spark


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``; a folder of our own only where none is set."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-checkpoint"))
    return frame.checkpoint()


def tidy() -> None:
    """Give free memory back to the system, so that a worker that is used again does not hold two stages' worth."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators are tuned for; existing sessions are reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())
