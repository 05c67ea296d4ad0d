"""Session builder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(app: str = "quarry", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; local unless a master is configured elsewhere."""
    b = SparkSession.builder.appName(app)
    if cpus or "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{cpus or '*'}]")
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a run's files where driver and executors see it: in spark.checkpoint.dir. Where that is unset, a session
    on one machine gets a temporary one; any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return f"file://{tempfile.mkdtemp(prefix='quarry-')}/{name}"  # writers want a folder that isn't there yet
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may start elsewhere; once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="quarry-code-")) / "quarry_code.zip"
    with zipfile.ZipFile(to, "w") as out:
        for p in sorted((root / "quarry").rglob("*.py")):
            out.write(p, p.relative_to(root))
    sc.addPyFile(str(to))
    sc._quarry_shipped = True
