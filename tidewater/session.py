"""Session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Identifiers are case-sensitive, clocks are UTC, joins and skew are planned anew at run time, and state lives in RocksDB.
DEFAULTS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidewater")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder; a local one only where the session names none and is local itself."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        top = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session: their Python need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="tidewater-ship-")) / f"{top.name}.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(packed))
    context.environment.setdefault("PYTHONPATH", str(top.parent))  # of the workers that Spark starts beside the driver
    context._tidewater_shipped = True
    return spark
