"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the results depend on; they can be set on a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Hot keys: joins split them at run time, sessions are merged per task before they are shuffled.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Arrow batches are cut by bytes as well as rows: one image tensor is 602 KB.
ARROW_CONF = {
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lumirank_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='run-')}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._lumirank_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Make an existing session ready: runtime settings, and the package on its executors."""
    for key, value in {**RUNTIME_CONF, **ARROW_CONF}.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def build_session(app: str = "lumirank", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with UTC, adaptive execution, Arrow and the RocksDB state store."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        **RUNTIME_CONF,
        **ARROW_CONF,
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
