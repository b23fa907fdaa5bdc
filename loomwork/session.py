"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every operator relies on. All are runtime settings, so they can be
# applied to a session that somebody else started.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more shuffle later
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # merging maps: the later value wins, as in a dict merge
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # streams merge sessions on the map side before the shuffle
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure a checkpoint folder is known."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context: Python steps there import it."""
    context = spark.sparkContext
    if getattr(context, "_loomwork_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # an installed zip is shipped by whoever installed it
        folder = tempfile.mkdtemp(prefix="loomwork-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "loomwork.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(at, f)
                        z.write(full, os.path.join("loomwork", os.path.relpath(full, root)))
        context.addPyFile(path)
    context._loomwork_shipped = True


def build_session(app: str = "loomwork", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach: ``spark.checkpoint.dir``.

    Only where the session does not name one (a bare local session, as in
    tests) a local temporary folder takes its place; it goes when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    named = getattr(spark.sparkContext, "_loomwork_dir", None)
    if named is None:
        named = tempfile.mkdtemp(prefix="loomwork-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext._loomwork_dir = named
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/loomwork/{name}-{uuid.uuid4().hex}"
