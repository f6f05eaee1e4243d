"""Session settings and the shared work folder.

Nothing here is specific to one machine: the work folder is the one the
cluster names in ``spark.checkpoint.dir``. Only a local session that leaves it
unset gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folders: dict[str, str] = {}
_made: dict[str, list[str]] = {}

# Runtime settings every plan relies on; safe to set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tasks here are heavy on CPU for their bytes: small shuffles should still use all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the next aggregate then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A repeated key in a JSON object keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Can only be set when a session is built.
STATIC_CONF = {
    # Recording the Python line of every column call costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "parcelrules", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` overrides or adds settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder all executors can reach, for written tables and checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="parcelrules-")
            atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
        base = _local_folders[app]
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_work_folders(spark: SparkSession) -> int:
    """Delete the work folders this application has made, once no DataFrame needs them; how many there were."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    remove_folders(spark, paths)
    return len(paths)


def remove_folders(spark: SparkSession, paths) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
