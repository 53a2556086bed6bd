"""Session settings and the shared folder for tables a job writes on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution does three jobs here: it turns a sort-merge join into a broadcast
# join only when the measured side is small, it splits skewed join partitions, and it
# merges small shuffle partitions, so the partition count below can be set for the largest run.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "tallywork", master: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors reach.

    Unset, it is a scratch folder of this machine if the session is local (tests); on a
    cluster that is an error, as each executor would write to its own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallywork-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


# Folders of intermediate tables made in this process.
_made: list[str] = []


def run_folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, one per run."""
    _made.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_run_folders(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process, once no result that reads them is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    removed = 0
    while _made:
        path = hadoop(_made.pop())
        removed += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return removed
