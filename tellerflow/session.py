"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)


def build_session(app: str = "tellerflow", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        # checkpoints go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # call-site tracking makes building large expressions in Python slow
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, because there the
    driver's disk is the executors' disk.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tellerflow-")
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tellerflow-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder.

    What lies there is deleted when the Python process ends in an orderly way, or
    by ``clear_scratch``; results read it until then.
    """
    root = _scratch_root(spark)
    if root not in _AT_EXIT:
        _AT_EXIT.add(root)
        atexit.register(_clear_at_exit, spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_AT_EXIT: set[str] = set()


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables this application has stored for its own use, and so end every result that reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        clear_scratch(spark)
    except Exception:  # the session or its JVM has ended before
        log.info("scratch tables of a stopped session stay in %s", _AT_EXIT)
