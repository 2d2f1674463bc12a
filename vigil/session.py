"""Session helpers: a tuned local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vigil") -> SparkSession:
    """Session for tests and the bench: AQE on, UTC, UI off, Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is read from the session (``spark.checkpoint.dir``).  Only a local master may go without
    the setting (tests, bench): it gets a folder below the system's temp folder.  Off local
    masters an unset folder is an error, since machines do not share their temp folders.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir: executors have folders of their own")
        current = tempfile.mkdtemp(prefix="vigil-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return spark.sparkContext.getCheckpointDir() or current


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh folder name below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name or 'work'}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut the lineage of ``df``: write it to the shared checkpoint folder (reliable, survives a
    lost executor) and continue from the written copy.  Used where a plan reads one
    intermediate twice: Catalyst prunes columns differently in the two branches, so the
    exchanges below them are not reused and the whole upstream (scan, shuffle, aggregate)
    would run twice."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
