"""Session helper and checkpointing that survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "wavetable") -> SparkSession:
    """A session for tests and benches; on a cluster use the one the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stable(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is
    unset and all runs in one process, as in tests, a folder of our own is
    made; a cluster must name one that its machines share. ``replaces`` is the
    checkpointed step before in a loop, which nothing reads any more; its
    files go.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster's machines share")
            folder = tempfile.mkdtemp(prefix="wavetable-")
        sc.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    if replaces is not None:
        _remove(replaces)
    return out


def _remove(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that ``stable`` gave as it is."""
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
