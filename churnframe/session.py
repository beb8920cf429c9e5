"""Spark session helpers.

Library code never builds its own session; it takes the caller's.  The
builders here are for tests, the bench and the smoke entry point, which run
on one machine.  On a cluster the caller's session already carries
``spark.checkpoint.dir`` (a shared folder); it is read, never overridden.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers over local sockets: a pass starts in a third of the time
    "spark.python.unix.domain.socket.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "churnframe") -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Only a session that runs in one
    process on this machine (tests, bench) gets a scratch folder when none is
    set; on a cluster a missing setting is an error."""
    existing = checkpoint_dir(spark)
    if existing:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(existing)
        return existing
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="churnframe-ckpt-", dir=os.environ.get("CHURNFRAME_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(scratch)
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own, for one written table, in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnframe/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it
    back: later stages (and retried tasks after an executor loss) read the
    columns they need instead of replaying the whole lineage."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


ROWS_PER_PARTITION, LEAST_ROWS = 1_000_000, 16_384


def iteration_partitions(spark: SparkSession, n_rows: int) -> int:
    """Partitions for passes that are repeated over the same rows.  A pass pays
    some milliseconds for each: as many as there are cores once there are rows
    for them, and at most ``ROWS_PER_PARTITION`` rows in one."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-n_rows // ROWS_PER_PARTITION), min(cores, -(-n_rows // LEAST_ROWS)))


_SHIPPED: set = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per
    application): the Arrow-backed stages unpickle functions from ``churnframe`` on the
    executors, which need the code even when the driver found it through
    its own ``sys.path``."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="churnframe-code-")
    archive = shutil.make_archive(os.path.join(folder, "churnframe"), "zip", os.path.dirname(pkg), "churnframe")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
