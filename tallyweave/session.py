"""Session helpers: a local session for tests and benches, table loading, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side may be broadcast; a larger side is joined by shuffle.
BROADCAST_ROWS = 300_000
#: Bytes of JSON text up to which it may be.
BROADCAST_BYTES = 64 << 20


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyweave")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows and `most_bytes` bytes (as JSON text), else as it is.

    Both are measured by a scan that stops at the limit of rows.
    """
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    n, total = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= most_bytes else df


def _folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on one machine; on a cluster an error, as executors
    don't share their disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="tallyweave-")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the folder in spark.checkpoint.dir, its lineage cut; survives the loss of executors.

    Where the setting is absent on one machine (tests), a temporary folder is set; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one on one machine where none is set."""
    return _folder(spark)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` parted by `keys` into as many tasks as shuffles have, which adaptive execution does not coalesce.

    For input of stages that take far more time than their bytes tell, such as parsing in Python. Joins and aggregates on the
    same keys reuse it, so put before those it costs no shuffle of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
