"""Session set-up and the few places where a plan is cut or its size is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 20_000


def build_session(app: str = "contestlab", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; ``master`` is only set for local runs."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "16g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of its own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="contestlab-ckpt-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder, for tables a job writes for itself."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    out = df.checkpoint(eager=True)
    out.is_cut = True
    return out


def once(df: DataFrame) -> DataFrame:
    """``df`` for a step that reads it several times: cut, unless it is the very result of a cut."""
    return df if getattr(df, "is_cut", False) else cut(df)


def stored(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder, read again: cuts lineage as ``cut`` does, and the planner knows its size."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.is_cut, out.stored_at = True, path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into as many tasks as the session's shuffles have.

    For steps that cost far more than their input size suggests (Python groups,
    rows that fan out), where adaptive merging of small partitions would leave
    most of the cluster idle. A following group-by on the keys needs no other shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``max_rows`` rows, else ``None``.

    A local relation has a known size, so Catalyst broadcasts it by itself. The
    read is bounded by the limit whatever the data holds.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join with a side that is expected to be small.

    Broadcast when the checked size allows it. Beyond the bound the plain
    shuffle join is used, whose skewed partitions adaptive execution splits.
    """
    local = small(right, max_rows)
    if local is not None:
        return left.join(F.broadcast(local), on, how)
    return left.join(right, on, how)


def constants(df: DataFrame, prefix: str = "") -> dict:
    """The single row of an ungrouped aggregate, as literal columns by name."""
    row = df.first()
    return {prefix + c: F.lit(row[c]) for c in df.columns}
