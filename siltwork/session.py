"""Session helpers: defaults for local use, checkpoint folder, bounded broadcast."""

from __future__ import annotations

import atexit
import functools
import operator
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested with (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siltwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    expose_package(spark)
    return spark


def expose_package(spark: SparkSession) -> None:
    """Let Python workers import this package also where the driver found it by its own path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only where unset (tests), a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siltwork-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table into the checkpoint folder, and read from there.

    Like ``checkpointed``, but smaller on disk, and later steps read only the columns they need.
    The table goes with the checkpoint folder of the application.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def _width(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    return F.lit(8)


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 128 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to hold at most ``max_rows`` rows and ``max_bytes``
    bytes.

    The count stops after ``max_rows + 1`` rows. A larger side comes back without a hint, so
    that the join shuffles (AQE splits skewed partitions).
    """
    width = functools.reduce(operator.add, [_width(f) for f in df.schema.fields], F.lit(0)).cast("long")
    n, size = df.limit(max_rows + 1).select(width.alias("w")).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
