"""Session-level helpers: durable lineage cuts, bounded broadcasts, packaging."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows and bytes a table may have at most to be broadcast as the build side of a join
BROADCAST_MAX_ROWS, BROADCAST_MAX_BYTES = 1_000_000, 64 * 1024 * 1024

#: bytes of a row group of the tables that plans write, about, and rows before its size is
#: first looked at: a reader holds up to 4,096 rows of a group at once, a writer all of it
GROUP_BYTES, GROUP_CHECK_ROWS = 16 * 1024 * 1024, 4


def configured_builder(app_name: str = "kernspan") -> SparkSession.Builder:
    """A session builder with the settings this library is tuned for.

    Rows of an Arrow batch are scored as one matrix, so the batch size is the
    block size of the scorer. The group-limit threshold lets Spark prune a
    per-group top-k before its shuffle for every k the selection plans use.
    Checkpoints nobody refers to any more are removed by Spark's cleaner.
    """
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut into.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a fresh folder on this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder all executors share"
            )
        configured = tempfile.mkdtemp(prefix="kernspan-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder.

    A reliable checkpoint survives the loss of executors and cuts the lineage
    that iterative plans would otherwise replay in every round.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path next to the checkpoints, for tables a plan writes itself."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once beside the checkpoints and read it back.

    Unlike a checkpoint the files prune: a reader's filter on a column of
    ``partition_by`` skips folders, and columns nobody asks for are not read. Row
    groups are small, since a cell of such a table may hold megabytes.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "none").option("parquet.block.size", GROUP_BYTES)
    writer = writer.option("parquet.page.size.row.check.min", GROUP_CHECK_ROWS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: text and binary by their length, lists by theirs."""

    def size(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 8
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8
        return F.lit(8)

    return reduce(Column.__add__, map(size, df.schema.fields))


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` is small enough.

    Above the bounds the table is returned without a hint, so that Spark joins
    by shuffle (and AQE splits skewed partitions).
    """
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="kernspan-zip-"), "kernspan.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped[sc.applicationId] = target
