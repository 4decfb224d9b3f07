"""Small things that several text operators need."""

from __future__ import annotations

import string
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.sources import tables

#: `[^\x20\x09-\x0D]+` as Spark's and DuckDB's regular expressions write the complement.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, dealt over all cores where its files are fewer than half of them."""
    return tables.widened(tables.table(spark, sf_dir, name))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return (F.crc32(column.cast("string").cast("binary")) % n).cast("int")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, as in tests, a folder below the warehouse is set and used.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts reach from a few bytes to megabytes; batches of more rows would take too much memory.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and bound their batches.

    Executors get the code from Spark's own file server, so nothing has to be installed there.
    Batches between the JVM and Python hold at most ``BATCH_ROWS`` rows in this session; a lower
    setting of the session stays.
    """
    rows = int(spark.conf.get(BATCH_SETTING))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_cairnfield_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="cairnfield-")) / "cairnfield_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "cairnfield").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._cairnfield_shipped = True
