"""Tables that a job writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the warehouse if it is on shared storage; where driver and executors are one process
    (local mode), a temporary folder. On a cluster without either this is an error: executors would write to their own
    disks and later reads miss the rows."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        found = spark.conf.get("spark.sql.warehouse.dir")
        if not found or "://" not in found or found.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if found:
        return found.rstrip("/")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="spark-leafmill-")
    return _own_folder


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back. The table stays until the folder is cleared, since lazily
    returned results may still read it. ``codec`` is Parquet's compression, by default the session's."""
    path = f"{shared_folder(df.sparkSession)}/leafmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
