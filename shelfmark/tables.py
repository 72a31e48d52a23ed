"""Tables in the session's shared folder, by which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new, empty path in the folder of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where a session on one machine has neither (tests), a temporary folder becomes the latter;
    on a cluster, whose executors would not see such a folder, that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shelfmark-"))
        root = context.getCheckpointDir()
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    return f"{root.rstrip('/')}/shelfmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """The path of a folder that the driver and all executors have mounted, without its scheme."""
    scheme, found, rest = path.partition("://")
    if found and scheme != "file":
        raise ValueError(f"files are listed, moved and written in place in mounted folders only, not in {path}")
    return rest if found else path.removeprefix("file:")
