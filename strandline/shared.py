"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows are broadcast; they are counted first.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a folder of its own. On a cluster it
    must be set, as each executor would write to its own disk."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/strandline-{sc.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files behind frames that :func:`written` returned, once nothing reads them."""
    for df in frames:
        spark = df.sparkSession
        own = f"/strandline-{spark.sparkContext.applicationId}/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if own in f}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are few; else the planner decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
