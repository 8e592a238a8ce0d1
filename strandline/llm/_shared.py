"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows may be broadcast; callers count before they do.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a folder of its own; on a cluster
    each executor would write to its own disk, so there it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/strandline-{sc.applicationId}"


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run here delete their shuffle files when they end, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if before is not None:  # a setting of Spark 4.1
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage and survives the loss of executors. The shuffle files of ``df`` go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _freeing_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`written` returned, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/strandline-{spark.sparkContext.applicationId}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``limit``; else leave the join to the planner."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that don't clash with the columns of ``df`` (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = name
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out.append(own)
    return out


_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker, so that long texts can't fill it.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Prepare a session for the operators that run Python: send this package to the workers, once
    for each application, and bound the bytes of an Arrow batch."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="strandline-ship-")) / "strandline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for file in (root / "strandline").rglob("*.py"):
                z.write(file, file.relative_to(root))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables, for a query of this subpackage."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
