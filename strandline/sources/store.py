"""A log kept as Parquet in batches, with numbered manifests of its heads.

``<root>/batches/<id>/<table>/`` holds the rows of each table that one ``put`` appended, never
changed afterwards. A batch counts once its marker ``<root>/batches/<id>/committed`` is there, so a
writer that broke off before leaves nothing that is read, and may simply put again.
``<root>/heads/<number>.json`` names the heads; the highest whole one holds. A manifest is made
under a number that nobody has, never replaced, so no stop in between loses the one before, and
there is no lock that could be left behind. Operations that no head descends from are not part
of the log. ``<root>/objects/<id>`` holds payloads.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, Log
from ..operators.replay import LogError, merge, of_operations, operation_digest, operation_heads, publish_heads, reachable

FORBIDDEN = ("", ".", "..")


def check_component(name: str) -> str:
    """A name that may be a part of a path."""
    if name in FORBIDDEN or "/" in name or "\\" in name:
        raise ValueError(f"not a path component: {name!r}")
    return name


class MemoryStore:
    """The same contract without files: a log and its heads in the session."""

    def __init__(self, spark: SparkSession):
        self.log = Log(spark)
        self._heads: list[str] = []

    def heads(self) -> list[str]:
        return list(self._heads)

    def load(self) -> Log:
        return self.log

    def publish(self, log: Log, expected: list[str] | None = None) -> str:
        merged = merge(self.log, log) if self.log.tables else log
        heads = sorted(r.op_id for r in operation_heads(merged).collect())
        before, self.log, self._heads = self._heads, merged, heads
        return "already-present" if heads == before else "published" if expected in (None, before) else "merged"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def _found(self, pattern: str) -> list[str]:
        """Paths that match, in order; none if the folder isn't there."""
        return sorted(str(f.getPath()) for f in self._fs().globStatus(self._path(pattern)) or [])

    def _write(self, path, data: bytes) -> bool:
        """Make a file that isn't there yet; false if it is."""
        try:
            out = self._fs().create(path, False)
        except Exception as e:  # the JVM's
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(data))
        out.close()
        return True

    def _read(self, path) -> bytes:
        stream = self._fs().open(path)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _table(self, name: str, batches: list[str]) -> DataFrame | None:
        paths = [f"{b}/{check_component(name)}" for b in batches]
        there = [p for p in paths if self._fs().exists(self._jvm.org.apache.hadoop.fs.Path(p))]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*there) if there else None

    def stored(self) -> Log:
        """All rows of committed batches, published or not."""
        batches = [m.rpartition("/")[0] for m in self._found("batches/*/committed")]
        return Log(self.spark, {n: t for n in SCHEMAS if (t := self._table(n, batches)) is not None})

    def has(self, op_id: str) -> bool:
        return not self.stored().operations.filter(F.col("op_id") == op_id).isEmpty()

    def get(self, op_id: str) -> Log:
        """One operation with its facts; an id that isn't there is a fault."""
        wanted = self.spark.createDataFrame([(op_id,)], "op_id string")
        found = of_operations(self.stored(), wanted)
        ids = [r.op_id for r in found.operations.select("op_id").limit(2).collect()]
        if ids != [op_id]:
            raise LogError("MissingOperation" if not ids else "IdentityCollision", op_id)
        return found

    def put(self, log: Log) -> int:
        """Append the operations that aren't there yet, all or nothing; returns how many. One that is
        there must be the same in all its facts."""
        there = self.stored()
        if there.tables:
            mine = operation_digest(log).withColumnRenamed("digest", "mine")
            clash = operation_digest(there).join(mine, "op_id").filter("digest <> mine").first()
            if clash:
                raise LogError("IdentityCollision", clash.op_id)
        new = log.operations.select("op_id").join(there.operations.select("op_id"), "op_id", "left_anti").distinct()
        n = new.count()
        if not n:
            return 0
        batch = f"batches/{uuid.uuid4().hex}"
        for name, table in of_operations(log, new).tables.items():
            if name == "operations" or not table.isEmpty():
                table.write.parquet(f"{self.root}/{batch}/{name}")
        self._write(self._path(f"{batch}/committed"), b"")
        return n

    def put_object(self, object_id: str, payload: bytes) -> None:
        """Keep a payload under its id; another one under the same id is a fault."""
        path = self._path(f"objects/{check_component(object_id)}")
        part = self._path(f"objects/{object_id}.{uuid.uuid4().hex}.part")
        if not self._fs().exists(path):
            self._write(part, payload)
            # false if another writer was faster
            self._fs().rename(part, path)
            self._fs().delete(part, False)
        if hashlib.sha256(self._read(path)).digest() != hashlib.sha256(payload).digest():
            raise LogError("IdentityCollision", object_id)

    def get_object(self, object_id: str) -> bytes:
        path = self._path(f"objects/{check_component(object_id)}")
        if not self._fs().exists(path):
            raise LogError("MissingObject", object_id)
        return self._read(path)

    def _manifest(self) -> tuple[int, list[str]]:
        """Number and heads of the highest whole manifest; 0 and none without any."""
        for path in reversed(self._found("heads/*.json")):
            try:
                body = json.loads(self._read(self._jvm.org.apache.hadoop.fs.Path(path)))
            except ValueError:  # a writer broke off
                continue
            return int(path.rpartition("/")[2].removesuffix(".json")), body["heads"]
        return 0, []

    def heads(self) -> list[str]:
        return self._manifest()[1]

    def publish_heads(self, expected: list[str], following: list[str], tries: int = 50) -> str:
        """``published`` or ``already-present`` if the heads are as expected, else ``merged``."""
        frame = lambda ids: self.spark.createDataFrame([(i,) for i in ids], "op_id string")
        lost = frame(following).join(self.stored().operations, "op_id", "left_anti").first()
        if lost:
            raise LogError("MissingOperation", lost.op_id)
        for _ in range(tries):
            _, actual = self._manifest()
            heads = sorted(r.op_id for r in publish_heads(frame(actual), frame(expected), frame(following)).collect())
            if heads == sorted(actual):
                return "already-present"
            taken = [int(p.rpartition("/")[2].removesuffix(".json")) for p in self._found("heads/*.json")]
            number = max(taken, default=0) + 1
            if self._write(self._path(f"heads/{number:012d}.json"), json.dumps({"heads": heads, "of": actual}).encode()):
                # a writer that saw this one unfinished may have passed it by
                if all(set(heads) <= set(self._line(p)) for p in self._found("heads/*.json") if int(p.rpartition("/")[2].removesuffix(".json")) > number):
                    return "published" if sorted(actual) == sorted(expected) else "merged"
        raise TimeoutError("other writers publish all the time")

    def _line(self, path: str) -> list[str]:
        """Heads of a manifest and those it was made from."""
        try:
            body = json.loads(self._read(self._jvm.org.apache.hadoop.fs.Path(path)))
        except ValueError:
            return []
        return [*body["heads"], *body["of"]]

    def publish(self, log: Log) -> str:
        """Put a log's operations, and let its heads follow the parents that they have in the store."""
        self.put(log)
        following = [r.op_id for r in operation_heads(log).collect()]
        actual = self.heads()
        # heads that the new operations name as parents
        mine = self.spark.createDataFrame([(h,) for h in actual], "parent_id string")
        replaced = [r.parent_id for r in mine.join(log.parents, "parent_id", "left_semi").collect()]
        return self.publish_heads(replaced, following)

    def load(self) -> Log:
        """The log that the heads descend to."""
        all_rows, heads = self.stored(), self.heads()
        frame = self.spark.createDataFrame([(i,) for i in heads], "op_id string")
        return of_operations(all_rows, reachable(all_rows, frame) if heads else frame)
