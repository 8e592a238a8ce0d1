"""Training-order materialisation of token sequences in fixed-stride shards.

The ids of documents, each with an end id after it, follow each other and are cut into sequences
of ``length`` ids, so only the last sequence of each task that reads the table needs filling. A
keyed Feistel network over the smallest even-bit domain that holds all sequences, walked until it
lands among them, is a permutation of 0 .. n - 1: every sequence gets a global slot, with no sort
and no table. Slots are laid out in shards of ``per_shard`` records of one stride, so record s of
the training order lies in shard ``s // per_shard`` at byte ``s % per_shard * stride``: a run can
resume anywhere, and reads are sequential. Rows move once, to the range of slots that their task
writes, in up to WAVES ranges of shards one after another, so that a part of the ids at most lies
in shuffle files. The shards are files of the shared folder under a manifest, and the index is
made from what is read back from them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_written, maybe_broadcast, shared_dir, written
from ._text import mix
from ._tokens import tokens

LENGTH = 1024
PER_SHARD = 4096
KEY = 20_240_601
ROUNDS = 6
#: Ranges of shards that are exchanged one after another, at most.
WAVES = 2
#: Ends a document, and fills the rest of a record: the end id of the 50k vocabulary.
END_ID = 50256
#: Sequences of a batch that leaves a task.
_BATCH = 2_000


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers below ``n``: a permutation of 0 .. n - 1 that ``key`` picks."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = x = left << half | right
        todo = todo[x >= n]
    return out.astype(np.int64)


class Layout:
    """How records lie. n: sequences; stride: bytes of a record; kind: NumPy type of an id."""

    def __init__(self, n: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2", key: int = KEY, digest: str = ""):
        self.n, self.length, self.per_shard, self.kind, self.key, self.digest = n, length, per_shard, kind, key, digest
        self.stride = np.dtype(kind).itemsize * length
        self.shards = -(-n // per_shard)

    def records(self, shard: int) -> int:
        return min(self.per_shard, self.n - shard * self.per_shard)

    def manifest(self) -> bytes:
        """What has to agree for shards to be of the same order: all that fixes their bytes."""
        return json.dumps({"sequences": self.n, "length": self.length, "per_shard": self.per_shard, "ids": self.kind, "key": self.key, "input": self.digest}, sort_keys=True).encode()


def id_kind(path: str, end_id: int) -> str:
    """Little-endian unsigned ids of 16 bits, or of 32 if the vocabulary or the end id needs them."""
    return "<u2" if max(tokens(path).size, end_id + 1) <= 1 << 16 else "<u4"


def sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Sequences of all documents: ids (little-endian), task, nth, and parts: the pieces of documents
    that follow each other in it (own_id, piece, start: the document's ids before it, n_tokens)."""
    kind = id_kind(path, end_id)
    rows = docs.select(F.col(id_col), F.col(text_col), F.spark_partition_id().alias("own task"))
    own = rows.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = (to_arrow_type(own), pa.int32(), pa.int64(), pa.int32())
        encoder, width = tokens(path), np.dtype(kind).itemsize
        end = np.array([end_id], dtype=kind).tobytes()
        full, task, nth = length * width, 0, 0
        open_ids, out, ends = bytearray(), [], [0]
        parts: tuple[list, ...] = ([], [], [], [])

        def batch() -> pa.RecordBatch:
            nonlocal nth
            first, nth = nth, nth + len(out)
            flat = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, kinds, strict=True)], names=["own_id", "piece", "start", "n_tokens"])
            columns = [pa.array(out, pa.binary()), pa.array(np.full(nth - first, task, dtype=np.int32)), pa.array(np.arange(first, nth)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            for x in (out, *parts):
                x.clear()
            ends[:] = [0]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "task", "nth", "parts"])

        for b in batches:
            task = b.column(2)[0].as_py() if len(b) else task
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(encoder.encode(text), dtype="<u4").astype(kind).tobytes() + end
                at = piece = 0
                while at < len(data):
                    taken = data[at : at + full - len(open_ids)]
                    for x, value in zip(parts, (doc, piece, at // width, len(taken) // width), strict=True):
                        x.append(value)
                    open_ids += taken
                    at, piece = at + len(taken), piece + 1
                    if len(open_ids) == full:
                        out.append(bytes(open_ids))
                        ends.append(len(parts[0]))
                        open_ids = bytearray()
                        if len(out) == _BATCH:
                            yield batch()
        if open_ids:
            out.append(bytes(open_ids))
            ends.append(len(parts[0]))
        if out:
            yield batch()

    kinds = f"ids binary, task int, nth long, parts array<struct<own_id: {own.simpleString()}, piece: int, start: long, n_tokens: int>>"
    return rows.mapInArrow(run, kinds)


def placed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end_id: int = END_ID) -> tuple[DataFrame, Layout]:
    """(ids, parts, slot) of all sequences, a written table, and their layout.

    The number of a sequence is its place among the tasks that read the table, fixed by the table
    that is written here; the same files read alike give the same order.
    """
    rows = written(sequences(docs, path, id_col, text_col, length, end_id), "sequences")
    digest = F.sum(F.xxhash64("task", "nth", "ids").cast("decimal(20,0)"))
    per = written(rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")), "sequence-counts")
    whole = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("digest").cast("string").alias("digest"), F.count(F.lit(1)).alias("tasks")).first()
    layout = Layout(whole.n, length, per_shard, id_kind(path, end_id), key, whole.digest or "")
    # one row for each task that read the table
    bases = per.select(F.col("task").alias("b_task"), (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    numbered = rows.join(maybe_broadcast(bases, whole.tasks), F.col("task") == F.col("b_task"))
    n = layout.n

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(permute(x.to_numpy(), n, key))

    return numbered.select("ids", "parts", F.arrow_udf(run, "long")(F.col("base") + F.col("nth")).alias("slot")), layout


def in_order(rows: DataFrame, layout: Layout, first: int, last: int) -> DataFrame:
    """The sequences of shards ``first`` to ``last - 1``, each task holding whole shards in slot order."""
    shards = last - first
    fits = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(shards, max(fits, -(-shards // 16))))
    each = -(-shards // tasks) * layout.per_shard
    low, high = first * layout.per_shard, last * layout.per_shard
    mine = rows.filter((F.col("slot") >= low) & (F.col("slot") < high))
    return mine.repartitionById(tasks, F.floor((F.col("slot") - low) / each).cast("int")).sortWithinPartitions("slot")


def _assembled(batches: Iterator[pa.RecordBatch], layout: Layout, end_id: int) -> Iterator[tuple[int, bytes, pa.ListArray]]:
    """Shards of a task: number, bytes, and the parts of each record."""
    fill = np.full(layout.length, end_id, dtype=layout.kind).tobytes()
    body, rows, n, now = bytearray(), [], 0, -1
    for b in batches:
        shards = b.column(2).to_numpy() // layout.per_shard
        for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(shards)) + 1):
            if not len(part):
                continue
            shard, mine = int(shards[part[0]]), b.slice(part[0], len(part))
            if shard != now:
                if rows:
                    yield now, bytes(body), pa.concat_arrays(rows)
                body, rows, n, now = bytearray(), [], 0, shard
            if not np.array_equal(mine.column(2).to_numpy(), shard * layout.per_shard + n + np.arange(len(part))):
                raise ValueError(f"slots don't follow each other in shard {shard}")
            for ids in mine.column(0).to_pylist():
                body += ids
                body += fill[len(ids) :]
            rows.append(mine.column(1))
            n += len(part)
    if rows:
        yield now, bytes(body), pa.concat_arrays(rows)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write_shard(folder: str, shard: int, payload: bytes) -> bytes:
    """Write a shard's file unless it is there whole, and return what is read back from it."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{shard_name(shard)}"
    info = store.get_file_info(path)
    if info.type != fs.FileType.File or info.size != len(payload):
        # a name of its own, as another attempt of the task may be writing too
        part = f"{path}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            out.write(payload)
        store.move(part, path)
    with store.open_input_stream(path) as file:
        found = file.read()
    if found != payload:
        raise ValueError(f"{path} holds other records")
    return found


def claim_folder(folder: str, layout: Layout) -> None:
    """Make ``folder`` that of the layout: an error if it holds shards of another key, input or
    layout, or shards without a manifest, so that none of these is taken for a part of this order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    path = f"{base}/manifest.json"
    if store.get_file_info(path).type == fs.FileType.File:
        with store.open_input_stream(path) as file:
            if file.read() != layout.manifest():
                raise ValueError(f"{folder} holds the shards of another order")
        return
    if any(f.base_name.endswith(".bin") for f in store.get_file_info(fs.FileSelector(base))):
        raise ValueError(f"{folder} holds shards without a manifest")
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(layout.manifest())
    store.move(part, path)


def write_shards(rows: DataFrame, layout: Layout, folder: str, id_col: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``rows`` (see :func:`in_order`) to ``folder``, and return their index: the
    id, piece, start, n_tokens, slot, shard, byte_offset (of the record), at (the piece's first id
    in the record) and record_crc32 (of the whole record, as it is read back).

    A file appears under its name only when it is whole, and one of the right size is kept if it
    holds the same bytes, so that a run that broke off goes on where it was.
    """
    own = rows.schema["parts"].dataType.elementType["own_id"].dataType
    kinds = {"own_id": None, "piece": pa.int32(), "start": pa.int64(), "n_tokens": pa.int32(), "slot": pa.int64(), "shard": pa.int64(), "byte_offset": pa.int64(), "at": pa.int32(), "record_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        mine = kinds | {"own_id": to_arrow_type(own)}
        for shard, payload, parts in _assembled(batches, layout, end_id):
            body, n = memoryview(_write_shard(folder, shard, payload)), len(parts)
            crc = np.array([zlib.crc32(body[i * layout.stride : (i + 1) * layout.stride]) for i in range(n)])
            sizes, flat = parts.value_lengths().to_numpy(), parts.flatten()
            record = np.repeat(np.arange(n), sizes)
            tokens_before = np.cumsum(flat.field(3).to_numpy()) - flat.field(3).to_numpy()
            at = tokens_before - tokens_before[np.cumsum(sizes) - sizes][record]
            columns = [*flat.flatten(), shard * layout.per_shard + record, np.full(len(record), shard), record * layout.stride, at, crc[record]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, mine.values(), strict=True)], names=list(mine))

    ddl = f"own_id {own.simpleString()}, piece int, start long, n_tokens int, slot long, shard long, byte_offset long, at int, record_crc32 long"
    return rows.mapInArrow(run, ddl).withColumnRenamed("own_id", id_col)


def materialise(
    docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end_id: int = END_ID, waves: int = WAVES
) -> DataFrame:
    """Write the shards of ``docs`` to ``folder`` (a URI; else a new one in the shared folder) and
    return their index (see :func:`write_shards`), one row for each piece of a document in a
    record. All shards are written on return.

    Defined cases: null and empty texts are the end id alone; a text longer than a sequence goes on
    in the next one; repeated rows are laid out each; ids may be null; other columns aren't looked
    at, whatever their names; an empty table gives no shards; ids of vocabularies above 65,536
    take 32 bits; a folder that holds another order is an error.
    """
    rows, layout = placed(docs.select(F.col(id_col), F.col(text_col)), path, id_col, text_col, length, per_shard, key, end_id)
    folder = folder or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    claim_folder(folder, layout)
    waves = max(1, min(waves, layout.shards))
    edges = [layout.shards * w // waves for w in range(waves + 1)]
    parts = [written(write_shards(in_order(rows, layout, a, b), layout, folder, id_col, end_id), "index") for a, b in zip(edges, edges[1:], strict=False)]
    drop_written(rows)
    return reduce(DataFrame.unionByName, parts)
