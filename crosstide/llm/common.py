"""Shared helpers: tables, stored intermediate tables, chunks of whole documents, connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = np.iinfo(np.int64).max
"""Stands for a missing id: larger than any id, so such a row is never the earlier one."""
ROWS_A_TASK, EDGES_A_TASK, LEAST_TASKS = 4096, 65536, 8
"""Where a table's rows are counted, steps over it take a task for so many documents or edges, instead of the session's shuffle width if that is more."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="crosstide-llm-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{_own_folder()}"


class Scratch:
    """Tables written to the shared folder and read again: they cut lineage and survive lost executors. The folder goes when the
    driver's JVM ends, since results are lazy and may read it until then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def table(self, name: str, df: DataFrame, parts: int | None = None) -> DataFrame:
        """parts: tasks and files at most, where the rows are known to be few for the session's shuffle width."""
        (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def clear(self) -> None:
        """Drops the whole folder, once nothing reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """`name`, with underscores added until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(batch: pa.RecordBatch | pa.Table, name: str = "text") -> tuple[np.ndarray, memoryview]:
    """Offsets (rows + 1) and the buffer of a binary column; nulls are empty."""
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, memoryview(data if data is not None else b"")


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(int(LAST_ID)).to_numpy(zero_copy_only=False)


def cuts(offsets: np.ndarray, size: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive whole documents of about `size` bytes, or one longer document, and at most `rows` documents."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        b = min(b, a + rows) if rows else b
        yield a, b
        a = b


_ZSTD = pa.Codec("zstd", compression_level=3)


def packed(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return np.uint64(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def steps(values: np.ndarray, kind) -> np.ndarray:
    """Differences of neighbours, which pack well for rising values; np.cumsum gives the values back."""
    return np.diff(values.astype(np.int64), prepend=0).astype(kind)


def unpacked(blob: bytes, kind=None):
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.uint64)[0]), codec="zstd", asbytes=True)
    return raw if kind is None else np.frombuffer(raw, kind)


CHUNKS = "chunk_id long, n_docs long, n_bytes long, ids binary, offsets binary, text binary, rest binary"


def chunked(docs: DataFrame, size: int, keep: bool = False) -> DataFrame:
    """Whole documents gathered into compressed chunks of about `size` bytes. doc_id and text are carried, and with keep every
    column (as an Arrow stream in `rest`). A chunk id is unique; the table must be stored before it is used twice."""
    own_id, own_text = unused("__id", docs.columns), unused("__text", docs.columns)
    columns = [F.col("doc_id").cast("long").alias(own_id), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias(own_text)]
    columns += [F.col(f"`{c}`") for c in docs.columns if c != "text"] if keep else []

    def chunks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            offsets, data = text_bytes(batch, own_text)
            ids = ids_of(batch.column(own_id))
            for a, b in cuts(offsets, size):
                rest = b""
                if keep:
                    sink = pa.BufferOutputStream()
                    part = batch.slice(a, b - a).drop_columns([own_id, own_text])
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    rest = packed(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_pydict({
                    "chunk_id": pa.array([number], pa.int64()), "n_docs": pa.array([b - a], pa.int64()),
                    "n_bytes": pa.array([int(offsets[b] - offsets[a])], pa.int64()), "ids": pa.array([packed(ids[a:b])], pa.binary()),
                    "offsets": pa.array([packed(offsets[a:b + 1] - offsets[a])], pa.binary()),
                    "text": pa.array([packed(bytes(data[offsets[a]:offsets[b]]))], pa.binary()), "rest": pa.array([rest], pa.binary())})
                number += 1

    return docs.select(*columns).mapInArrow(chunks, CHUNKS)


def components(scratch: Scratch, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b), by alternating large and small stars.

    Each round regroups stored edges by node; minima are aggregated before the exchange. The join that hands a hub's minimum to its edges
    relies on adaptive skew splitting. Ends when a round leaves the edges as they were. Nodes without an edge are not listed.
    parts: tasks at most for the first table; with it, rounds take a task for each EDGES_A_TASK edges at most."""
    now = scratch.table("edges0", edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), parts)
    key, turn = _state(now), 0
    while key[0]:
        turn += 1
        tasks = max(LEAST_TASKS, -(-key[0] // EDGES_A_TASK)) if parts else None
        fold = lambda df: df.coalesce(tasks) if tasks else df  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = fold(both.join(low, "a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.table(f"large{turn}", large, tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = fold(large.join(low, "a"))
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").filter("a <> b").distinct()
        small = scratch.table(f"edges{turn}", small, tasks)
        scratch.drop(f"large{turn}", f"edges{turn - 1}")
        before, key, now = key, _state(small), small
        if key == before:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])
