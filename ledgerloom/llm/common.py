"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D (what bytes.split() uses).
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named a session on one machine (tests) gets
    a temporary one; on a cluster that would not be shared, so it is refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
        spark.conf.set(_OWN, folder)
    return folder


_OWN = "ledgerloom.own.checkpoint.dir"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later step reads, in whatever store it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, where the session does not say how many: texts are long, and each
    task holds a batch in two processes. Only the queries and the pipeline's stages ask for it, the operators don't."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, rows)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy_shuffles(spark: SparkSession) -> None:
    """Shuffle files go as soon as the job that they were written for has ended, where the session does not say otherwise.
    Without it they stay until the driver happens to collect garbage, so that those of all steps lie on disk at once. Steps
    read checkpoints and written folders, never an earlier job's shuffle; toLocalIterator() outlives its action, so what it
    reads is cut() first."""
    if _TIDY not in spark.conf.getAll:
        spark.conf.set(_TIDY, "true")


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What make() gives, remembered in a worker process for its later tasks; a process keeps one such thing at a time."""
    if key not in _kept:
        drop_kept()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    if _kept:
        _kept.clear()
        gc.collect()


def trimmed(work: Callable, keeps: bool = False) -> Callable:
    """work, and then the memory that it has freed is given back: worker processes live on for other tasks. What another
    task has kept() is let go first, unless work keeps something itself."""

    def run(batches):
        if not keeps:
            drop_kept()
        try:
            yield from work(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux
            if trim:
                trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions, not fewer than the session's setting, so that joins keep a stored partitioning."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only the needed columns, by name: extra columns can't clash with those made later."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return [x or b"" for x in values.to_pylist()]


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about limit bytes of the column at most, or one row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0))
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, rows - start)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Local:
    """Connected components of one block of nodes 0..n-1, from pairs that come in chunks."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        root = self.root
        while left.size:
            a, b = root[left], root[right]
            open_ = a != b
            left, right = left[open_], right[open_]
            low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
