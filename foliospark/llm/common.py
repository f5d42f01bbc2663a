"""What the operators of this package share: tables on shared storage, task memory and word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of files that a broadcast side may have, whatever its rows.
BROADCAST_BYTES = 64 << 20
#: Bytes of a batch of rows on its way to a Python worker: the executor, the pipe and the worker hold it at the same time,
#: and Spark's own 64 MB would outweigh all that a task needs besides.  A longer row is a batch by itself.
BATCH_BYTES, BATCHES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it is unset, only a local master (tests) gets a temporary one: executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's own switch to delete the shuffle files of a query when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df: writes it as Parquet to the shared folder and reads it back.

    Unlike a local checkpoint the files outlive any executor, and unlike an RDD checkpoint
    they are compressed and columnar, so later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what is written needs its shuffles no more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table written before, as the optimiser counts them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def per_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` as a task whose memory goes back to the system at its end, though the worker process lives on.

    Batches that it gets have up to ``BATCH_BYTES``, unless the session names a number of its own."""
    spark = SparkSession.getActiveSession()
    if spark and not spark.conf.get(BATCHES, None):
        spark.conf.set(BATCHES, BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


class WordHashes(dict):
    """64-bit hashes of words; remembers up to ``most`` short ones.  One a task, so that it ends with it."""

    def __init__(self, most: int = 50_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 32 and len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
