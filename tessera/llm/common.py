"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark sends to a Python worker at a time.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what the JVM and a Python worker hold of a table at a time; a session's smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back to the system when a task ends: Python workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every node can reach.

    Only a local session may lack that setting; a folder of this machine is
    used then.  The folder goes when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}/{name}"
    atexit.register(_delete, spark, path.rsplit("/", 1)[0])
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has already ended
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This ends the lineage on storage that outlives any executor.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` early: all that is made of them must have been written."""
    for t in tables:
        _delete(t.sparkSession, t.scratch)


@dataclass(frozen=True)
class IdFilter:
    """A bitmap of the low bits of longs: never misses one that it was made of, and may take others for one.

    Its size is bounded by ``MOST_BITS`` (8 MB), so it may go to every task.
    """

    mask: int
    bits: np.ndarray

    LEAST_BITS, MOST_BITS = 12, 26

    @classmethod
    def of(cls, rows: DataFrame, column: str) -> IdFilter:
        """The filter of a column's values, put together in Spark."""
        n = rows.count()
        power = min(cls.MOST_BITS, max(cls.LEAST_BITS, (8 * n).bit_length()))
        mask = (1 << power) - 1
        slot = F.col(column).bitwiseAND(F.lit(mask))
        words = rows.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, int({column} & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        t = words.toArrow()
        bits = np.zeros((mask >> 6) + 1, np.int64)
        bits[t.column("w").to_numpy()] = t.column("b").to_numpy()
        return cls(mask, bits)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        slot = values & self.mask
        return (self.bits[slot >> 6] >> (slot & 63)) & 1 == 1


#: Items are counted in this many counters, which travel in rows of ``CHUNK``.
COUNTERS, CHUNK = 1 << 17, 1 << 12


def counter_of(h: np.ndarray) -> np.ndarray:
    """The counter of each 64-bit hash."""
    return (h >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def counter_rows(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's counters as ``chunk int, counts binary``."""
    parts = counts.astype(np.int64).reshape(-1, CHUNK)
    return pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())


def summed(parts: DataFrame) -> np.ndarray:
    """All tasks' counters ``(chunk, counts)``, added up in two steps: what a task adds, and the driver gets, is bounded."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for b in batches:
            for c in b.column("counts").to_pylist():
                total += np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    dealt = parts.select("chunk", "counts", F.pmod(F.spark_partition_id(), F.lit(64)).alias("deal"))
    once = dealt.groupBy("chunk", "deal").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    for r in once.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
