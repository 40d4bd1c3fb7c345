"""What the operators of this folder share: the shared folder, written tables, Arrow batches.

Lineage is cut only by tables written below ``spark.checkpoint.dir``, so a lost executor never
takes the single copy of an intermediate with it.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that are ever broadcast explicitly at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of text that a Python worker turns over at once.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none (local mode)."""
    for read in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := read():
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def forget_shuffles(spark: SparkSession) -> None:
    """Has the driver's JVM look for what nothing refers to any more, so that Spark deletes those shuffle files.

    The scheduler and its threads refer to the last query, and so do events on their way: a small query takes its place,
    and the events are waited for.
    """
    spark.range(1).agg(F.count("*")).collect()
    with contextlib.suppress(Py4JJavaError):  # after ten seconds it goes on without
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark._jvm.System.gc()


def release(*tables: DataFrame, shuffles: bool = False) -> None:
    """Deletes tables made by :func:`written` that no later result reads.

    ``shuffles``: the shuffle files that led to them go too.
    """
    if shuffles and tables:
        forget_shuffles(tables[0].sparkSession)
    for df in tables:
        path = df._graphloom_path
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Returns the memory that this Python worker has freed to the system; else a worker that is used again keeps it beside the next task's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def width(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    out = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        size = F.octet_length(c) if kind in ("string", "binary") else 8 * F.size(c) if kind in ("array<bigint>", "array<double>") else F.length(F.to_json(F.struct(c))) if "<" in kind else F.lit(8)
        out = out + 8 + F.coalesce(size, F.lit(0))
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else unchanged: then the join shuffles.

    Measuring needs no more than ``rows + 1`` rows.
    """
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def text_chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about ``limit`` bytes together; a longer text comes alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield start, len(lengths)
