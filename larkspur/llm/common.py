"""Helpers shared by the operators: whole-text batches, words, durable tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z on bytes.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Text bytes that a worker turns into Python objects at once.
SLICE_BYTES = 4 << 20


#: Rows of whole texts that go to a Python worker at once; the engine's default would be some 10 MB and more.
ROWS = 1_000
#: And bytes; one row may have more.
BYTES = str(8 << 20)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > ROWS:
        spark.conf.set(name, str(ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)


def settle() -> None:
    """Give back to the system what the group before has left in this worker's pools."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir``.

    Only where that setting is missing and all runs in one process, a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"larkspur-{os.getpid()}")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage.

    The copy is compressed and outlives any executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table that ``durable`` wrote and nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores, such that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``limit`` bytes of text each, and one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
    sizes = lengths.to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    return text.translate(LOWER).split()


def interned(lists: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct values, each value's index in order, and the number of values of each list."""
    index: dict = defaultdict()
    index.default_factory = index.__len__
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((index[w] for ws in lists for w in ws), dtype=np.int64, count=int(counts.sum()))
    return list(index), flat, counts


def by_list(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; an empty run gives 0."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def add_columns(df: DataFrame, column: str, added: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``make`` derives from each slice of a batch; one of the same name is replaced."""
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in added}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *make(part)], names=names)

    return df.mapInArrow(run, schema)


def held_out(column: str, modulus: int, rest: int):
    """crc32(the id as text) mod ``modulus`` is ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == rest, F.lit(False))
