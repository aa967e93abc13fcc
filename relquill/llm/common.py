"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy code in slices of about this many bytes, whatever size an Arrow batch has.
SLICE_BYTES = 4_000_000
#: The same where an operator makes many temporary arrays or strings of each slice.
SMALL_SLICE_BYTES = 1_000_000
#: A key with a larger share of the rows than one in so many is broadcast instead of shuffled.
HEAVY_KEYS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the ids that no model learns from: crc32(id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and all is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="relquill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` gave, once nothing will read it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def uneven_join(rows: DataFrame, table: DataFrame, on: list[str], n: str = "n", how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined to ``table`` (one row for each key, with the number ``n`` of its rows), whatever share a key has.

    Keys with over a thousandth of the rows, of which there are at most a thousand, are broadcast; the others are shuffled.
    ``rows`` should be a materialised table, as it is read more than once. Null keys match nothing. ``how``: inner or left.
    ``total``: the number of rows, where it is known.
    """
    most = max(1, (rows.count() if total is None else total) // HEAVY_KEYS)
    heavy, light = table.where(F.col(n) > most), table.where(F.col(n) <= most)
    hot = rows.join(F.broadcast(heavy), on)  # at most HEAVY_KEYS rows
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return hot.unionByName(rest)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, with freed memory given back to the system at its end: idle Python workers keep little."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Give this process's freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batch, column: str = "text", most: int = SLICE_BYTES) -> Iterator:
    """Cut an Arrow batch into slices whose ``column`` holds about ``most`` bytes; a longer text has a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens.astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
