"""What the operators of this subpackage share: session preparation, written tables, Arrow streams.

Conventions that hold for every operator here:

* Columns are picked by name at the start, so extra columns (whatever their names) never reach the internals.
* Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; that is exactly what ``bytes.split()`` yields on UTF-8.
* A null text counts as a text without words.  A null id is kept as null.
* Rows are identified inside an operator by :func:`row_key`, a digest of id and text, so null or repeated ids and
  repeated rows are safe: equal rows get equal results.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of an Arrow batch; with texts of 100 kB each a batch stays near 25 MB.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors and bound the rows of Arrow batches of this session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where it is unset a temporary one is made, but only if all executors are on this machine (tests)."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not getattr(sc, "_tagwise_dir", None):
        sc._tagwise_dir = "file://" + tempfile.mkdtemp(prefix="tagwise-shared-")
    return sc._tagwise_dir


#: Folders written by this process, oldest first.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/tagwise/{name}-{uuid.uuid4().hex}")
    return _written[-1]


#: For tables written to a local folder (other stores are written as ever): without Hadoop's native library its file system
#: starts ``chmod`` for each file and for the checksum file beside it, and until a child process has started its program it
#: counts with all the memory of the executor's JVM.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**PLAIN_FILES).parquet(path)
    deleted_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tagwise_path = path
    return out


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """Results read written tables when they are computed, so these stay until the driver ends."""
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote with :func:`new_path`, once nothing reads it any more."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` returned, once nothing reads it any more."""
    drop_path(df.sparkSession, df._tagwise_path)


def mark() -> int:
    """For :func:`drop_since`: how much this process has written so far."""
    return len(_written)


def drop_since(spark: SparkSession, start: int, *keep: DataFrame) -> None:
    """Delete what was written since ``start`` but the tables ``keep``; only when no result of that time is still to be read."""
    held = {df._tagwise_path for df in keep}
    for path in [p for p in _written[start:] if p not in held]:
        drop_path(spark, path)
        _written.remove(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: what partition counts are sized by."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def aside(docs: DataFrame, *named: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``named`` under names that no operator uses, and what brings the old table back."""
    held = {c: c if c in named else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in held.items())), [F.col(n).alias(c) for c, n in held.items()]


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    """Return what the allocator holds of freed arrays; cheap enough for every batch."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """``run`` over batches, after which the worker, idle or not, holds none of the task's memory."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return out


_held: dict = {}


def worker_state(key, make=None):
    """What a Python worker keeps from task to task: one thing at a time.

    Spark reuses workers for all operators, so whatever another operator has kept is let go first, and freed memory goes
    back to the system."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make() if make else None
    return _held[key]


def row_key(id_col: str, text_col: str) -> Column:
    """32 hex digits that identify id and text; rows with the same key are the same document."""
    return F.md5(
        F.concat(
            F.coalesce(F.col(id_col).cast("string"), F.lit("-")).cast("binary"),
            F.lit(b"\x00"),
            F.coalesce(F.col(text_col).cast("binary"), F.lit(b"\xff")),
        )
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (binary or string) holds about ``limit`` bytes in each; rows stay whole."""
    for b in batches:
        col = b.column(column)
        if not b.num_rows or col.nbytes <= limit:
            if b.num_rows:
                yield b
            continue
        size, start = np.asarray(pc.fill_null(pc.binary_length(col), 0)), 0
        total = 0
        for i, n in enumerate(size):
            if total and total + n > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        yield b.slice(start)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Groups of a stream that is sorted by ``key``: one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k) for k in key]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            eq = pc.equal(c.slice(1), c.slice(0, b.num_rows - 1)) if b.num_rows > 1 else pa.array([], pa.bool_())
            change[1:] |= ~np.asarray(pc.fill_null(eq, False), dtype=bool)
        first = tuple(c[0].as_py() for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(c[b.num_rows - 1].as_py() for c in cols)
    if held:
        yield pa.Table.from_batches(held)
