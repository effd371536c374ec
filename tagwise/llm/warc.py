"""WARC archives: writing with Spark's text sink, reading back by boundary-chain verification.

Writing: a record is one row of text whose line separator is the record separator, so that each task writes its archive to
any file system that Spark can reach.  Payloads of at least :data:`REVISIT_BYTES` that occur more than once are stored
once, with the smallest page id; the others are revisits.

Reading: archives are split at every occurrence of the magic, wherever it stands, by Spark's text source, in parallel
within a file.  Every such place is a candidate record: its header gives the offset of its successor.  Within a split,
pointer jumping finds where each candidate's chain leaves the split; across splits it follows the chain from the file's
start.  Only records that this chain reaches are kept, so a magic inside a payload is rejected even if a complete record
follows it.  Payloads that hold a magic are put together again from their pieces.

Null html: empty payload.  Null url: empty.  Line ends in urls and ids, and a magic at their end, are percent-encoded.  A null page id is written empty and read as null.  Rows that repeat the
smallest page id of a payload are all responses.  Empty tables give empty results.  A file that does not start with a
record, or whose chain breaks, gives the records up to there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import deleted_at_exit, materialize, new_path, prepare

MAGIC, SEPARATOR = "WARC/1.0\r\n", "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
REVISIT_BYTES = 100
#: Bytes of chunks in one batch of a task, about.
BATCH_BYTES = 8 << 20


def in_header(value: Column) -> Column:
    """A text as it may stand in a header line: percent-encoded where it would end the line or hold the magic."""
    out = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(out, "WARC/1\\.0$", "WARC/1%2E0")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` to archives in ``path``."""
    prepare(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        in_header(F.col(url_col)).alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
    )
    known = materialize(rows.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest"), "warc-digests")
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(
        known.join(first, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(),
        "warc-revisits",
    )
    typed = rows.join(again, ["page_id", "digest"], "left")  # written tables: the optimizer knows their size
    revisit = F.col("refers_to").isNotNull()
    as_id = lambda c: F.concat(F.lit("<urn:page:"), in_header(F.col(c).cast("string")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", as_id("page_id")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, line("WARC-Refers-To", as_id("refers_to"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    typed.select(record.alias("value")).write.option("lineSep", SEPARATOR).text(path)


CANDIDATES = (
    "file string, block long, seq long, rel long, size long, total long, exit long, is_record boolean, warc_type string, record_id string,"
    " target_uri string, refers_to string, header_digest string, payload_bytes long, payload_digest string, payload binary"
)
_NAMES = [x.split()[0] for x in CANDIDATES.split(",")]
_ARROW = [pa.string(), *[pa.int64()] * 6, pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]


def _head(chunk: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Header length with its blank line, content length and fields; None if this is no record header."""
    at = chunk.find(b"\r\n\r\n")
    if at < 0:
        return None
    fields = {}
    for line in chunk[:at].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields:
        return None
    return at + 4, int(length), fields


def leaving(rel: np.ndarray, total: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Pointer jumping: the offset at which each candidate's chain leaves the split, -1 where it breaks."""
    n = len(rel)
    if not n:
        return np.zeros(0, np.int64)
    target = rel + total
    at = np.minimum(np.searchsorted(rel, target), n - 1)
    inside = ok & (target <= rel[-1])
    jump = np.where(inside & (rel[at] == target), at, np.arange(n))
    end = np.where(ok & ~inside, target, -1)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return end[jump]
        jump = further


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, place in its split, bytes) in file order."""
    last, seq = None, 0
    for b in batches:
        for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            seq = seq + 1 if (file, block) == last else 0
            last = file, block
            yield file, block, seq, value


def candidates(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per magic (and per file start): offset in its split, where its chain leaves the split, and its fields."""

    def emit(rows: list[list]) -> pa.RecordBatch:
        rel = np.array([r[3] for r in rows], np.int64)
        ok = np.array([r[7] for r in rows], bool)
        for r, x in zip(rows, leaving(rel, np.array([r[5] for r in rows], np.int64), ok), strict=True):
            r[6] = int(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        last, at = None, 0
        for file, block, seq, value in _splits(batches):
            if (file, block) != last:
                if rows:
                    yield emit(rows)
                rows, last, at = [], (file, block), 0
            size = len(value) + len(MAGIC)
            row = [file, block, seq, at - len(MAGIC), size, 0, -1, False, None, None, None, None, None, None, None, None]
            first = block == 0 and seq == 0  # what stands before the file's first magic
            if not first and (head := _head(value)):
                start, length, f = head
                row[5:8] = [len(MAGIC) + start + length + len(SEPARATOR), -1, True]
                row[8:13] = [f["warc-type"], f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest")]
                declared = f.get("x-payload-length", "")
                row[13] = int(declared) if f["warc-type"] == "revisit" and declared.isdigit() else length
                if len(value) == start + length + len(SEPARATOR) and value.endswith(SEPARATOR.encode()):
                    payload = value[start : start + length]
                    row[14] = hashlib.sha256(payload).hexdigest()
                    row[15] = payload if with_payload else None
            rows.append(row)
            at += size
        if rows:
            yield emit(rows)

    return _chunks(spark, path).mapInArrow(run, CANDIDATES)


def _reached(found: DataFrame) -> DataFrame:
    """(file, block, entry): where the chain from each file's start enters each split; ``found`` has absolute offsets."""
    targets = found.where("exit >= 0").select("file", F.col("exit").alias("pos")).union(found.select("file", F.lit(0).cast("long"))).distinct()
    nodes = found.where("is_record").select("file", "block", "pos", "exit").join(targets, ["file", "pos"], "left_semi")

    def follow(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, out = t.column("pos").to_numpy(), t.column("exit").to_numpy()
        n = len(pos)
        at = np.minimum(np.searchsorted(pos, out), n - 1)
        jump = np.append(np.where(pos[at] == out, at, n), n)  # n: the end of the chain
        reached = np.zeros(n + 1, bool)
        reached[0] = pos[0] == 0
        while not reached[jump[reached]].all():  # twice as far in each round
            reached[jump[reached]] = True
            jump = jump[jump]
        return t.filter(pa.array(reached[:n])).select(["file", "block", "pos"])

    return nodes.groupBy("file").applyInArrow(follow, "file string, block long, pos long").withColumnRenamed("pos", "entry")


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``path`` that the chain from each file's start reaches.

    Columns: ``file, pos, warc_type, record_id, target_uri, refers_to, payload_bytes, payload_digest`` (of a revisit, as
    its header gives them), and ``payload`` if asked for.
    """
    prepare(spark)
    meta = [c for c in _NAMES if c != "payload" or with_payload]
    raw = materialize(candidates(spark, path, with_payload).select(*meta), "warc-candidates")
    # a split's first chunk follows the last one of the splits before it: the bytes of chunks and magics add up
    # one row for each split of a file
    sizes = raw.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    found = raw.join(base, ["file", "block"]).withColumns(
        {"pos": F.col("rel") + F.col("base"), "exit": F.when(F.col("exit") >= 0, F.col("exit") + F.col("base")).otherwise(-1)}
    )
    entries = _reached(found)
    names = ["file", "block", "seq", "pos", "total", "is_record", "entry"]

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, total, ok = (t.column(c).to_numpy() for c in ("pos", "total", "is_record"))
        n, entry = len(pos), t.column("entry")[0].as_py()
        target = pos + total
        at = np.minimum(np.searchsorted(pos, target), n - 1)
        jump = np.append(np.where(ok & (pos[at] == target), at, n), n)
        reached = np.zeros(n + 1, bool)
        start = int(np.searchsorted(pos, entry))
        reached[start if start < n and pos[start] == entry and ok[start] else n] = True
        reached[n] = True
        while not reached[jump[reached]].all():
            reached[jump[reached]] = True
            jump = jump[jump]
        return t.filter(pa.array(reached[:n])).select(["file", "block", "seq", "pos"])

    light = found.join(entries, ["file", "block"]).select(*names)
    good = materialize(light.groupBy("file", "block").applyInArrow(walk, "file string, block long, seq long, pos long"), "warc-chain")
    records = raw.join(good, ["file", "block", "seq"])
    whole = ["file", "pos", "warc_type", "record_id", "target_uri", "refers_to", "payload_bytes"]
    own = F.when(F.col("warc_type") == "revisit", F.regexp_replace("header_digest", "^sha256:", "")).otherwise(F.col("payload_digest"))
    out = records.select(*whole, own.alias("payload_digest"), *["payload"] * with_payload)
    open_ = materialize(records.where("payload_digest IS NULL").select("file", "block", "seq", "pos", "total"), "warc-open")
    if not open_.head(1):
        return out
    joined = _reassemble(spark, path, found, open_)
    out = out.join(joined, ["file", "pos"], "left")
    extra = [F.coalesce("payload", "whole").alias("payload")] * with_payload
    return out.select(*whole, F.coalesce("payload_digest", "whole_digest").alias("payload_digest"), *extra)


def _reassemble(spark: SparkSession, path: str, found: DataFrame, open_: DataFrame) -> DataFrame:
    """(file, pos, whole_digest, whole) of the records whose payload holds a magic, from a second read of their pieces."""
    # the last open record before a chunk: in the chunk's split, else the last one of the splits before, a row for each split
    within = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = open_.select("file", "block", "seq", F.struct("pos", "total").alias("own"))
    last = starts.groupBy("file", "block").agg(F.max("own").alias("own"))
    carried = found.select("file", "block").distinct().join(last, ["file", "block"], "left").select("file", "block", F.last("own", True).over(before).alias("carried"))
    owned = found.select("file", "block", "seq", "pos").join(starts, ["file", "block", "seq"], "left").join(carried, ["file", "block"], "left")
    owned = owned.withColumn("own", F.coalesce(F.last("own", True).over(within), "carried"))
    parts = materialize(
        owned.where(F.col("pos") < F.col("own.pos") + F.col("own.total")).select("file", "block", "seq", "pos", F.col("own.pos").alias("owner"), F.col("own.total").alias("total")),
        "warc-parts",
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "seq", "value"])

        for row in _splits(batches):
            rows.append(row)
            size += len(row[3]) + 64
            if size > BATCH_BYTES:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    def glue(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        data = MAGIC.encode() + MAGIC.encode().join(t.column("value").to_pylist())
        start, length, _ = _head(data[len(MAGIC) :])
        payload = data[len(MAGIC) + start : len(MAGIC) + start + length]
        return pa.table({"file": [key[0].as_py()], "pos": [key[1].as_py()], "whole_digest": [hashlib.sha256(payload).hexdigest()], "whole": pa.array([payload], pa.binary())})

    pieces = _chunks(spark, path).mapInArrow(number, "file string, block long, seq long, value binary")
    return pieces.join(parts, ["file", "block", "seq"]).groupBy("file", "owner").applyInArrow(glue, "file string, pos long, whole_digest string, whole binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    deleted_at_exit(pages.sparkSession, path)
    return read(pages.sparkSession, path)
