"""Removal of passages that repeat anywhere, by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Consecutive windows that share a minimiser (the least hash of
their ``grams``-word pieces) travel as one packed string to the minimiser's bucket; equal windows have equal minimisers, so
each bucket counts its windows exactly and alone: hashes are sorted, and rows of equal hash are compared word by word.
Words covered by a window that occurs at least twice are then cut from their documents.

A task packs equal strings once.  A string that it meets twice repeats for certain: its places are written down at once, and
only the string goes to the bucket, so that thousands of copies don't bring their places to one task.  What goes to a bucket
is compressed.  There are as many buckets as the bytes of the texts ask for, at least.  A first pass weighs them: a bucket that
would be far larger than others, for a minimiser that is very common, is split by another minimiser of its windows.  One whose
windows exceed :data:`PASS_WORDS` all the same is counted in several passes, each over one residue class of the window hashes.
Documents move once, compressed, to be joined with their spans.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, unchanged.  Null text: no words, stays null.  Documents with fewer words
than a window keep all.  Rows with equal id and text are copies of each other and lose all their windows.  Empty tables
give empty results.  Columns of the input named ``n_words`` or ``n_removed`` are replaced by those of the result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions, pieces, prepare, row_key, runs, text_bytes, tidied, worker_state

WIDTH, GRAMS = 35, 4
#: Buckets per shuffle partition; bytes that a task packs before it sends; words of one counting pass.
BUCKETS_PER_PARTITION, FLUSH_BYTES, PASS_WORDS = 8, 40 << 20, 8_000_000
#: Bytes of text for each shuffle partition, about, where the session asks for fewer partitions.
PARTITION_BYTES = 256 << 20
#: Buckets in one batch that a task sends; places known at once in one row.
SEND_ROWS, SEND_PLACES = 64, 50_000
#: A bucket is split that has this many words, and this many times the words of a bucket on average.
HEAVY_WORDS, HEAVY_TIMES = 2_000_000, 4
_MIX, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _least(g: np.ndarray, left: int) -> np.ndarray:
    """Least of ``left`` neighbours, by doubling."""
    step = 1
    while left > 1:
        step = min(step, left - 1)
        g = np.minimum(g[:-step], g[step:])
        left, step = left - step, step * 2
    return g


class Windows:
    """All windows of some texts: the minimiser of each, and which lie within one document."""

    def __init__(self, texts: list[bytes | None], width: int = WIDTH, grams: int = GRAMS):
        docs = [(t or b"").split() for t in texts]
        self.size, self.words = np.array([len(d) for d in docs], np.int64), [w for d in docs for w in d]
        self.width, self.left = width, width - grams + 1
        self.doc = np.repeat(np.arange(len(docs)), self.size)
        if len(self.words) < width:
            self.grams = self.minimiser = np.zeros(0, np.uint64)
            self.within = np.zeros(0, bool)
            return
        h = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))
        g = h[: len(h) - grams + 1]
        for k in range(1, grams):
            g = _mixed(g) + h[k : len(h) - grams + 1 + k]
        self.grams = _mixed(g)
        self.minimiser = _least(self.grams, self.left)
        self.within = self.doc[: len(self.minimiser)] == self.doc[width - 1 :]

    def second(self) -> np.ndarray:
        """Another minimiser of each window, by another order of the same pieces."""
        return _least(_mixed(self.grams ^ _OTHER), self.left)

    def starts(self, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First windows and lengths of the runs that share minimiser and route."""
        first = self.within.copy()
        first[1:] &= ~self.within[:-1] | (self.minimiser[1:] != self.minimiser[:-1]) | (route[1:] != route[:-1])
        s = np.flatnonzero(first)
        return s, np.bincount(np.cumsum(first)[self.within] - 1, minlength=len(s))

    def super_kmers(self, route: np.ndarray):
        """(route, bytes, document, first word's place) of each run."""
        s, n = self.starts(route)
        if not len(s):
            return
        lens = np.fromiter(map(len, self.words), np.int64, len(self.words))
        start = np.cumsum(lens + 1) - (lens + 1)
        data = b" ".join(self.words)
        last = s + n + self.width - 2
        at, to = start[s].tolist(), (start[last] + lens[last]).tolist()
        place = s - (np.cumsum(self.size) - self.size)[self.doc[s]]
        yield from zip(route[s].tolist(), (data[a:b] for a, b in zip(at, to, strict=True)), self.doc[s].tolist(), place.tolist(), strict=True)


class Router:
    """Buckets of windows: by minimiser, and those of a bucket that would be too large by another minimiser as well; equal
    windows agree in both."""

    def __init__(self, buckets: int, heavy: dict[int, int]):
        self.n, self.heavy = buckets, np.array(sorted(heavy), np.int64)
        self.parts = np.array([heavy[b] for b in sorted(heavy)], np.int64)
        self.base = buckets + np.cumsum(self.parts) - self.parts
        self.total = buckets + int(self.parts.sum())

    def __call__(self, windows: Windows) -> np.ndarray:
        route = (windows.minimiser % np.uint64(self.n)).astype(np.int64)
        if len(self.heavy) and len(route):
            k = np.minimum(np.searchsorted(self.heavy, route), len(self.heavy) - 1)
            split = np.flatnonzero(self.heavy[k] == route)
            if len(split):
                k = k[split]
                route[split] = self.base[k] + (windows.second()[split] % self.parts[k].astype(np.uint64)).astype(np.int64)
        return route


class Packer:
    """Collects super-k-mers per bucket; equal strings are kept once."""

    def __init__(self, buckets: int) -> None:
        self.n, self.bytes = buckets, 0
        self.held: dict[int, tuple[dict[bytes, int], list[int], list[bytes], list[int]]] = {}
        self.zip = zstandard.ZstdCompressor(level=3)

    def add(self, keys: list[bytes], found) -> None:
        held, total = self.held, 0
        for b, text, doc, place in found:
            if (x := held.get(b)) is None:
                x = held[b] = ({}, [], [], [])
            if (i := x[0].get(text)) is None:
                i = x[0][text] = len(x[0])
                total += len(text)
            x[1].append(i)
            x[2].append(keys[doc])
            x[3].append(place)
            total += 32
        self.bytes += total

    def flush(self) -> Iterator[pa.RecordBatch]:
        """For each bucket: strings met once with their places, and strings met more often; and, under numbers that are no
        buckets, the places of the latter."""
        rows, known = [], []
        for b, (strings, which, keys, places) in self.held.items():
            which, places = np.array(which, np.int64), np.array(places, np.int32)
            often = np.bincount(which, minlength=len(strings)) > 1
            once, names = np.flatnonzero(~often[which]), list(strings)
            own = [names[i] for i in which[once].tolist()]
            twice = [names[i] for i in np.flatnonzero(often).tolist()]
            rows.append((b, self._packed(own), b"".join(keys[i] for i in once.tolist()), self._array(places[once]), self._packed(twice)))
            if twice:
                size = np.array([x.count(b" ") + 1 if o else 0 for x, o in zip(names, often.tolist(), strict=True)])
                again = np.flatnonzero(often[which])
                known.append((b"".join(keys[i] for i in again.tolist()), places[again], places[again] + size[which[again]].astype(np.int32)))
        self.held, self.bytes = {}, 0
        if known:
            keys, first, end = b"".join(x[0] for x in known), *(np.concatenate([x[k] for x in known]) for k in (1, 2))
            for s in range(0, len(first), SEND_PLACES):
                e = s + SEND_PLACES
                rows.append((self.n + zlib.crc32(keys[16 * s : 16 * e]) % self.n, None, keys[16 * s : 16 * e], self._array(first[s:e]), self._array(end[s:e])))
        kinds = (pa.int64(), *[pa.binary()] * 4)
        for s in range(0, len(rows), SEND_ROWS):
            cols = zip(*rows[s : s + SEND_ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "strings", "keys", "places", "twice"])

    def _packed(self, strings: list[bytes]) -> bytes:
        return self.zip.compress(b"\n".join(strings))

    def _array(self, x: np.ndarray) -> bytes:
        return self.zip.compress(np.ascontiguousarray(x, np.int32).tobytes())


def _word_ids(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of the strings, equal for equal words; and where each string starts."""
    data = np.frombuffer(b"\n".join(strings) + b"\n", np.uint8).copy()
    ends = np.flatnonzero((data == 32) | (data == 10))
    line = np.flatnonzero(data[ends] == 10)
    data[ends] = 32
    offsets = np.concatenate([[0], ends + 1])
    array = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return np.asarray(array.dictionary_encode().indices), np.concatenate([[0], line[:-1] + 1])


def repeated(strings: list[bytes], times: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first word, end) of the spans covered by windows that occur twice or more in all strings, each of which
    stands for ``times`` places."""
    ids, starts = _word_ids(strings)
    n = len(ids)
    string = np.repeat(np.arange(len(strings)), np.diff(np.append(starts, n)))
    h, done = _mixed(ids.astype(np.uint64) + np.uint64(1)), 1
    while done < width:
        step = min(done, width - done)
        h = _mixed(_mixed(h[:-step]) + h[step:] * np.uint64(3))
        done += step
    where = np.flatnonzero(string[: len(h)] == string[width - 1 :])
    dup = np.zeros(n, bool)
    passes = -(-n // PASS_WORDS)
    for k in range(passes):
        own = where if passes == 1 else where[(h[where] >> np.uint64(7)) % np.uint64(passes) == k]
        own = own[np.argsort(h[own], kind="stable")]
        if not len(own):
            continue
        head = np.concatenate([[True], h[own[1:]] != h[own[:-1]]])
        group = np.cumsum(head) - 1
        lead = own[head][group]
        odd = np.zeros(len(own), bool)
        other = np.flatnonzero(own != lead)
        for j in range(width):
            odd[other] |= ids[own[other] + j] != ids[lead[other] + j]
        total = np.bincount(group, times[string[own]])
        found = total[group] >= 2
        if odd.any():  # windows that differ in spite of equal hashes: count these groups word by word
            mixed = np.zeros(len(total), bool)
            mixed[group[odd]] = True
            again = own[mixed[group]]
            seen: dict[bytes, int] = {}
            for i in again.tolist():
                w = ids[i : i + width].tobytes()
                seen[w] = seen.get(w, 0) + int(times[string[i]])
            found[mixed[group]] = [seen[ids[i : i + width].tobytes()] >= 2 for i in again.tolist()]
        dup[own[found]] = True
    if not dup.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(dup)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    on = np.cumsum(cover[:-1]) > 0
    first = np.flatnonzero(on & np.concatenate([[True], ~on[:-1] | (string[1:] != string[:-1])]))
    end = np.flatnonzero(on & np.concatenate([~on[1:] | (string[1:] != string[:-1]), [True]])) + 1
    return string[first], first - starts[string[first]], end - starts[string[first]]


def _spans(keys: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())
    out = pa.RecordBatch.from_arrays([key, *(pa.array(x.astype(np.int32)) for x in (first, end))], ["key", "first", "end"])
    for s in range(0, len(keys), SEND_PLACES):
        yield out.slice(s, SEND_PLACES)


def _count(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    worker_state("substring")
    unzip = zstandard.ZstdDecompressor().decompress
    array = lambda x: np.frombuffer(unzip(x), np.int32)
    for t in runs(batches, ["bucket"]):
        if t.column("bucket")[0].as_py() >= buckets:  # places known at once
            for row in t.select(["keys", "places", "twice"]).to_pylist():
                yield from _spans(np.frombuffer(row["keys"], "V16"), array(row["places"]), array(row["twice"]))
            continue
        strings: dict[bytes, int] = {}
        which, keys, places, twice = [], [], [], []
        for row in t.select(["strings", "keys", "places", "twice"]).to_pylist():
            lines = lambda x: raw.split(b"\n") if (raw := unzip(x)) else []
            which.append(np.array([strings.setdefault(s, len(strings)) for s in lines(row["strings"])], np.int64))
            twice += [strings.setdefault(s, len(strings)) for s in lines(row["twice"])]
            keys.append(np.frombuffer(row["keys"], "V16"))
            places.append(array(row["places"]))
        which, keys, places = np.concatenate(which), np.concatenate(keys), np.concatenate(places)
        if not len(which):
            continue  # all places are known
        times = np.bincount(which, minlength=len(strings)) + 2 * np.bincount(np.array(twice, np.int64), minlength=len(strings))
        string, first, end = repeated(list(strings), times, width)
        order = np.argsort(which, kind="stable")
        lo, hi = np.searchsorted(which[order], string), np.searchsorted(which[order], string, "right")
        n = hi - lo
        if n.sum():
            row = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield from _spans(keys[row], places[row] + np.repeat(first, n), places[row] + np.repeat(end, n))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, spans): for each :func:`row_key`, as 16 bytes, the word spans covered by repeated windows."""
    spark = docs.sparkSession
    prepare(spark)
    parts = max(partitions(spark), -(-text_bytes(docs, text_col) // PARTITION_BYTES))
    buckets = parts * BUCKETS_PER_PARTITION

    texts = docs.select(F.unhex(row_key(id_col, text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that go to each bucket."""
        worker_state("substring")
        words = np.zeros(buckets, np.int64)
        for b in pieces(batches, "text", 4 << 20):
            w = Windows(b.column("text").to_pylist(), width)
            route = (w.minimiser % np.uint64(buckets)).astype(np.int64)
            s, n = w.starts(route)
            np.add.at(words, route[s], n + width - 1)
        used = np.flatnonzero(words)
        for s in range(0, len(used), SEND_PLACES):
            part = used[s : s + SEND_PLACES]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part])], ["bucket", "words"])

    weights = texts.select("text").mapInArrow(tidied(weigh), "bucket long, words long").groupBy("bucket").agg(F.sum("words").alias("words"))
    weights = materialize(weights, "bucket-words")
    most = max(HEAVY_WORDS, HEAVY_TIMES * (weights.agg(F.sum("words")).first()[0] or 0) // buckets)
    # less than one in HEAVY_TIMES buckets
    route = Router(buckets, {r["bucket"]: -(-r["words"] // most) * HEAVY_TIMES for r in weights.where(F.col("words") > most).collect()})
    held, total = spark.sparkContext.broadcast(route), route.total

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring")
        packer = Packer(total)
        for b in pieces(batches, "text", 4 << 20):
            windows = Windows(b.column("text").to_pylist(), width)
            packer.add(b.column("key").to_pylist(), windows.super_kmers(held.value(windows)))
            if packer.bytes >= FLUSH_BYTES:
                yield from packer.flush()
        if packer.held:
            yield from packer.flush()

    packed = texts.mapInArrow(tidied(pack), "bucket long, strings binary, keys binary, places binary, twice binary")
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(tidied(lambda it: _count(it, width, total)), "key binary, first int, end int")
    return found.groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def cut(text: bytes, found: list[dict], normal: bool) -> tuple[bytes, int, int]:
    """The text without the words of the spans; words in all, and removed.  ``normal``: one blank between words, else the
    blanks that followed the kept words stay."""
    words = text.split()
    keep = np.ones(len(words), bool)
    for s in found:
        keep[s["first"] : s["end"]] = False
    gone = len(words) - int(keep.sum())
    if normal:
        return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k), len(words), gone
    if not gone:
        return text, len(words), 0
    return b"".join(w for w, k in zip(_WORD.findall(text), keep.tolist(), strict=True) if k), len(words), gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, normal: bool = False) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text_col``, and ``n_words``, ``n_removed`` (long)."""
    found = spans(docs, id_col, text_col, width)
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    names = [f"__c{i}" for i in range(len(kept))]

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring")
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out = pa.array([None if t is None else z.compress(t) for t in b.column("__text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), b.column("__key"), out], [*names, "__key", "__text"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring")
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = [
                (None, 0, 0) if t is None else cut(unzip(t), s or [], normal)
                for t, s in zip(b.column("__text").to_pylist(), b.column("spans").to_pylist(), strict=True)
            ]
            text = pa.array([r[0] for r in rows], pa.binary())
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), text, *counts], [*names, "__text", "__n_words", "__n_removed"])

    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, kept, strict=True)]
    small = docs.select(
        *(F.col(c).alias(n) for n, c in zip(names, kept, strict=True)), F.unhex(row_key(id_col, text_col)).alias("__key"), F.col(text_col).cast("binary").alias("__text")
    ).mapInArrow(tidied(zipped), T.StructType([*fields, T.StructField("__key", T.BinaryType()), T.StructField("__text", T.BinaryType())]))
    joined = small.join(found, small["__key"] == found["key"], "left").select(*names, "__text", "spans")
    schema = T.StructType([*fields, T.StructField("__text", T.BinaryType()), T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())])
    out = joined.mapInArrow(tidied(apply), schema)
    by = dict(zip(kept, names, strict=True))
    columns = [(F.col("__text").cast("string") if c == text_col else F.col(by[c])).alias(c) for c in docs.columns if c in by or c == text_col]
    return out.select(*columns, F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"))
