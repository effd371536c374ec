"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each task.

Encoding splits a text with the vocabulary's pattern, looks at each distinct match once, and contracts its leftmost pair
of minimum rank again and again: rows (word, position, token) join the merge table in a recursive query until nothing
joins.  Decoding joins ids with the vocabulary and concatenates with an ordered aggregation.  A task keeps the words it
has seen in a bounded table.  No shuffle; memory depends on the batch, not on the input.

A match longer than ``LONG_WORD`` bytes that is no token (a run of letters without blanks, say) would need that many recursion
steps, each of which leaves its rows behind: time and memory quadratic in its length.  It is merged by the same rule with a
heap, in ``n log n``.  Recursive queries hold so few words that what they leave behind is bounded.

Null text: encoded as an empty text (no ids, zero bytes).  Empty tables give empty results.  Repeated rows are encoded
each.  Bytes that are not UTF-8 are replaced by U+FFFD before encoding.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, prepare, worker_state

#: Longer matches are merged with a heap instead of a recursion step for each merge.
LONG_WORD = 256
#: Words in each of the two generations that a task remembers; new words in one recursive query, and rows that it may leave
#: behind (half the square of a word's bytes at most).
CACHE_WORDS, QUERY_WORDS, QUERY_ROWS = 500_000, 20_000, 2_000_000
#: Ids in one decoding query, about; a document stays whole.
DECODE_IDS = 500_000
#: Bytes of text that are encoded and decoded at a time where one worker does both, about; a document stays whole.
CHECK_BYTES = 1 << 20
#: A vocabulary file above this size is refused: it is sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20

#: Bits of a token id and of a position in a word.
TOKEN_BITS, PLACE_BITS = 20, 16
#: ``p`` packs the word, the position of the token's first byte (16 bits) and the token (20 bits), so that one sort puts
#: neighbours side by side.
ENCODE_SQL = """
WITH RECURSIVE bpe(step, p) AS (
  SELECT 0, (w * 65536 + pos) * 1048576 + tok FROM start_tokens
  UNION ALL
  SELECT * FROM (
    WITH next AS (
      SELECT step, p, lead(p) OVER (ORDER BY p) AS r FROM bpe
    ), pair AS (
      SELECT n.*, m.merged FROM next n
      LEFT JOIN merges m ON m.pair = (n.p & 1048575) * 1048576 + (n.r & 1048575) AND (n.r >> 36) = (n.p >> 36)
    ), best AS (
      SELECT p >> 36 AS w, min(merged * 65536 + ((p >> 20) & 65535)) AS least, arg_min(r, merged * 65536 + ((p >> 20) & 65535)) AS gone
      FROM pair WHERE merged IS NOT NULL GROUP BY p >> 36
    )
    SELECT p.step + 1, CASE WHEN ((p.p >> 20) & 65535) = (b.least & 65535) THEN (p.p - (p.p & 1048575)) + (b.least >> 16) ELSE p.p END
    FROM pair p JOIN best b ON (p.p >> 36) = b.w WHERE p.p <> b.gone
  )
), last AS (
  SELECT p >> 36 AS w, max(step) AS step FROM bpe GROUP BY p >> 36
)
SELECT w, list(p & 1048575 ORDER BY p) AS ids
FROM bpe b JOIN last l ON b.step = l.step AND (b.p >> 36) = l.w GROUP BY w ORDER BY w
"""

DECODE_SQL = """
SELECT d, string_agg(v.hex, '' ORDER BY i) AS hex
FROM ids JOIN vocabulary v ON v.id = ids.id GROUP BY d ORDER BY d
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges as the recursive query, in n log n for one long word."""
    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = nxt[i]
        return None if j >= n or (r := ranks.get(word[i : end[j]])) is None else (r, i, end[j])

    heap = [p for i in range(n - 1) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e or end[i] == e:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = 0, e, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for k in (i, prv[i]):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """The tables of one vocabulary in a DuckDB connection of this task's process."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(vocabulary)
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self.tables: set[str] = set()
        #: int32 ids of the words seen
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if max(self.ranks.values()) >= 1 << TOKEN_BITS:
            raise ValueError(f"token ids of more than {TOKEN_BITS} bits")

    def _table(self, name: str) -> None:
        """Make a table when it is first needed: a worker may only encode, or only decode."""
        if name in self.tables:
            return
        self.tables.add(name)
        if name == "merges":
            found = [
                (a, b, r)
                for tok, r in self.ranks.items()
                for i in range(1, len(tok))
                if (a := self.ranks.get(tok[:i])) is not None and (b := self.ranks.get(tok[i:])) is not None
            ]
            l, r, m = (pa.array(x, pa.int64()) for x in zip(*found, strict=True)) if found else [pa.array([], pa.int64())] * 3
            rows = pa.table({"pair": pc.add(pc.multiply(l, 1 << TOKEN_BITS), r), "merged": m})
        else:
            rows = pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks]})
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS FROM rows")
        self.db.unregister("rows")

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before, a bounded number in each recursive query."""
        self._table("merges")
        raw = []
        for w in words:
            b = w.encode("utf-8", "replace")
            if (r := self.ranks.get(b)) is not None:
                self.known[w] = array("i", [r]).tobytes()
            elif len(b) > LONG_WORD:
                self.known[w] = array("i", heap_merge(b, self.ranks)).tobytes()
            else:
                raw.append((w, b))
        raw.sort(key=lambda x: len(x[1]))  # words that need as many steps together
        for part in _parts(raw):
            size = np.array([len(b) for _, b in part])
            start_tokens = pa.table(
                {
                    "w": np.repeat(np.arange(len(part)), size),
                    "pos": np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size),
                    "tok": self.byte[np.frombuffer(b"".join(b for _, b in part), np.uint8)],
                }
            )
            self.db.register("start_tokens", start_tokens)
            ids = self.db.sql(ENCODE_SQL).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("start_tokens")
            cuts = (np.asarray(ids.offsets) * 4).tolist()
            flat = np.asarray(ids.values).astype(np.int32).tobytes()
            self.known.update((w, flat[s:e]) for (w, _), s, e in zip(part, cuts, cuts[1:], strict=False))

    def encode(self, texts: list[bytes | None], cache_words: int = CACHE_WORDS) -> list[bytes]:
        """The int32 ids of each text."""
        docs = [self.split((t or b"").decode("utf-8", "replace")) for t in texts]
        words = set(chain.from_iterable(docs))
        if len(self.known) > cache_words:
            self.known, self.older = {}, self.known
        new = [w for w in words if w not in self.known]
        if self.older:
            self.known.update((w, ids) for w in new if (ids := self.older.get(w)) is not None)
            new = [w for w in new if w not in self.known]
        self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, d)) for d in docs]

    def decode(self, ids: pa.Array) -> list[bytes]:
        """Bytes of each list of ids; null and empty lists give none."""
        self._table("vocabulary")
        size = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        flat = pc.list_flatten(ids)
        table = pa.table(
            {"d": np.repeat(np.arange(len(ids)), size), "i": np.arange(len(flat)), "id": flat.cast(pa.int64())}
        )
        self.db.register("ids", table)
        found = self.db.sql(DECODE_SQL).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(ids)
        for d, h in zip(found.column("d").to_pylist(), found.column("hex").to_pylist(), strict=True):
            out[d] = bytes.fromhex(h)
        return out


def _parts(words: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    """Words for one recursive query each."""
    held, rows = [], 0
    for x in words:
        n = len(x[1]) ** 2 // 2
        if held and (len(held) >= QUERY_WORDS or rows + n > QUERY_ROWS):
            yield held
            held, rows = [], 0
        held.append(x)
        rows += n
    if held:
        yield held


def _codec(vocabulary: bytes, pattern: str) -> Codec:
    return worker_state(("bpe", hash(vocabulary), pattern), lambda: Codec(vocabulary, pattern))


def _vocabulary(spark, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``out_col`` array<int>: the ids of each whole text, without special tokens.

    ``cache_words``: words in each generation that a task remembers; fewer take less memory and more time."""
    prepare(docs.sparkSession)
    held = _vocabulary(docs.sparkSession, vocabulary_path)
    kept = [c for c in docs.columns if c != out_col and (keep is None or c in keep)]
    raw = "__text_bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for b in pieces(batches, raw):
            ids = codec.encode(b.column(raw).to_pylist(), cache_words)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), np.int32)
            arrays = [b.column(c) for c in kept] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, out_col])

    schema = T.StructType([docs.schema[c] for c in kept]).add(out_col, T.ArrayType(T.IntegerType()))
    return docs.select(*kept, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", same_col: str = "round_trip", keep: list[str] | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """As :func:`encode`, with ``same_col`` boolean: whether the ids decode to the bytes of the text; both in one worker."""
    prepare(docs.sparkSession)
    held = _vocabulary(docs.sparkSession, vocabulary_path)
    kept = [c for c in docs.columns if c not in (out_col, same_col) and (keep is None or c in keep)]
    raw = "__text_bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for b in pieces(batches, raw, CHECK_BYTES):
            texts = [t or b"" for t in b.column(raw).to_pylist()]
            ids = codec.encode(texts, cache_words)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            same = [x == t for x, t in zip(codec.decode(lists), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists, pa.array(same, pa.bool_())], [*kept, out_col, same_col])

    schema = T.StructType([docs.schema[c] for c in kept]).add(out_col, T.ArrayType(T.IntegerType())).add(same_col, T.BooleanType())
    return docs.select(*kept, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """As :func:`decode` of :func:`encode`, both in one worker: the ids don't travel in between, and all workers of an executor
    remember words, where else some would be taken for decoding."""
    prepare(docs.sparkSession)
    held = _vocabulary(docs.sparkSession, vocabulary_path)
    kept = [c for c in docs.columns if c not in (ids_col, out_col) and (keep is None or c in keep)]
    raw = "__text_bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for b in pieces(batches, raw, CHECK_BYTES):
            ids = codec.encode(b.column(raw).to_pylist(), cache_words)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            decoded = pa.array(codec.decode(lists), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists, decoded], [*kept, ids_col, out_col])

    schema = T.StructType([docs.schema[c] for c in kept]).add(ids_col, T.ArrayType(T.IntegerType())).add(out_col, T.BinaryType())
    return docs.select(*kept, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col`` binary: the bytes that the ids stand for.  Ids outside the vocabulary give no bytes."""
    prepare(docs.sparkSession)
    held = _vocabulary(docs.sparkSession, vocabulary_path)
    kept = [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for b in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(b.column(ids_col)), 0)).astype(np.int64))
            s = 0
            while s < b.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + DECODE_IDS, "right")) - s)
                part, s = b.slice(s, n), s + n
                out = pa.array(codec.decode(part.column(ids_col)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [out], [*kept, out_col])

    schema = T.StructType([docs.schema[c] for c in kept]).add(out_col, T.BinaryType())
    return docs.select(*kept).mapInArrow(run, schema)
