"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may occur in a text with up to ``k = m // EDIT_EVERY`` edits.  It is split into ``k + 1``
pieces; an occurrence must hold one of them unchanged, so exact piece hits (one Aho-Corasick pass over a text) are all that
has to be looked at.  Around each hit Myers' bit-parallel algorithm computes the least edit distance between the item and
any substring.  Texts and items are compared in lower case with single blanks.

The benchmark is taken in blocks of bounded size, each sent to all tasks and matched against every document.

Null texts match nothing; null or blank items are skipped.  Items of fewer than ``EDIT_EVERY`` characters match without
edits and as whole words only, so that an item of one letter isn't found in every text that has the letter.  Of several
places of equal distance the first that is found counts, which is the leftmost one of those without edits.  Repeated rows and
repeated items are reported each; ids may be null and of any type.  Empty tables give empty results.  No shuffle.

The driver streams the benchmark, a block at a time; a benchmark of several blocks takes a pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import pieces, prepare, worker_state

EDIT_EVERY = 14
#: Characters of the items in one block.
BLOCK_CHARS = 4 << 20


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def split_item(text: str, every: int = EDIT_EVERY) -> list[tuple[int, str]]:
    """``k + 1`` pieces (place, piece) of nearly equal length."""
    n = len(text) // every + 1
    cuts = [i * len(text) // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the pattern of ``m`` characters; the first end of least
    distance."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, at
    return best, end


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether neither side of a span cuts a word."""
    cut = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not cut(start) and not cut(end)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], every: int = EDIT_EVERY):
        import ahocorasick

        self.items = [(i, t, len(t) // every, pattern_masks(t)) for i, t in items]
        hits: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, _, _) in enumerate(self.items):
            for at, piece in split_item(t, every):
                hits.setdefault(piece, []).append((n, at))
        self.pieces = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.pieces.add_word(piece, (len(piece), where))
        self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item that occurs, at its best place."""
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (size, where) in self.pieces.iter(text):
            for n, at in where:
                _, item, k, masks = self.items[n]
                start = last + 1 - size - at
                if not k and not whole_words(text, start, start + len(item)):
                    continue
                if (n, start) in seen or (n in best and best[n][0] == 0):
                    continue
                seen.add((n, start))
                low = max(0, start - k)
                distance, end = myers(masks, len(item), text[low : start + len(item) + k])
                if distance <= k and (n not in best or distance < best[n][0]):
                    best[n] = distance, low + end
        return [(self.items[n][0], d, e) for n, (d, e) in best.items()]


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size, streamed through the driver one partition at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        if not (clean := normalise(text or "")):
            continue
        if held and size + len(clean) > limit:
            yield held
            held, size = [], 0
        held.append((item, clean))
        size += len(clean)
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EDIT_EVERY) -> DataFrame:
    """(id, item_id, distance, end): each item that occurs in each whole text."""
    spark = docs.sparkSession
    prepare(spark)
    item = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", item), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())])
    arrow = to_arrow_type(item)
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)  # at most BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            worker_state("decontaminate")
            matcher = Matcher(held.value, every)
            for b in pieces(batches, "text"):
                rows = [
                    (i, *m)
                    for i, t in enumerate(b.column("text").to_pylist())
                    if t
                    for m in matcher.find(normalise(t.decode("utf-8", "replace")))
                ]
                if rows:
                    at, items, d, e = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(at)), pa.array(items, arrow), pa.array(d, pa.int32()), pa.array(e, pa.int64())], [id_col, "item_id", "distance", "end"]
                    )

        part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
        out = out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", every: int = EDIT_EVERY) -> DataFrame:
    """The rows of ``docs`` in whose text no item occurs."""
    spark = docs.sparkSession
    prepare(spark)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    out = docs.select(*(F.col(c).alias(n) for n, c in zip(names, docs.columns, strict=True)))
    text = names[docs.columns.index(text_col)]
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            worker_state("decontaminate")
            matcher = Matcher(held.value, every)
            for b in pieces(batches, text):
                clean = [not t or not matcher.find(normalise(t)) for t in b.column(text).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
