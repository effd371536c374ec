"""Token counts under a unigram model, by dynamic programming over a shared trie.

A text is split into pre-tokens; the distinct new ones of a batch go into a byte trie.  Each trie node stands for a
prefix and gets, once, its best forward score and the number of tokens of that segmentation, so words that share a prefix
share the work.  Terminal nodes store the counts, which the texts then look up.

Scores: token of rank ``r`` has log-probability ``-log(r + RANK_OFFSET)`` (Zipf's law over the vocabulary's order; the
vocabulary is given, nothing is trained).  Of equally good segmentations the one with fewer tokens counts.  All 256 bytes
are tokens, so every text can be segmented.

Null text counts 0 tokens; empty tables give empty results; repeated rows are counted each.  No shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _vocabulary, read_ranks
from .common import pieces, prepare, worker_state

RANK_OFFSET = 2
#: Pre-tokens that a task remembers.
CACHE_WORDS = 400_000
#: Scores within this distance are equal.
TIE = 1e-9


class TrieCounter:
    """Forward scores of a unigram model over a trie of pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.score = {t: -math.log(r + RANK_OFFSET) for t, r in read_ranks(vocabulary).items()}
        self.longest = max(map(len, self.score))
        self.known: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Put the words into a new trie; a node's score is computed when it is made."""
        child: dict[tuple[int, int], int] = {}
        best, count = [0.0], [0]
        get, longest = self.score.get, self.longest
        for word in words:
            raw = word.encode("utf-8", "replace")
            path = [0]
            for i, byte in enumerate(raw, 1):
                node = child.get((path[-1], byte))
                if node is None:
                    top, n = -math.inf, 0
                    for start in range(max(0, i - longest), i):
                        if (s := get(raw[start:i])) is not None:
                            s += best[path[start]]
                            c = count[path[start]] + 1
                            if s > top + TIE or (s > top - TIE and c < n):
                                top, n = s, c
                    node = child[path[-1], byte] = len(best)
                    best.append(top)
                    count.append(n)
                path.append(node)
            self.known[word] = count[path[-1]]

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        docs = [self.split((t or b"").decode("utf-8", "replace")) for t in texts]
        words = set(chain.from_iterable(docs))
        if len(self.known) > CACHE_WORDS:
            self.known = {w: n for w in words if (n := self.known.get(w)) is not None}
        self.insert([w for w in words if w not in self.known])
        get = self.known.__getitem__
        return np.array([sum(map(get, d)) for d in docs], np.int64)


def count_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", out_col: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``out_col`` long: tokens of the best segmentation of each whole text."""
    prepare(docs.sparkSession)
    held = _vocabulary(docs.sparkSession, vocabulary_path)
    kept = [c for c in docs.columns if c != out_col and (keep is None or c in keep)]
    raw = "__text_bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(("token_counts", hash(held.value), pattern), lambda: TrieCounter(held.value, pattern))
        for b in pieces(batches, raw):
            n = pa.array(counter.count(b.column(raw).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [n], [*kept, out_col])

    schema = T.StructType([docs.schema[c] for c in kept]).add(out_col, T.LongType())
    return docs.select(*kept, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)
