"""Document scores by masked pseudo-likelihood.

A network sees :data:`REACH` words on each side of a masked word and predicts it: embeddings by offset are added and
squashed, and a two-level softmax (class, then token of the class) gives its probability.  The sum of the logarithms over
all words of a text is its score.

Tokens are the most frequent words of the corpus and, for all other words, buckets by shape.  A word's probability is its
token's, times the word's share of its bucket's occurrences in the whole corpus; so the probabilities of all words sum to
one (each bucket keeps one occurrence for all words that the corpus lacks).  As context a word that is no token of its own
also has a hashed embedding.  The network's size is fixed; the word counts grow with the corpus, are kept as a written table
and reach the texts by joins, never by broadcast.

Training doesn't depend on how the input is partitioned.  Documents are dealt by a digest of id and text into cells of about
:data:`CELL_BYTES`, in each of which they are sorted by that digest; words are numbered once per cell.  In each of
:data:`ROUNDS` rounds every cell of that round trains, in numpy, from the weights of the round before, and the shuffle
averages weights and Adagrad sums over the cells, by words.  So one pass over all words is made, whatever the size.

Null texts and texts without words: 0 words, log-likelihood 0, mean null.  Repeated rows train and are scored each.  Empty
tables give empty results.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted_at_exit, materialize, new_path, partitions, pieces, prepare, row_key, text_bytes, tidied, worker_state

#: Words and shape buckets; together CLASSES * CLASSES.
FREQUENT, SHAPES, CLASSES = 896, 128, 32
SIZE = FREQUENT + SHAPES
PAD = SIZE
#: Hashed embeddings of the words that are no tokens.
SLOTS = 1 << 13
REACH, HIDDEN, BATCH, RATE, SEED = 2, 16, 2048, 0.2, 7
#: Softmax weights stay within this bound, so that exponentials can't overflow: HIDDEN * MOST + a bias is below 88.
MOST = 3.0
#: Words that are longer are never tokens of their own, so that the list of tokens is small.
TOKEN_BYTES = 256
#: Bytes of text in a cell, about; a longer document stays whole.
CELL_BYTES, ROUNDS = 8 << 20, 4
#: Bytes of text for each partition of the deal, about.
PARTITION_BYTES = 64 << 20
BLOCKS = 32
_KINDS = bytes(97 if chr(b).islower() or b > 127 else 65 if chr(b).isupper() else 57 if chr(b).isdigit() else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class _Shapes(dict):
    """Buckets by kinds of characters; there are few of them among short words, and only those are kept."""

    def __missing__(self, kinds: bytes) -> int:
        out = zlib.crc32(_RUNS.sub(rb"\1", kinds), min(len(kinds), 24) // 6) % SHAPES
        if len(kinds) < 16 and len(self) < 100_000:
            self[kinds] = out
        return out


_shapes = _Shapes()


def shape(word: bytes) -> int:
    """Bucket of a word: its runs of capitals, letters, digits and each other sign, and its rough length."""
    return _shapes[word.translate(_KINDS)]


def slot(word: bytes) -> int:
    return zlib.crc32(word, SEED) % SLOTS


# --- cells


def pack(texts: list[bytes | None]) -> dict[str, bytes]:
    """A cell: its distinct words with their counts, shapes and slots; the number of each running word; words per text."""
    docs = [(t or b"").split() for t in texts]
    coded = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode()
    words, at = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int32)
    arrays = {
        "n": np.bincount(at, minlength=len(words)).astype(np.int32),
        "shapes": np.fromiter(map(shape, words), np.uint8, len(words)),
        "slots": np.fromiter(map(slot, words), np.uint16, len(words)),
        "at": at,
        "sizes": np.array([len(d) for d in docs], np.int32),
    }
    zipped = zstandard.ZstdCompressor(level=1).compress
    return {"words": zipped(b"\n".join(words))} | {k: zipped(x.tobytes()) for k, x in arrays.items()}


CELL = ("words", "n", "shapes", "slots", "at", "sizes")
_TYPES = {"n": np.int32, "shapes": np.uint8, "slots": np.uint16, "at": np.int32, "sizes": np.int32}


def unpack(name: str, data: bytes):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if name == "words" and raw else [] if name == "words" else np.frombuffer(raw, _TYPES[name])


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written cells of ``docs``: (cell, part, id list, packed texts, round)."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    total = text_bytes(docs, text_col)
    cells = max(1, -(-total // CELL_BYTES))
    rounds = min(ROUNDS, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pseudo_likelihood")
        held: list[pa.RecordBatch] = []
        now, part, size = None, 0, 0

        def out() -> pa.RecordBatch:
            texts = [t for b in held for t in b.column("text").to_pylist()]
            ids = pa.concat_arrays([b.column("id") for b in held])
            packed = pack(texts)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([part], pa.int32()), lists, *(pa.array([packed[c]], pa.binary()) for c in CELL)], ["cell", "part", "id", *CELL])

        for b in pieces(batches, "text", CELL_BYTES // 4):
            cell = np.asarray(b.column("cell"))
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                here = int(cell[s])
                if held and (here != now or size > 2 * CELL_BYTES):
                    yield out()
                    part, held, size = (part + 1 if here == now else 0), [], 0
                now = here
                held.append(b.slice(s, e - s))
                size += held[-1].column("text").nbytes
        if held:
            yield out()

    key = F.unhex(row_key(id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).cast("binary").alias("text")).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    dealt = rows.repartition(max(partitions(spark), -(-total // PARTITION_BYTES)), "cell").sortWithinPartitions("cell", "key").select("cell", "id", "text")
    packed = dealt.mapInArrow(tidied(run), f"cell long, part int, id array<{kind}>, " + ", ".join(f"{c} binary" for c in CELL)).withColumn("round", (F.col("cell") % rounds).cast("int"))
    path = new_path(spark, "cells")
    packed.write.partitionBy("round").parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(packed.schema).parquet(path)


# --- words


@dataclass
class Words:
    """The frequent words, the occurrences of all tokens, and the written table (word, n, shape, cells) of all words."""

    frequent: list[bytes]
    counts: np.ndarray
    table: DataFrame

    def tokens(self, words: list[bytes], shapes: np.ndarray) -> np.ndarray:
        """The token of each distinct word."""
        known = {w: i for i, w in enumerate(self.frequent)}
        out = FREQUENT + shapes.astype(np.int16)
        own = np.fromiter((known.get(w, -1) for w in words), np.int16, len(words))
        return np.where(own >= 0, own, out)


def count_words(cells: DataFrame) -> Words:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pseudo_likelihood")
        for b in batches:
            for w, n, s in zip(*(b.column(c).to_pylist() for c in ("words", "n", "shapes")), strict=True):
                words, n, s = unpack("words", w), unpack("n", n), unpack("shapes", s)
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n.astype(np.int64)), pa.array(s.astype(np.int32))], ["word", "n", "shape"])

    each = cells.select("words", "n", "shapes").mapInArrow(tidied(run), "word binary, n long, shape int")
    table = materialize(each.groupBy("word").agg(F.sum("n").alias("n"), F.first("shape").alias("shape"), F.count("*").alias("cells")), "words")
    short = table.where(F.octet_length("word") <= TOKEN_BYTES)
    top = short.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    counts = np.zeros(SIZE)
    counts[: len(top)] = [r["n"] for r in top]
    for r in table.groupBy("shape").agg(F.sum("n").alias("n")).collect():  # SHAPES rows
        counts[FREQUENT + r["shape"]] = r["n"]
    for r in top:
        counts[FREQUENT + r["shape"]] -= r["n"]
    return Words([bytes(r["word"]) for r in top], counts, table)


# --- network


@dataclass
class Network:
    """Weights: ``inner`` by context token and offset, ``extra`` by slot, ``cls`` and ``own`` the softmax levels with their
    biases."""

    inner: np.ndarray
    cls: np.ndarray
    cls_bias: np.ndarray
    own: np.ndarray
    own_bias: np.ndarray
    extra: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Random embeddings; biases that give the tokens' overall frequencies."""
        rng = np.random.default_rng(SEED)
        p = (counts + 1.0).reshape(CLASSES, CLASSES)
        return cls(
            rng.normal(0, 0.1, (SIZE + 1, 2 * REACH, HIDDEN)).astype(np.float32),
            rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32),
            np.log(p.sum(1) / p.sum()).astype(np.float32),
            rng.normal(0, 0.1, (CLASSES, HIDDEN, CLASSES)).astype(np.float32),
            np.log(p / p.sum(1, keepdims=True)).astype(np.float32),
            np.zeros((SLOTS, HIDDEN), np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.inner, self.cls, self.cls_bias, self.own, self.own_bias, self.extra]

    def like(self, flat: np.ndarray) -> list[np.ndarray]:
        """``flat`` cut into the shapes of :meth:`arrays`."""
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return out

    def forward(self, token: np.ndarray, slots: np.ndarray, scored: bool = True):
        """Log-probability of each token between the first and last REACH ones (pads excepted), unless not ``scored``, and what
        the gradient needs.

        ``slots``: -1 for a token without."""
        n = len(token) - 2 * REACH
        near = self.inner[token]
        kept = np.flatnonzero(slots >= 0)
        also = np.zeros((len(token), HIDDEN), np.float32)  # the same at every offset
        also[kept] = self.extra[slots[kept]]
        h = near[:n, 0] + also[:n]
        for k, o in enumerate((*range(1, REACH), *range(REACH + 1, 2 * REACH + 1)), 1):
            h += near[o : o + n, k]
            h += also[o : o + n]
        target = token[REACH : REACH + n]
        c = (target // CLASSES).astype(np.int8)
        c[target == PAD] = CLASSES  # pads come last
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(CLASSES + 1))
        order = order[: cuts[-1]]
        h = np.tanh(h[order])
        pc = np.exp(h @ self.cls + self.cls_bias)
        pw = np.empty((len(order), CLASSES), np.float32)
        for k in range(CLASSES):
            s, e = cuts[k], cuts[k + 1]
            if e > s:
                np.matmul(h[s:e], self.own[k], out=pw[s:e])
                pw[s:e] += self.own_bias[k]
        np.exp(pw, out=pw)
        ones = np.ones(CLASSES, np.float32)
        sum_c, sum_w = pc @ ones, pw @ ones
        at, w, c = np.arange(len(order)), target[order] % CLASSES, c[order]
        logp = np.full(n, 0.0) if scored else None
        if scored:
            logp[order] = np.log(pc[at, c] / sum_c) + np.log(pw[at, w] / sum_w)
        return logp, (token, slots, kept, order, cuts, h, c, w, pc, pw, sum_c, sum_w)

    def backward(self, state) -> tuple[list[np.ndarray], tuple, tuple]:
        """Gradients of the mean log-probability's negative: of ``cls``, ``cls_bias``, ``own``, ``own_bias``; and (rows,
        gradient by row) of ``inner`` and of ``extra``."""
        token, slots, kept, order, cuts, h, c, w, pc, pw, sum_c, sum_w = state
        at, m = np.arange(len(order)), np.float32(max(1, len(order)))
        pc *= (1 / (sum_c * m))[:, None]
        pw *= (1 / (sum_w * m))[:, None]
        pc[at, c] -= 1 / m
        pw[at, w] -= 1 / m
        dh = pc @ self.cls.T
        ones = np.ones(len(order), np.float32)
        down, down_bias = np.zeros_like(self.own), np.zeros_like(self.own_bias)
        for k in range(CLASSES):
            s, e = cuts[k], cuts[k + 1]
            if e > s:
                g = pw[s:e]
                np.matmul(h[s:e].T, g, out=down[k])
                np.matmul(ones[s:e], g, out=down_bias[k])
                dh[s:e] += g @ self.own[k].T
        dh *= 1 - h * h
        n = len(token) - 2 * REACH
        centre = np.zeros((n, HIDDEN), np.float32)
        centre[order] = dh
        by_place = np.zeros((len(token), 2 * REACH, HIDDEN), np.float32)
        for k, o in enumerate((*range(REACH), *range(REACH + 1, 2 * REACH + 1))):
            by_place[o : o + n, k] = centre
        inner = grouped(token, by_place.reshape(len(token), -1))
        whole = by_place[:, 0].copy()
        for k in range(1, 2 * REACH):
            whole += by_place[:, k]
        extra = grouped(slots[kept], whole[kept])
        return [h.T @ pc, ones @ pc, down, down_bias], inner, extra


def grouped(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    if not len(ids):
        return np.zeros(0, np.int64), values[:0]
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    return sorted_ids[first].astype(np.int64), np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Adagrad over the batches of one cell, from given weights and sums of squares."""

    def __init__(self, net: Network, squares: np.ndarray):
        self.net = Network(*(a.copy() for a in net.arrays()))
        self.squares = [a.copy() for a in net.like(squares)]

    def train(self, token: np.ndarray, slots: np.ndarray) -> None:
        net = self.net
        for s in range(0, len(token) - 2 * REACH, BATCH):
            e = min(s + BATCH + 2 * REACH, len(token))
            dense, inner, extra = net.backward(net.forward(token[s:e], slots[s:e], False)[1])
            for a, q, g in zip(net.arrays()[1:5], self.squares[1:5], dense, strict=True):
                q += g * g
                a -= RATE * g / np.sqrt(q)
            for (rows, g), a, all_q in ((inner, net.inner, self.squares[0]), (extra, net.extra, self.squares[5])):
                g = g.reshape(len(rows), *a.shape[1:])
                q = all_q[rows] + g * g
                all_q[rows] = q
                a[rows] -= RATE * g / np.sqrt(q)
            for a in net.arrays()[1:5]:
                most = 4 * MOST if a is net.cls_bias or a is net.own_bias else MOST
                np.clip(a, -most, most, out=a)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.net.arrays(), *self.squares)]).astype(np.float64)


def stretch(at: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and slots of all texts of a cell with REACH pads before, between and after them; the places of words."""
    place = np.arange(len(at)) + REACH * (1 + np.repeat(np.arange(len(sizes)), sizes))
    n = len(at) + REACH * (len(sizes) + 1)
    token, own = np.full(n, PAD, np.int16), np.full(n, -1, np.int32)
    token[place] = tokens[at]
    own[place] = np.where(tokens < FREQUENT, -1, slots.astype(np.int32))[at]
    return token, own, place


# --- training and scoring


def train_cells(cells: DataFrame, words: Words) -> Network:
    spark = cells.sparkSession
    net = Network.start(words.counts)
    size = sum(a.size for a in net.arrays())
    squares = np.full(size, 1e-6, np.float32)
    frequent, counts = words.frequent, words.counts
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast((net, squares))  # a network of fixed size

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            worker_state("pseudo_likelihood")
            own = Words(frequent, counts, None)
            total, n = np.zeros(2 * size), 0
            for b in batches:
                for row in b.select(["words", "shapes", "slots", "at", "sizes"]).to_pylist():
                    x = {c: unpack(c, row[c]) for c in row}
                    if len(x["at"]):
                        trainer = Trainer(*held.value)
                        trainer.train(*stretch(x["at"], x["sizes"], own.tokens(x["words"], x["shapes"]), x["slots"])[:2])
                        total += trainer.flat() * len(x["at"])
                        n += len(x["at"])
            if n:
                parts = [p.tobytes() for p in np.array_split(total, BLOCKS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], ["block", "n", "weights"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for b in batches:
                for block, n, w in zip(*(b.column(c).to_pylist() for c in ("block", "n", "weights")), strict=True):
                    x = found.setdefault(block, [0, 0.0])
                    x[0] += n
                    x[1] = x[1] + np.frombuffer(w)
            for block, (n, x) in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], ["block", "weights"])

        each = cells.where(F.col("round") == k).select("words", "shapes", "slots", "at", "sizes").mapInArrow(tidied(run), "block int, n long, weights binary")
        rows = each.repartition(max(1, min(BLOCKS, partitions(spark))), "block").mapInArrow(mean, "block int, weights binary").collect()  # one network
        if rows:
            flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(rows, key=lambda r: r["block"])])
            net, squares = Network(*net.like(flat[:size])), flat[size:]
        held.unpersist()
    return net


def score_cells(cells: DataFrame, words: Words, net: Network, id_col: str, kind: str, foreign: bool) -> DataFrame:
    """``foreign``: the words were not counted in these cells."""
    spark = cells.sparkSession
    frequent, counts = words.frequent, words.counts
    held = spark.sparkContext.broadcast(net)  # of fixed size

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each cell that are no tokens."""
        worker_state("pseudo_likelihood")
        known = set(frequent)
        for b in batches:
            for row in b.to_pylist():
                found = [(i, w) for i, w in enumerate(unpack("words", row["words"])) if w not in known]
                if found:
                    i, w = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["cell"]] * len(i)), pa.array([row["part"]] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(w, pa.binary())], ["cell", "part", "i", "word"])

    named = cells.select("cell", "part", "words").mapInArrow(tidied(rare), "cell long, part int, i int, word binary")
    # a word of one cell only has been counted there
    shared = words.table if foreign else words.table.where("cells > 1")
    # a partition's words are few enough to be looked up; sorting both sides took longer
    met = named.join(shared.select("word", F.col("n").alias("c")).hint("shuffle_hash"), "word").groupBy("cell", "part").agg(F.collect_list("i").alias("i"), F.collect_list("c").alias("c"))
    joined = cells.select("cell", "part", "id", "words", "n", "shapes", "slots", "at", "sizes").join(met, ["cell", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pseudo_likelihood")
        own, net = Words(frequent, counts, None), held.value
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                x = {c: unpack(c, row.column(c)[0].as_py()) for c in ("words", "n", "shapes", "slots", "at", "sizes")}
                tokens = own.tokens(x["words"], x["shapes"])
                # words that the corpus lacks share one occurrence; frequent words are all of their token
                n = np.ones(len(tokens)) if foreign else x["n"].astype(float)
                if row.column("i").null_count == 0:
                    n[np.asarray(row.column("i").flatten())] = np.asarray(row.column("c").flatten())
                share = np.where(tokens < FREQUENT, 0.0, np.log(n / (counts[tokens] + 1)))
                token, slots, place = stretch(x["at"], x["sizes"], tokens, x["slots"])
                logp = np.zeros(len(token))
                for s in range(0, len(token) - 2 * REACH, 4 * BATCH):
                    e = min(s + 4 * BATCH + 2 * REACH, len(token))
                    logp[s + REACH : e - REACH] = net.forward(token[s:e], slots[s:e])[0]
                by_word = logp[place] + share[x["at"]]
                sizes = x["sizes"]
                total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), by_word, len(sizes))
                mean = pa.array(np.round(total / np.maximum(sizes, 1), 6), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([row.column("id").flatten(), pa.array(sizes.astype(np.int64)), pa.array(np.round(total, 4)), mean], [id_col, "n_words", "log_likelihood", "mean_log_likelihood"])

    return joined.mapInArrow(tidied(run), f"`{id_col}` {kind}, n_words long, log_likelihood double, mean_log_likelihood double")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Words, Network]:
    """Word counts and network from every text of ``docs``."""
    cells = deal(docs, id_col, text_col)
    words = count_words(cells)
    return words, train_cells(cells, words)


def score(docs: DataFrame, model: tuple[Words, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_likelihood) of each row."""
    return score_cells(deal(docs, id_col, text_col), *model, id_col, docs.schema[id_col].dataType.simpleString(), True)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`score` under the model of ``docs`` itself; the texts are dealt once."""
    cells = deal(docs, id_col, text_col)
    words = count_words(cells)
    return score_cells(cells, words, train_cells(cells, words), id_col, docs.schema[id_col].dataType.simpleString(), False)
