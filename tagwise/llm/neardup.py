"""Near-duplicate classes with DartMinHash signatures, banded joining and exact verification.

A text is the multiset of its 5-word shingles: a shingle's weight is how often it occurs (``weights="binary"``: 1).
Signature: each shingle throws darts, the points of a Poisson process over weight and rank that only its hash determines; the
darts below its weight count, and each of ``K`` coordinates keeps the dart of least rank.  Work is proportional to the number
of shingles plus ``K log K``, whatever the weights.

Two coordinates agree with the weighted Jaccard similarity as probability; ``BANDS`` bands of ``ROWS`` coordinates find a
pair of similarity 0.8 but for a chance of 3 in a million.  Texts that share a band share that band's hub, its most
connected text.  First every text is compared with its hubs, in blocks of a few texts, each with a copy of the hub: linear in
the group.  What isn't linked to the hub then meets all texts of the group, in pairs of blocks of bounded size; pairs of texts
are never emitted.  Similarities are computed exactly.  Equal word sequences are one node throughout.  Classes are connected
components of links of ``threshold`` or more.

Texts with fewer than five words have one shingle, all their words.  Null texts and texts without words are classes of
their own.  Rows with equal id and text are copies; ties go to the smaller id.  Empty tables give empty results.  Other
columns, whatever their names, are not looked at; :func:`keep_one` keeps them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, drop_table, materialize, partitions, pieces, prepare, row_key, runs, tidied, trim, worker_state

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
K = BANDS * ROWS
#: Words of the texts that meet a copy of their hub, and at most of each block of texts that meet each other; such blocks are
#: as small as the former as long as there are no more than this many.
HUB_WORDS, BLOCK_WORDS, SMALL_BLOCKS = 1 << 14, 750_000, 16
MAX_ROUNDS = 60
#: Elements of a batch that throw one dart at a time.
MANY = 4096
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(n: int, by: np.uint64) -> np.uint64:
    """A product modulo 2^64."""
    return np.uint64(n * int(by) & 0xFFFFFFFFFFFFFFFF)


class _Words(dict):
    """64-bit hashes of words, computed once."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingles(words: list[bytes], known: _Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    g = h[: len(h) - n + 1]
    for k in range(1, n):
        g = _mixed(g + _MIX) ^ h[k : len(h) - n + 1 + k]
    return np.unique(_mixed(g), return_counts=True)


def expand(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A multiset as a set: the j-th occurrence of a shingle is an element of its own."""
    if not len(h) or times.max() == 1:
        return h
    j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    e = np.repeat(h, times)
    return np.sort(np.where(j > 0, _mixed(e + j.astype(np.uint64) * _MIX2), e))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def dart_minhash(elements: list[np.ndarray], weights: list[np.ndarray], k: int = K) -> np.ndarray:
    """Signatures (len(elements), k) of weighted sets: the id of the earliest dart of each coordinate.

    Weights are cut into strips [0, 1), [1, 2), [2, 4), ...; in each strip an element's darts arrive along the rank axis
    at the rate of the strip's width, with a uniform place in the strip.  A dart counts if its place is below the weight.
    """
    out = np.zeros((len(elements), k), np.uint64)
    left = np.array([i for i, e in enumerate(elements) if len(e)], np.int64)
    factor = np.log(k) + 2.0
    while len(left):
        e = np.concatenate([elements[i] for i in left])
        w = np.concatenate([weights[i] for i in left]).astype(np.float64)
        size = np.array([len(elements[i]) for i in left])
        doc = np.repeat(np.arange(len(left)), size)
        total = np.add.reduceat(w, np.cumsum(size) - size)
        limit = (k * factor / total)[doc]
        best = np.full(len(left) * k, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        strip, low, width = 0, 0.0, 1.0
        while (own := np.flatnonzero(w > low)).size:
            rank, arrival = np.zeros(len(own)), 0
            partly = w[own] < low + width  # the others' darts count wherever they fall in the strip
            seed = _mixed(e[own] + _times(strip, _MIX2))
            while own.size:
                # few elements: several arrivals at once, added up in the same order
                step = 1 if own.size > MANY else 32
                steps = np.arange(arrival + 1, arrival + step + 1, dtype=np.uint64) * _MIX
                d = _mixed(seed[:, None] + steps)
                ranks = np.cumsum(np.concatenate([rank[:, None], -np.log(_uniform(d)) / width], axis=1), axis=1)[:, 1:]
                near = ranks <= limit[own][:, None]
                i, j = np.nonzero(near)
                who, at, when = own[i], d[i, j], ranks[i, j]
                slot = doc[who] * k + (_mixed(at + _MIX) % np.uint64(k)).astype(np.int64)
                if partly.any():
                    hit = ~partly[i]
                    hit[~hit] = low + _uniform(_mixed(at[~hit] ^ _MIX2)) * width <= w[who[~hit]]
                    slot, at, when = slot[hit], at[hit], when[hit]
                np.minimum.at(best, slot, when)
                darts.append((slot, when, at))
                go = near[:, -1]
                own, rank, seed, partly, arrival = own[go], ranks[go, -1], seed[go], partly[go], arrival + step
            strip, low, width = strip + 1, low + width, max(1.0, low + width)
        sig = np.zeros(len(left) * k, np.uint64)
        for slot, rank, d in darts:
            first = rank == best[slot]
            sig[slot[first]] = d[first]
        full = np.isfinite(best.reshape(-1, k)).all(axis=1)
        out[left[full]] = sig.reshape(-1, k)[full]
        left, factor = left[~full], factor * 2  # a coordinate without a dart: look farther along the rank axis
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature; the band's number is part of it."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    h = np.tile(np.arange(k // rows, dtype=np.uint64), (n, 1))
    for j in range(rows):
        h = _mixed(h + _MIX) ^ parts[:, :, j]
    return _mixed(h).view(np.int64)


def _node(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, weights: str) -> DataFrame:
    """(id, key, node, n, bands) of each row; node, the digest of the word sequence, and bands are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("neardup")
        known = _Words()
        for b in pieces(batches, "text", 2 << 20):
            if len(known) > 300_000:
                known = _Words()
            words = [(t or b"").split() for t in b.column("text").to_pylist()]
            sets = [shingles(w, known) for w in words]
            sig = dart_minhash([s[0] for s in sets], [s[1] if weights == "count" else np.ones(len(s[0])) for s in sets])
            full = np.array([bool(w) for w in words])
            lists = [x if f else None for x, f in zip(bands(sig), full.tolist(), strict=True)]
            nodes = pa.array([_node(w) if w else None for w in words], pa.binary())
            counts = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("key"), nodes, counts, pa.array(lists, pa.list_(pa.int64()))], ["id", "key", "node", "n", "bands"]
            )
            trim()

    rows = docs.select(F.col(id_col).alias("id"), F.unhex(row_key(id_col, text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidied(run), f"id {kind}, key binary, node binary, n long, bands array<long>")


def linked(sets: list[np.ndarray], threshold: float, asking: list[int]) -> list[int]:
    """For each set the first set of its connected component, by the links of the sets ``asking`` to all.  Exact; a set that
    is already linked to the first one need not ask."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), size)[np.argsort(inverse, kind="stable")]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
    at = np.cumsum(size) - size
    for i in asking:
        ids = inverse[at[i] : at[i] + size[i]]
        n = ptr[ids + 1] - ptr[ids]
        place = np.repeat(ptr[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(member[place], minlength=len(sets))
        near = np.flatnonzero(common >= threshold * (size[i] + size - common) - 1e-9)
        for j in near.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], weights: str) -> Iterator[tuple[bytes, list[bytes], list[np.ndarray], dict[bytes, bool]]]:
    """(hub, nodes, their sets, which of them ask) of each group."""
    worker_state("neardup")
    known = _Words()
    for t in runs(batches, key):
        rows = dict(zip(t.column("node").to_pylist(), t.column("text").to_pylist(), strict=True))
        asking: dict[bytes, bool] = {}
        for node, asks in zip(t.column("node").to_pylist(), t.column("asks").to_pylist(), strict=True):
            asking[node] = asking.get(node, False) or asks
        if len(known) > 300_000:
            known = _Words()
        hub = t.column("hub")[0].as_py()
        nodes = sorted(rows, key=lambda x: (x != hub, x))
        found = [shingles(rows[x].split(), known) for x in nodes]
        yield hub, nodes, [expand(*s) if weights == "count" else s[0] for s in found], asking


def _to_hub(batches: Iterator[pa.RecordBatch], threshold: float, weights: str) -> Iterator[pa.RecordBatch]:
    """(hub, node, linked) of all members of a block."""
    for hub, nodes, sets, _ in _groups(batches, ["hub", "i"], weights):
        if nodes[0] == hub and len(nodes) > 1:
            root = linked(sets, threshold, [0])
            columns = [hub] * (len(nodes) - 1), nodes[1:], [r == 0 for r in root[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["hub", "node", "linked"])


def _to_all(batches: Iterator[pa.RecordBatch], threshold: float, weights: str) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the asking nodes of two blocks with whatever they are linked to there."""
    for _, nodes, sets, asking in _groups(batches, ["hub", "i", "j"], weights):
        root = linked(sets, threshold, [i for i, x in enumerate(nodes) if asking[x]])
        ends = [(nodes[i], nodes[r]) for i, r in enumerate(root) if i != r]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*ends, strict=True)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): alternating large-star and small-star over edges (a, b) until nothing changes; roots are least."""
    ordered = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialize(ordered(edges), "edges"), None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ordered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        before, now = now, materialize(ordered(small), "edges")
        drop_table(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def _blocks(members: DataFrame, words: int, name: str, small: int | None = None) -> DataFrame:
    """(hub, ``name``): into how many blocks the members of each hub are cut."""
    n = F.greatest(F.lit(1), F.ceil(F.sum("n") / words))
    if small:
        n = F.greatest(n, F.least(F.lit(SMALL_BLOCKS), F.ceil(F.sum("n") / small)))
    return members.groupBy("hub").agg(n.cast("int").alias(name))


def _links(met: DataFrame, texts: DataFrame, threshold: float, weights: str) -> DataFrame:
    """Links (a, b) whose connected components are those of all links within the groups ``met`` (hub, node, n)."""
    parts = partitions(met.sparkSession)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    is_hub = F.col("hub") == F.col("node")
    # hubs of several blocks are few: written, their size is known, and the members need not move by hub
    large = materialize(_blocks(met, HUB_WORDS, "blocks").where("blocks > 1"), "dart-large-hubs")
    numbered = met.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = numbered.withColumn("i", F.explode(F.when(is_hub, every("blocks")).otherwise(F.array(block("blocks")))))
    groups = dealt.select("hub", "i", "node", is_hub.alias("asks")).join(texts, "node").repartition(parts, "hub", "i").sortWithinPartitions("hub", "i")
    near = materialize(groups.mapInArrow(tidied(lambda it: _to_hub(it, threshold, weights)), "hub binary, node binary, linked boolean"), "dart-near-hub")
    # what isn't linked to its hub asks all members of the group
    asking = met.join(near.where("NOT linked").select("hub", "node"), ["hub", "node"])
    cuts = materialize(_blocks(asking, BLOCK_WORDS, "rows", HUB_WORDS).join(_blocks(met, BLOCK_WORDS, "columns", HUB_WORDS), "hub"), "dart-cuts")
    asks = asking.join(cuts, "hub").select("hub", "node", block("rows").alias("i"), F.explode(every("columns")).alias("j"), F.lit(True).alias("asks"))
    answers = met.join(cuts, "hub").select("hub", "node", F.explode(every("rows")).alias("i"), block("columns").alias("j"), F.lit(False).alias("asks"))
    pairs = asks.unionByName(answers).join(texts, "node").repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    rest = pairs.mapInArrow(tidied(lambda it: _to_all(it, threshold, weights)), "a binary, b binary")
    return near.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")).union(rest)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weights: str = "count") -> DataFrame:
    """(id, key, class_id, representative): for each row the least id of its class and the key of the row that stays."""
    prepare(docs.sparkSession)
    rows = materialize(signatures(docs, id_col, text_col, weights), "dart-signatures")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.min("key").alias("key"))
    nodes = materialize(nodes, "dart-nodes")
    # bands that at least two different texts share
    each = nodes.select("node", F.explode("bands").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    held = materialize(each.join(shared, "h"), "dart-bands")
    # the hub of a band: its text with the most band-mates
    mates = held.groupBy("node").agg(F.sum(F.col("c") - 1).alias("mates"))
    ranked = held.join(mates, "node")
    hubs = ranked.groupBy("h").agg(F.max(F.struct("mates", "node")).alias("m")).select("h", F.col("m.node").alias("hub"))
    met = materialize(ranked.join(hubs, "h").select("hub", "node").distinct().join(nodes.select("node", "n"), "node"), "dart-met")
    texts = docs.select(F.unhex(row_key(id_col, text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    if rows.groupBy("key").count().where("count > 1").head(1):  # equal rows: one of them before the texts move
        texts = texts.dropDuplicates(["key"])
    # merged at every size, so that a small input shows what a large one takes
    wanted = materialize(nodes.select("node", "key").join(met.select("node").distinct(), "node"), "dart-wanted")
    texts = materialize(wanted.hint("merge").join(texts, "key").select("node", "text"), "dart-texts")
    edges = _links(met, texts, threshold, weights)
    roots = components(edges)
    # least id of each class, node by node, so that copies are summed up before they move
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    first = rows.where("node IS NOT NULL").groupBy("node").agg(least.alias("least"))
    tied = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = tied.groupBy("root").agg(F.min("least").alias("of"))
    of_node = tied.select("node", "root").join(of_root, "root").select("node", F.col("of.id").alias("class_id"), F.col("of.key").alias("representative"))
    return rows.select("id", "key", "node").join(of_node, "node", "left").select(
        F.col("id").alias(id_col),
        "key",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("representative", "key").alias("representative"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their class: one of each, that with the least id."""
    kept = classes(docs, id_col, text_col).where("key = representative").groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("__n"))
    kept = materialize(kept, "kept-keys").hint("merge")
    rows, back = aside(docs, id_col, text_col)
    keyed = rows.withColumn("__key", F.unhex(row_key(id_col, text_col)))
    once = keyed.join(kept.where("__n = 1"), "__key", "left_semi")
    if kept.where("__n > 1").head(1):  # equal rows
        once = once.unionByName(keyed.join(kept.where("__n > 1"), "__key", "left_semi").dropDuplicates(["__key"]))
    return once.select(*back)
