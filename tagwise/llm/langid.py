"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased; every run of characters that are not letters becomes one blank.  For each language an interpolated
Kneser-Ney model of order :data:`ORDER` is estimated from labelled rows.  All languages share sorted arrays of n-gram
hashes (one array per order); a column per language holds the logarithm of its interpolated probability, or of its
back-off weight where that language has not seen the n-gram.  A text gets the language of the lowest cross-entropy per
character.

Calibration: part of the labelled rows is left out of the counts.  A text is rejected if it has no letter, or if its
cross-entropy under the best language is above what left-out rows of that language reach, plus a margin for short texts.

Fit: the model is fitted on about ``max_rows`` labelled rows and ``max_bytes`` bytes of text per language at most, those of
the smallest hash of their id, whole texts only (none longer than ``max_bytes``); so what comes to the driver has a bound.
Every language that has a label is learned.  More than ``max_languages`` of them are an error, not a silent choice.  Every
row is scored, over its whole text.

Null text or no letters: ``und``, score 0, rejected.  Empty labelled set: every text is ``und``.  Repeated rows get equal
results.  Columns of the input that are named like one of the results are replaced by it in :func:`identify`, and kept in
:func:`drop_rejected`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, pieces, prepare, tidied, worker_state

ORDER = 4
#: Labelled rows and bytes of text per language that the model is fitted on, about; languages that a model may have.
MAX_ROWS, MAX_BYTES, MAX_LANGUAGES = 1_000, 8 << 20, 2_000
#: One in so many of these rows calibrates.
CALIBRATION = 5
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    """Lower case, words of letters only; empty if the text has no letter (``\\w`` alone takes ``½`` and ``²`` too)."""
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return clean if any(map(str.isalpha, clean)) else ""


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each led by ORDER - 1 blanks and closed by one, and where each starts."""
    pad = " " * (ORDER - 1)
    data = np.frombuffer("".join(pad + t + " " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + ORDER for t in texts], np.int64)
    return data, np.cumsum(size) - size


def hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n-gram that ends at each place; the first n - 1 places have none of their own."""
    h = np.full(len(data), n, np.uint64)
    for k in range(n - 1, -1, -1):
        part = np.zeros(len(data), np.uint64)
        part[k:] = data[: len(data) - k] if k else data
        h = (h ^ (part + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _at(data: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """:func:`hashes` of the n-grams that end at the given places only."""
    h = np.full(len(ends), n, np.uint64)
    for k in range(n - 1, -1, -1):
        part = np.where(ends >= k, data[np.maximum(ends - k, 0)], 0).astype(np.uint64)
        h = (h ^ (part + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Sorted hash arrays of orders 1 to ORDER; row i of ``logp[n]`` and ``logb[n]`` belongs to ``keys[n][i]``.

    ``logp``: log-probability of the n-gram's last character, backed off where a language hasn't seen the n-gram; ``logb``:
    log of the back-off weight of the n-gram as a context, 0 where unseen; ``floor``: by language, log-probability of a
    character that it hasn't seen, before back-off weights.
    """

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    logb: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Per text and language: mean negative log-probability of a character."""
        data, starts = code_points(texts)
        h = hashes(data, ORDER)
        at, hit = find(self.keys[-1], h)
        total = self.logp[-1][at]
        left = np.flatnonzero(~hit)  # few: n-grams that no language has seen back off
        weight = np.zeros((len(left), len(self.languages)), np.float32)
        for n in range(ORDER - 1, 0, -1):
            if not len(left):
                break
            # the context is the n-gram that ends one place before
            at, hit = find(self.keys[n - 1], _at(data, np.maximum(left - 1, 0), n))
            weight += np.where(hit[:, None], self.logb[n - 1][at], 0)
            at, hit = find(self.keys[n - 1], _at(data, left, n))
            total[left[hit]] = weight[hit] + self.logp[n - 1][at[hit]]
            left, weight = left[~hit], weight[~hit]
        total[left] = weight + self.floor
        for k in range(ORDER - 1):
            total[starts + k] = 0
        size = np.diff(np.append(starts, len(data))) - (ORDER - 1)
        return -np.add.reduceat(total, starts, axis=0, dtype=np.float64) / size[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        clean = [normalise(t) if t else "" for t in texts]
        full = [i for i, t in enumerate(clean) if t]
        out: list[tuple[str, float, float, bool]] = [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
        if not full or not self.languages:
            return out
        h = self.cross_entropies([clean[i] for i in full])
        for i, row in zip(full, h, strict=True):
            best = int(row.argmin())
            n = len(clean[i]) + 1
            share = 1 / np.exp(-np.minimum(700, (row - row[best]) * min(n, 50))).sum()
            out[i] = (self.languages[best], float(share), float(row[best]), bool(row[best] > self.limits[best] + 2.5 / np.sqrt(n)))
        return out


def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _discounts(c: np.ndarray) -> float:
    n1, n2 = (c == 1).sum(), (c == 2).sum()
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5


def estimate(counts: dict[str, list[dict]], alphabet: int) -> tuple[list[str], list, list, list, np.ndarray]:
    """Interpolated Kneser-Ney per language from ``counts[lang][n - 1] = (key, context key, suffix key, count)`` arrays.

    Orders below the highest use continuation counts: in how many different characters' wake an n-gram was seen.
    """
    languages = sorted(counts)
    # contexts that are no n-grams themselves, as they end before a text starts, have back-off weights too
    keys = [np.unique(np.concatenate([counts[x][n][0] for x in languages] + [counts[x][n + 1][1] for x in languages if n + 1 < ORDER])) for n in range(ORDER)]
    logp = [np.full((len(k), len(languages)), np.nan, np.float32) for k in keys]
    logb = [np.zeros((len(k), len(languages)), np.float32) for k in keys]
    even = -np.log(max(alphabet, 2) * 2.0)  # the letters of all languages, and as much for all others together
    floor = np.zeros(len(languages))
    for j, lang in enumerate(languages):
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for n in range(1, ORDER + 1):
            key, context, suffix, count = counts[lang][n - 1]
            if n < ORDER:  # continuation counts: (n + 1)-grams that end in this n-gram
                up = counts[lang][n]
                ends, times = np.unique(up[2], return_counts=True)
                at, hit = find(ends, key)
                c = np.where(hit, times[at], 1).astype(np.float64)
            else:
                c = count.astype(np.float64)
            d = _discounts(c)
            group, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            back = d * kinds / total
            if lower is None:
                base = np.full(len(key), np.exp(even))
                floor[j] = np.log(back[0]) + even
            else:
                at, hit = find(lower[0], suffix)
                base = np.where(hit, lower[1][at], np.exp(floor[j]))
            p = (c - d) / total[inverse] + back[inverse] * base
            order = np.argsort(key)
            lower = (key[order], p[order])
            logp[n - 1][np.searchsorted(keys[n - 1], key), j] = np.log(p)
            if n > 1:
                at, hit = find(keys[n - 2], group)
                logb[n - 2][at[hit], j] = np.log(back[hit])
    fill(counts, keys, logp, logb, floor)
    return languages, keys, logp, logb, floor


def fill(counts: dict[str, list], keys: list, logp: list, logb: list, floor: np.ndarray) -> None:
    """Back-off worked out once for every n-gram that some language has seen and another hasn't."""
    logp[0] = np.where(np.isnan(logp[0]), floor, logp[0]).astype(np.float32)
    for n in range(2, ORDER + 1):
        context, suffix = np.zeros(len(keys[n - 1]), np.uint64), np.zeros(len(keys[n - 1]), np.uint64)
        for tables in counts.values():
            key, c, x, _ = tables[n - 1]
            at = np.searchsorted(keys[n - 1], key)
            context[at], suffix[at] = c, x
        at, hit = find(keys[n - 2], context)
        back = np.where(hit[:, None], logb[n - 2][at], 0)
        lower = logp[n - 2][find(keys[n - 2], suffix)[0]]
        logp[n - 1] = np.where(np.isnan(logp[n - 1]), back + lower, logp[n - 1])


def ngrams(texts: list[str], n: int) -> tuple[np.ndarray, ...]:
    """Distinct n-grams of the texts: hash, hash of the context (all but the last), of the suffix (all but the first), count."""
    data, starts = code_points(texts)
    keep = np.ones(len(data), bool)
    for k in range(ORDER - 1):
        keep[starts + k] = False
    h, suffix = hashes(data, n), hashes(data, n - 1) if n > 1 else np.zeros(len(data), np.uint64)
    context = np.concatenate([[np.uint64(0)], hashes(data, n - 1)[:-1]]) if n > 1 else np.zeros(len(data), np.uint64)
    key, first, count = np.unique(h[keep], return_index=True, return_counts=True)
    return key, context[keep][first], suffix[keep][first], count


def fit(rows: list[tuple[str, str, bool]]) -> Model:
    """From (language, text, calibrates) rows; a language without letters in its rows isn't learned."""
    by: dict[str, tuple[list[str], list[str]]] = {}
    for lang, text, held in rows:
        if clean := normalise(text):
            by.setdefault(lang, ([], []))[held].append(clean)
    by = {k: (a or b, b) for k, (a, b) in by.items() if a or b}
    if not by:
        return Model([], [], [], [], np.zeros(0), np.zeros(0))
    alphabet = len({c for a, _ in by.values() for t in a for c in t})
    counts = {k: [ngrams(a, n) for n in range(1, ORDER + 1)] for k, (a, _) in by.items()}
    model = Model(*estimate(counts, alphabet), np.zeros(len(by)))
    limits = []
    for j, lang in enumerate(model.languages):
        held = [t for t in by[lang][1] if len(t) >= 200] or by[lang][1] or by[lang][0]
        h = model.cross_entropies(held)[:, j]
        limits.append(float(np.quantile(h, 0.995)) + 0.6)
    model.limits = np.array(limits)
    return model


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
    max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Fit on the labelled rows of ``docs`` that meet ``where``: about ``max_rows`` and ``max_bytes`` per language at most, by
    a hash of the id."""
    size = F.octet_length(F.col(text_col))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (size <= max_bytes))
    if where is not None:
        labelled = labelled.where(where)
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("h"), size.alias("bytes"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages, and the driver's memory with it")
    part = {r["lang"]: min(1.0, max_rows / r["n"], max_bytes / max(1, r["bytes"])) for r in sizes}
    top = F.create_map(*(F.lit(x) for lang, p in part.items() for x in (lang, min(2**64 - 1, int(p * 2**64)) - 2**63))) if part else F.create_map(F.lit(""), F.lit(0))
    rows = labelled.where(F.col("h") <= F.try_element_at(top, F.col("lang"))).select("lang", "text", (F.pmod("h", F.lit(CALIBRATION)) == 0).alias("held"))
    table = rows.toArrow()
    return fit(list(zip(*(table.column(c).to_pylist() for c in ("lang", "text", "held")), strict=True)))


RESULT = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType()))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``; no shuffle."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the rows that it was fitted on
    kept = [c for c in docs.columns if c not in dict(RESULT) and (keep is None or c in keep)]
    raw = "__text_bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("langid")
        for b in pieces(batches, raw, 2 << 20):
            got = held.value.predict([None if t is None else t.decode("utf-8", "replace") for t in b.column(raw).to_pylist()])
            cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + cols, [*kept, *dict(RESULT)])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in RESULT])
    return docs.select(*kept, F.col(text_col).cast("binary").alias(raw)).mapInArrow(tidied(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: every fourth by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents that a model fitted on their own labelled rows accepts, with all their columns."""
    model = train(docs)
    rows, back = aside(docs, "text")
    return identify(rows, model).where(~F.col("rejected")).select(*back)
