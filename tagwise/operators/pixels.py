"""Optional: images as arrays, and tokens from them with a recognizer that the caller brings.

Arrays are rows x columns (x channels) of bytes.  PNG (8 bits, not interlaced) and binary PNM are decoded here; other formats
need a decoder of the caller's.  An image that can't be read has no tokens, as in a scan that goes on with its other images.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import reading
from ..functions import vocabulary as V
from ..shipping import ship
from ..sources import TOKEN

# Longest side, contrast limit and tiles, smoothing, threshold window and offset, weights of red, green, blue.
LONGEST, CONTRAST, TILES, WINDOW, OFFSET = 2000, 3.0, 8, 11, 2
GREY = (0.299, 0.587, 0.114)
ROTATIONS = (0, 90, 180, 270)
_SIGNAL = reading.re.compile(V.ROTATION_WORDS, reading.re.IGNORECASE)

#: Reads an array: (polygon, text, confidence) of each detection; the flag asks for faint text too.
Reader = Callable[[np.ndarray, bool], list]


# --- formats


def decode(content: bytes) -> np.ndarray:
    """The array of a PNG or binary PNM image; an error for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] in (b"P5", b"P6"):
        head = reading.re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", content)
        w, h = int(head[1]), int(head[2])
        shape = (h, w, 3) if content[:2] == b"P6" else (h, w)
        return np.frombuffer(content, np.uint8, int(np.prod(shape)), head.end()).reshape(shape)
    raise ValueError("not a PNG or PNM image")


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(content):
        size = int.from_bytes(content[at : at + 4], "big")
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        at += size + 12


def _png(content: bytes) -> np.ndarray:
    parts: dict[bytes, bytes] = {}
    for name, data in _chunks(content):
        parts[name] = parts.get(name, b"") + data
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or interlace or kind not in (0, 2, 3, 4, 6):
        raise ValueError("an unusual PNG image")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h, w * n), np.uint8)
    up = np.zeros(w * n, np.int64)
    for y in range(h):
        up = _unfiltered(int(raw[y, 0]), raw[y, 1:].astype(np.int64), up, n)
        out[y] = up
    out = out.reshape(h, w, n) if n > 1 else out
    return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[out] if kind == 3 else out


def _unfiltered(kind: int, row: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    """A row of a PNG image from its differences to the left and upper neighbours."""
    if kind in (0, 2):
        return (row + (up if kind else 0)) % 256
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0).reshape(-1) % 256
    out = [0] * n + row.tolist()
    above = [0] * n + up.tolist()
    for i in range(n, len(out)):
        a, b, c = out[i - n], above[i], above[i - n]
        guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
        out[i] = (out[i] + guess) % 256
    return np.array(out[n:], np.int64)


def orientation(content: bytes) -> int:
    """How a JPEG or PNG image says that it is turned: 1 (upright) to 8; 1 if it doesn't."""
    data = b""
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                data = content[at + 10 : at + 2 + size]
            at += size + 2
    elif content[:4] == b"\x89PNG":
        data = next((d for name, d in _chunks(content) if name == b"eXIf"), b"")
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return 1
    at = struct.unpack_from(order + "I", data, 4)[0]
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, _, _, value = struct.unpack_from(order + "HHIH", data, at + 2 + 12 * k)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def upright(a: np.ndarray, turned: int) -> np.ndarray:
    """An array as it is meant to be seen."""
    if turned in (2, 4, 5, 7):
        a = a[:, ::-1]
    return np.rot90(a, {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(turned, 0))


# --- arrays


def rotate(a: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees."""
    return np.rot90(a, -degrees // 90)


def _shares(n: int, to: int) -> np.ndarray:
    """Share of each of ``n`` pixels in each of ``to`` larger ones."""
    edges = np.arange(to + 1) * n / to
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(n)[None]
    return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) * to / n


def shrink(a: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Averages over areas, so that no side is longer; smaller arrays stay."""
    h, w = a.shape[:2]
    if max(h, w) <= longest:
        return a
    rows, columns = (_shares(n, max(1, int(n * longest / max(h, w)))) for n in (h, w))
    out = np.tensordot(rows, a.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(columns, out, (1, 1)), 0, 1)
    return np.round(out).astype(np.uint8)


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a[:, :, 0] if a.shape[2] < 3 else np.round(a[:, :, :3] @ np.array(GREY)).astype(np.uint8)


def _blurred(a: np.ndarray, kernel: np.ndarray, border: str) -> np.ndarray:
    r = len(kernel) // 2
    for axis in (0, 1):
        wide = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode=border)
        a = sum(k * np.take(wide, range(i, i + a.shape[axis]), axis) for i, k in enumerate(kernel))
    return a


def even_contrast(a: np.ndarray, limit: float = CONTRAST, tiles: int = TILES) -> np.ndarray:
    """Histograms evened tile by tile, none steeper than ``limit`` times the average, blended between tiles."""
    h, w = a.shape
    size = -(-h // tiles), -(-w // tiles)
    wide = np.pad(a, ((0, size[0] * tiles - h), (0, size[1] * tiles - w)), mode="symmetric" if min(h, w) >= tiles else "edge")
    area = size[0] * size[1]
    most = max(1, int(limit * area / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(wide[i * size[0] : (i + 1) * size[0], j * size[1] : (j + 1) * size[1]].ravel(), minlength=256)
            over = np.maximum(n - most, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(n, most) + over / 256) * 255 / area

    def between(n: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / step - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, dy), (x0, x1, dx) = between(h, size[0]), between(w, size[1])
    at = lambda y, x: maps[y[:, None], x[None], a]
    upper, lower = (at(y, x0) * (1 - dx) + at(y, x1) * dx for y in (y0, y1))
    return np.clip(np.round(upper * (1 - dy)[:, None] + lower * dy[:, None]), 0, 255)


def stamped(a: np.ndarray) -> np.ndarray:
    """White strokes on black from faint or dotted print: even contrast, smoothed, darker than its surroundings, gaps of a
    pixel closed."""
    smooth = np.round(_blurred(even_contrast(grey(a)), np.array([0.25, 0.5, 0.25]), "reflect" if min(a.shape[:2]) > 1 else "edge"))
    x = np.arange(WINDOW) - WINDOW // 2
    kernel = np.exp(-(x**2) / (2 * (0.3 * ((WINDOW - 1) * 0.5 - 1) + 0.8) ** 2))
    dark = smooth <= np.round(_blurred(smooth, kernel / kernel.sum(), "edge")) - OFFSET
    for step, join in ((1, np.logical_or), (-1, np.logical_and)):  # to the right and down, and back
        for axis in (0, 1):
            near = np.roll(dark, step, axis)
            edge = [slice(None)] * 2
            edge[axis] = 0 if step > 0 else -1
            near[tuple(edge)] = join is np.logical_and
            dark = join(dark, near)
    return np.where(dark, 255, 0).astype(np.uint8)


# --- tokens


def score(found: list) -> float:
    """Sure long texts count, one or two characters hardly, compliance words a lot; malformed detections don't."""
    total = 0.0
    for t in to_tokens(found):
        text = t["text"].strip()
        total += t["confidence"] * (0.1 if len(text) <= 2 else len(text)) + (100 if _SIGNAL.search(text) else 0)
    return total


def to_tokens(found: list) -> list[dict]:
    """Detections of three parts as tokens; malformed ones are skipped."""
    out = []
    for d in found:
        try:
            polygon, text, confidence = d
            out.append({"text": str(text), "bbox": [[float(v) for v in p] for p in polygon], "confidence": float(confidence), "language": "en"})
        except (TypeError, ValueError):
            continue
    return out


def read_image(content: bytes, reader: Reader, decoder: Callable[[bytes], np.ndarray] = decode) -> list[dict]:
    """Upright, small enough, in the rotation that reads best (the first of equally good ones), plainly and for faint print;
    the tokens of both passes.  A rotation that can't be read is left out; whatever else fails, there are no tokens."""
    try:
        a = upright(decoder(content), orientation(content))
        a = shrink(a[:, :, :3] if a.ndim == 3 and a.shape[2] == 4 else a)
        best, most = a, -1.0
        for degrees in ROTATIONS:
            try:
                turned = rotate(a, degrees)
                points = score(reader(turned, False))
            except Exception:  # noqa: BLE001  whatever a recognizer raises
                continue
            if points > most:
                best, most = turned, points
        return to_tokens(reader(best, False)) + to_tokens(reader(stamped(best), True))
    except Exception:  # noqa: BLE001
        return []


_readers: dict = {}


def recognise(images: DataFrame, make_reader: Callable[[], Reader], keys: list[str], content: str = "content", decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(keys, tokens) of images.  ``make_reader`` is called once in each worker, when it meets its first image."""
    ship(images.sparkSession)
    schema = T.StructType([images.schema[k] for k in keys]).add("tokens", T._parse_datatype_string(f"array<{TOKEN}>"))
    kind = to_arrow_type(schema["tokens"].dataType)
    own = f"{make_reader.__module__}.{make_reader.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if own not in _readers and b.num_rows:
                _readers[own] = make_reader()
            tokens = [[] if c is None else read_image(c, _readers[own], decoder) for c in b.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(tokens, kind)], [*keys, "tokens"])

    return images.select(*keys, content).mapInArrow(run, schema)
