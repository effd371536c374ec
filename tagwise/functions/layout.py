"""Tokens of one image: their joined text, who stands where, and the second pass over them.

A page of tokens has few of them (what fits on a package), so all of it happens in the row that holds the page.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from . import vocabulary as V

_ANCHORS = {field: re.compile("|".join(words)) for field, words in V.ANCHORS.items()}
_SWEEP = {field: re.compile(p, re.IGNORECASE | (re.DOTALL if field == "MANUFACTURER_ADDRESS" else 0)) for field, p in V.SWEEP.items()}
_DATES = ("DATE_STRICT", "DATE_MONTH_YEAR")
#: Patterns of a field's value, the first that matches counts.
_VALUE = {"MRP": ("MRP",), "MANUFACTURING_DATE": _DATES, "EXPIRY_DATE": _DATES, "NET_QUANTITY": ("NET_QUANTITY",)}
MAKER_LEAST = 10


def bounds(bbox: list | None) -> tuple[float, float, float, float] | None:
    """(xmin, ymin, xmax, ymax) of four corners, or of [x1, y1, x2, y2], bare or as the only point; else None."""
    if not bbox or any(p is None for p in bbox):
        return None
    if not isinstance(bbox[0], list):
        return tuple(bbox) if len(bbox) == 4 else None
    if len(bbox) == 1 and len(bbox[0]) == 4:
        return bounds(bbox[0])
    if len(bbox) != 4 or any(len(p) < 2 or p[0] is None or p[1] is None for p in bbox):
        return None
    x, y = [p[0] for p in bbox], [p[1] for p in bbox]
    return min(x), min(y), max(x), max(y)


def corners(box: tuple[float, float, float, float]) -> list[list[float]]:
    a, b, c, d = box
    return [[a, b], [c, b], [c, d], [a, d]]


@dataclass(slots=True)
class Token:
    text: str
    start: int
    polygon: list | None
    box: tuple[float, float, float, float] | None
    confidence: float | None
    language: str | None

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def mean_confidence(tokens: list[Token]) -> float | None:
    some = [t.confidence for t in tokens if t.confidence is not None]
    return sum(some) / len(some) if some else None


def main_language(tokens: list[Token]) -> str:
    """The most common language; the first seen wins ties; ``en`` if there is none."""
    seen = Counter(t.language for t in tokens if t.language)
    return seen.most_common(1)[0][0] if seen else "en"


class Page:
    """The tokens of an image that have a text, and their texts joined by blanks."""

    def __init__(self, tokens: list[dict | None]):
        self.tokens: list[Token] = []
        at = 0
        for t in tokens:
            if t is not None and t["text"] is not None:
                self.tokens.append(Token(t["text"], at, t["bbox"], bounds(t["bbox"]), t["confidence"], t["language"]))
                at += len(t["text"]) + 1
        self.text = " ".join([t.text for t in self.tokens])
        self.placed = [t for t in self.tokens if t.box]

    def supporting(self, start: int, end: int) -> list[Token]:
        """Tokens that overlap a half-open span of the joined text."""
        return [t for t in self.tokens if t.end > start and t.start < end]

    def boxes(self, start: int, end: int) -> list | None:
        return [corners(t.box) for t in self.supporting(start, end) if t.box] or None

    def anchored(self, field: str) -> dict | None:
        """Next to the first token that names the field and has a value near it: the nearest such value."""
        placed = self.placed
        for anchor in (t for t in placed if _ANCHORS[field].search(t.text.upper())):
            a = anchor.box
            near = [t for t in placed if t.box[0] >= a[0] - V.MAX_LEFT and t.box[0] <= a[2] + V.MAX_RIGHT and t.box[1] >= a[1] - V.MAX_UP and t.box[3] <= a[3] + V.MAX_DOWN]
            # a token that says the same in the same place is the anchor itself
            near = [t for t in near if (t.text, t.polygon, t.confidence, t.language) != (anchor.text, anchor.polygon, anchor.confidence, anchor.language)]
            for t in sorted(near, key=lambda t: math.dist(_centre(a), _centre(t.box))):
                for name in _VALUE[field]:
                    if m := _SWEEP[name].search(t.text):
                        return {"value": m[0].strip(), "evidence": f"Anchor [{anchor.text.upper()}] matched with [{t.text}]", "bbox": [corners(t.box)]}
        return None

    def swept(self, field: str) -> dict | None:
        """Anywhere in the joined text: the largest price, the first match of any other field."""
        if field == "MRP":
            priced = [(_number(m[1]), m) for m in _SWEEP["MRP"].finditer(self.text)]
            m = max(((v, m) for v, m in priced if v is not None), key=lambda x: x[0], default=(None, None))[1]
            return m and self._found(m, 1, m[0].strip())
        if field == "MANUFACTURER_ADDRESS":
            m = _SWEEP[field].search(self.text)
            value = m[1].strip() if m else ""
            return self._found(m, 1, value) if len(value) > MAKER_LEAST else None
        m = next((m for name in _VALUE.get(field, (field,)) if (m := _SWEEP[name].search(self.text))), None)
        return m and self._found(m, 0, m[0])

    def _found(self, m: re.Match, group: int, value: str) -> dict:
        return {"value": value, "evidence": m[0], "bbox": self.boxes(*m.span(group))}

    def second_pass(self) -> dict[str, dict]:
        """By field: beside an anchor, else (but for expiry dates) anywhere."""
        found = {field: hit for field in _VALUE if (hit := self.anchored(field))} if self.placed else {}
        return found | {field: hit for field in V.FIELDS if field not in found and (hit := self.swept(field))}


def _centre(box: tuple[float, float, float, float]) -> tuple[float, float]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def _number(digits: str) -> float | None:
    try:
        return float(digits.replace(",", ""))
    except ValueError:
        return None
