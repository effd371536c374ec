"""Reading declarations from label texts: what Spark's own functions can't do in time linear in the text.

Spark gives neither the offsets of regular expression matches nor Unicode classes by default, so that finding a label, the
window behind it and the values in it took quadratic time as column functions.  Here an Arrow batch of texts is read by
compiled patterns instead: one pass over a text's words finds all labels and bounding words of all fields (:class:`Marks`),
and each field's reader turns the windows behind its labels into candidates.  Nothing here knows about Spark;
:mod:`tagwise.operators.extract` wraps it in Arrow functions.

A candidate is a dict with the keys of :data:`CANDIDATE`; offsets are half-open and refer to the normalised text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

from . import vocabulary as V

VALUES = ("amount", "unit", "text", "date", "phone", "email")
CANDIDATE = ("field", *VALUES, "label_matched", "score", "start", "end", "reason_codes", "suppressed", "forced_low", "label_ord")


def _any(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE)


# --- normalisation

_REWRITES = [(re.compile(p, re.IGNORECASE), put) for p, put in V.REWRITES]
_CHARACTERS = str.maketrans(*V.CHARACTERS)


def normalise(text: str | None) -> str:
    """Blanks, spellings and digits made alike for matching."""
    t = text or ""
    for pattern, put in _REWRITES:
        t = pattern.sub(put, t)
    return t.translate(_CHARACTERS).strip()


def normalise_with_offsets(text: str | None) -> tuple[str, list[int]]:
    """As :func:`normalise`, and for each character the offset in ``text`` of what it came from (the start of what a
    rewrite replaced)."""
    t = text or ""
    at = list(range(len(t)))
    for pattern, put in _REWRITES:
        changed = [m for m in pattern.finditer(t) if m[0] != put]
        if changed:
            out, parts, last = [], [], 0
            for m in changed:
                s, e = m.span()
                out += at[last:s]
                out += [at[s]] * len(put)
                parts += (t[last:s], put)
                last = e
            t, at = "".join(parts) + t[last:], out + at[last:]
    t = t if t.isascii() else t.translate(_CHARACTERS)
    lead = len(t) - len(t.lstrip())
    t = t.strip()
    return t, at[lead : lead + len(t)]


def original_span(at: list[int], start: int, end: int, length: int) -> tuple[int, int]:
    """A span of the normalised text in the original one; at least one wide, empty for an empty text."""
    if not at:
        return 0, 0
    inside = lambda i: at[min(max(i, 0), len(at) - 1)]
    s = inside(start)
    return s, min(length, max(inside(end - 1) + 1, s + 1))


# --- labels

_WORD = re.compile(r"\w+")
#: What case-insensitive matching takes for other letters besides their capitals.
_ALIKE = str.maketrans({"\u0131": "i", "\u0130": "i", "\u017f": "s", "\u212a": "k"})

_GROUPS: dict[str, list[tuple[str, str]]] = {
    **V.LABELS,
    "EXPIRY_DATE": V.EXPIRY_LABELS,
    **{name: [(p, "") for p in patterns] for name, patterns in (("price words", V.MRP_NEGATIVE), ("food words", V.NET_QUANTITY_NEGATIVE), ("batch words", V.BATCH_NEGATIVE), ("query words", V.QUERY_BOUNDARIES))},
}


@dataclass(frozen=True, slots=True)
class Mark:
    """A label or bounding word in a text."""

    start: int
    end: int
    group: str
    order: int
    name: str


def _lead(pattern: str) -> str:
    """The one or two letters that a match starts with; empty if a match need not start a word."""
    m = re.match(r"\\b([A-Za-z]{1,2})", pattern)
    return m[1].lower() if m else ""


_BY_LEAD: dict[str, list[tuple[Callable, str, int, str]]] = {}
_ANYWHERE: list[tuple[re.Pattern, str, int, str]] = []
for _group, _patterns in _GROUPS.items():
    for _order, (_pattern, _name) in enumerate(_patterns):
        _compiled = re.compile(_pattern, re.IGNORECASE)
        if _lead(_pattern):
            _BY_LEAD.setdefault(_lead(_pattern), []).append((_compiled.match, _group, _order, _name))
        else:
            _ANYWHERE.append((_compiled, _group, _order, _name))


class _Leads(dict):
    """What may start with a word's first two characters; kept for those that are few."""

    def __missing__(self, first: str) -> tuple:
        two = first.translate(_ALIKE).lower()
        out = (*_BY_LEAD.get(two, ()), *(_BY_LEAD.get(two[0], ()) if len(two) > 1 else ()))
        if first.isascii():
            self[first] = out
        return out


_leads = _Leads()


class Marks:
    """All labels and bounding words of one text, from one pass over its words."""

    def __init__(self, text: str):
        self.by: dict[str, list[Mark]] = {}
        for w in _WORD.finditer(text):
            at = w.start()
            for match, group, order, name in _leads[w[0][:2]]:
                if m := match(text, at):
                    self.by.setdefault(group, []).append(Mark(at, m.end(), group, order, name))
        for pattern, group, order, name in _ANYWHERE:
            for m in pattern.finditer(text):
                self.by.setdefault(group, []).append(Mark(m.start(), m.end(), group, order, name))
        self.length = len(text)
        self.bounds: dict[str, list[int]] = {}

    def labels(self, field: str) -> list[Mark]:
        """In order of precedence, then of place."""
        found = self.by.get(field, ())
        return sorted(found, key=lambda m: (m.order, m.start)) if len(found) > 1 else found

    def window(self, label: Mark, width: int) -> slice:
        """What stands behind a label: ``width`` at most, ended by the first bounding word behind the label's start."""
        bounds = self.bounds.get(label.group)
        if bounds is None:
            bounds = self.bounds[label.group] = sorted(m.start for g in BOUNDED_BY[label.group] for m in self.by.get(g, ()))
        k = bisect_right(bounds, label.start)
        end = min(label.end + width, bounds[k] if k < len(bounds) else self.length, self.length)
        return slice(label.end, max(end, label.end))


_ALL = [*V.LABELS, "EXPIRY_DATE", "price words", "food words", "query words"]
BOUNDED_BY = {
    "MRP": ["MRP", "price words"],
    "NET_QUANTITY": ["NET_QUANTITY", "food words"],
    "MANUFACTURER_ADDRESS": _ALL,
    "CONSUMER_CARE": _ALL,
    "MANUFACTURING_DATE": ["MANUFACTURING_DATE", "EXPIRY_DATE", "MANUFACTURER_ADDRESS", "CONSUMER_CARE", "batch words", "price words", "food words"],
}


# --- values

_INTEGER = re.compile(V.INTEGER)
_CURRENCY, _BARE, _BROKEN = (re.compile(p, re.IGNORECASE) for p in (V.CURRENCY_AMOUNT, V.AMOUNT_ONLY, V.BROKEN_AMOUNT))
_QUANTITY = re.compile(V.QUANTITY_VALUE, re.IGNORECASE)
_PHONE, _EMAIL = re.compile(V.PHONE, re.IGNORECASE), re.compile(V.EMAIL, re.IGNORECASE)
_PRICE_WORDS, _FOOD_WORDS, _DATE_WORDS = _any(V.MRP_NEGATIVE), _any(V.NET_QUANTITY_NEGATIVE), _any(V.DATE_NEGATIVE)
_LETTER, _BLANKS = re.compile("[A-Za-z]"), re.compile(r"\s+")


def strict_number(raw: str, decimals: int | None = None) -> float | None:
    """A number whose digits are grouped by a known rule; else None, never a part of it."""
    whole, dot, rest = raw.partition(".")
    if not _INTEGER.fullmatch(whole) or (dot and not rest.isdecimal()) or (decimals is not None and len(rest) > decimals):
        return None
    return float(raw.replace(",", ""))


def near(distance: int) -> float:
    return max(0.0, round(0.2 - 0.02 * distance, 4))


_EMPTY = dict.fromkeys(CANDIDATE)


def _candidate(field: str, label: Mark, end: int, score: float, codes: list[str], suppressed: bool = False, forced_low: bool = False, **value) -> dict:
    return {
        **_EMPTY, **value, "field": field, "label_matched": label.name, "score": round(score, 4), "start": label.start, "end": end,
        "reason_codes": codes, "suppressed": suppressed, "forced_low": forced_low, "label_ord": label.order,
    }


def _refused(signed: bool, glued: bool, amount: float | None) -> list[str]:
    """Why an amount doesn't count, if it doesn't."""
    if signed:
        return ["NEGATIVE_OR_SIGNED_REJECTED"]
    if glued:
        return ["TRAILING_ALPHA_REJECTED"]
    return ["MALFORMED_NUMERIC_REJECTED"] if amount is None else []


def _price(raw: str) -> float | None:
    amount = strict_number(raw, 2)
    return amount if amount else None


def _judged(text: str, label: Mark, end: int, words: re.Pattern) -> list[str]:
    """A suppressing word between label and value."""
    return ["CONFLICT_SUPPRESSED"] if words.search(text[label.start : end]) else []


def read_prices(text: str, marks: Marks) -> Iterator[dict]:
    """Behind each label: amounts with a currency; if none, an amount at once; if nothing stands, a broken amount."""
    for label in marks.labels("MRP"):
        found = list(_with_currency(text, label, marks)) or list(_bare_amount(text, label, marks))
        yield from found
        if all(c["suppressed"] for c in found) and (m := _BROKEN.search(text[marks.window(label, V.RECOVERY_WINDOW)])):
            codes = ["MRP_LABEL_MATCH", "OCR_CURRENCY_RECOVERY", "BROKEN_CURRENCY_LAYOUT_RECOVERY"]
            yield _candidate("MRP", label, label.end + m.end(), V.LABEL_BASE + V.RECOVERY_BONUS, codes, forced_low=True, amount=float(f"{m[1]}.{m[2]}"))


def _with_currency(text: str, label: Mark, marks: Marks) -> Iterator[dict]:
    for m in _CURRENCY.finditer(text[marks.window(label, V.WINDOW)]):
        end, amount, damaged = label.end + m.end(), _price(m[4]), m[2] == "?"
        if refused := _refused(bool(m[1] or m[3]), bool(m[6]), amount):
            yield _candidate("MRP", label, end, 0.0, ["MRP_LABEL_MATCH", *refused], True, amount=amount)
            continue
        conflict = _judged(text, label, end, _PRICE_WORDS)
        score = V.LABEL_BASE + (V.RECOVERY_BONUS if damaged else V.CURRENCY_BONUS) + near(m.start())
        codes = ["MRP_LABEL_MATCH", "OCR_CURRENCY_RECOVERY" if damaged else "CURRENCY_MATCH", *conflict]
        yield _candidate("MRP", label, end, score, codes, bool(conflict), damaged, amount=amount)


def _bare_amount(text: str, label: Mark, marks: Marks) -> Iterator[dict]:
    if m := _BARE.match(text[marks.window(label, V.AMOUNT_ONLY_WINDOW)]):
        end, amount = label.end + m.end(), _price(m[2])
        refused = _refused(bool(m[1]), False, amount)
        conflict = [] if refused else _judged(text, label, end, _PRICE_WORDS)
        at = m.start(1) if m[1] else m.start(2)
        score = 0.0 if refused else V.LABEL_BASE + V.AMOUNT_BONUS + near(at)
        yield _candidate("MRP", label, end, score, ["MRP_LABEL_MATCH", "AMOUNT_ONLY_FALLBACK", *refused, *conflict], bool(refused or conflict), True, amount=amount)


def read_quantities(text: str, marks: Marks) -> Iterator[dict]:
    for label in marks.labels("NET_QUANTITY"):
        for m in _QUANTITY.finditer(text[marks.window(label, V.WINDOW)]):
            end = label.end + m.end()
            if m[1]:
                yield _candidate("NET_QUANTITY", label, end, 0.0, ["NET_QTY_LABEL_MATCH", "NEGATIVE_OR_SIGNED_REJECTED"], True)
            elif amount := strict_number(m[2]):
                conflict = _judged(text, label, end, _FOOD_WORDS)
                score = V.LABEL_BASE + V.AMOUNT_BONUS + near(m.start()) + V.UNIT_BONUS
                unit = V.UNITS.get(m[3].lower(), m[3].lower())
                yield _candidate("NET_QUANTITY", label, end, score, ["NET_QTY_LABEL_MATCH", "UNIT_MATCH", *conflict], bool(conflict), amount=amount, unit=unit)


def read_makers(text: str, marks: Marks) -> Iterator[dict]:
    for label in marks.labels("MANUFACTURER_ADDRESS"):
        behind = marks.window(label, V.MANUFACTURER_WINDOW)
        value = text[behind].strip(" :,-\n\t")
        if len(value) >= 3 and _LETTER.search(value):
            yield _candidate("MANUFACTURER_ADDRESS", label, behind.stop, 0.95 if len(value) >= 8 else 0.6, ["MANUFACTURER_LABEL_MATCH"], text=value)


def _year(digits: str) -> int:
    n = int(digits)
    return n + 2000 if n < 100 else n


def _day(y: int, m: int | None, d: int) -> str | None:
    try:
        return date(y, m or 0, d).isoformat()
    except ValueError:
        return None


def _month(y: int, m: int) -> str | None:
    return f"{y:04d}-{m:02d}" if 1 <= m <= 12 else None


#: Kind, pattern, groups to a date, whether precise to the day with a full year; in the order in which they cover text.
_FORMS: list[list[tuple[str, re.Pattern, Callable]]] = [
    [(kind, re.compile(p, re.IGNORECASE), f) for kind, p, f in level]
    for level in (
        [("range", V.DATE_RANGE, lambda m: _month(_year(m[2]), int(m[1])) if 2000 <= _year(m[2]) <= 2099 else None)],
        [
            ("dmy4", V.DATE_DMY4, lambda m: _day(int(m[3]), int(m[2]), int(m[1]))),
            ("ymd", V.DATE_YMD, lambda m: _day(int(m[1]), int(m[2]), int(m[3]))),
            ("dmonY", V.DATE_DMONY, lambda m: _day(_year(m[3]), V.MONTHS.get(m[2][:3].lower()), int(m[1]))),
        ],
        [("dmy2", V.DATE_DMY2, lambda m: _day(int(m[3]) + 2000, int(m[2]), int(m[1])))],
        [("my", V.DATE_MY, lambda m: _month(int(m[2]), int(m[1])))],
    )
]
PRECISE = ("dmy4", "ymd", "dmonY")
_DIGIT = re.compile(r"\d")


def read_dates_in(window: str) -> list[tuple[int, int, str, str | None]]:
    """(start, end, kind, date) by place.  A form is ignored where one of an earlier level covers part of it."""
    found: list[tuple[int, int, str, str | None]] = []
    if not _DIGIT.search(window):
        return found
    for level in _FORMS:
        new = [(m.start(), m.end(), kind, iso(m)) for kind, pattern, iso in level for m in pattern.finditer(window)]
        found += [x for x in new if not any(x[0] < y[1] and y[0] < x[1] for y in found)]
    return sorted(found, key=lambda x: (x[0], x[1], x[2], x[3] or ""))


def read_dates(text: str, marks: Marks) -> Iterator[dict]:
    for label in marks.labels("MANUFACTURING_DATE"):
        for _, e, kind, iso in read_dates_in(text[marks.window(label, V.DATE_WINDOW)])[:1]:
            end = label.end + e
            codes = ["MFG_DATE_LABEL_MATCH", *_judged(text, label, end, _DATE_WORDS), *([] if iso else ["MALFORMED_DATE_REJECTED"])]
            yield _candidate("MANUFACTURING_DATE", label, end, 0.95 if kind in PRECISE else 0.6, codes, len(codes) > 1, date=iso)


def read_contacts(text: str, marks: Marks) -> Iterator[dict]:
    for label in marks.labels("CONSUMER_CARE"):
        behind = text[marks.window(label, V.CARE_WINDOW)]
        phone, email = _PHONE.search(behind), _EMAIL.search(behind)
        parts = [(m, code) for m, code in ((phone, "PHONE_MATCH"), (email, "EMAIL_MATCH")) if m]
        if parts:
            value = {"phone": phone and phone[0], "email": email and _BLANKS.sub("", email[0])}
            end = label.end + max(m.end() for m, _ in parts)
            yield _candidate("CONSUMER_CARE", label, end, 0.95 if len(parts) == 2 else 0.6, ["CONSUMER_CARE_LABEL_MATCH", *(c for _, c in parts)], **value)


READERS: dict[str, Callable[[str, Marks], Iterator[dict]]] = {
    "MRP": read_prices, "NET_QUANTITY": read_quantities, "MANUFACTURER_ADDRESS": read_makers, "MANUFACTURING_DATE": read_dates, "CONSUMER_CARE": read_contacts,
}


def choose(found: list[dict], as_of: str | None = None) -> tuple[dict | None, str, bool]:
    """The best candidate that isn't suppressed (score, then place, then order found), its confidence, and whether the
    runner-up is as good but differs.  ``as_of``: full dates after it have low confidence."""
    alive = [c for c in found if not c["suppressed"]]
    if not alive:
        return None, "none", False
    if len(alive) > 1:
        alive.sort(key=lambda c: (-c["score"], c["start"]))
    top = alive[0]
    low = top["forced_low"] or top["score"] < V.HIGH_SCORE or (top["field"] == "MRP" and (top["amount"] or 0) >= V.LARGE_PRICE)
    late = as_of is not None and top["date"] is not None and len(top["date"]) == 10 and top["date"] > as_of
    tie = len(alive) > 1 and abs(top["score"] - alive[1]["score"]) < 1e-9 and any(top[v] != alive[1][v] for v in VALUES)
    return top, "low" if low or late else "high", tie


def read(text: str, fields=V.FIELDS) -> dict[str, list[dict]]:
    """All candidates of the fields in a normalised text."""
    marks = Marks(text)
    return {f: list(READERS[f](text, marks)) if f in marks.by else [] for f in fields}
