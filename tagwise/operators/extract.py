"""Candidates for the five declared fields, and the best of each.

Input: any DataFrame with a text or a token column.  Texts are read in Arrow batches by :mod:`tagwise.functions.reading`, all
fields in one pass over a text; nothing is shuffled, but for inputs so small that they would occupy a few cores only
(:func:`tagwise.functions.text.spread`).  Candidates have one shape for all fields.

Null texts and tokens count as empty; rows with equal keys are read each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout, reading
from ..functions import text as X
from ..functions import vocabulary as V

VALUES = {"amount": "double", "unit": "string", "text": "string", "date": "string", "phone": "string", "email": "string"}
_VALUES = ",".join(f"{k}:{t}" for k, t in VALUES.items())
CANDIDATE = f"struct<field:string,{_VALUES},label_matched:string,score:double,start:int,end:int,reason_codes:array<string>,suppressed:boolean,forced_low:boolean,label_ord:int>"
RESOLVED = f"struct<norm:string,candidates:array<{CANDIDATE}>,best:{CANDIDATE},confidence:string,ambiguous:boolean>"
_V_VALUES = ",".join(f"v_{k}:{t}" for k, t in VALUES.items())
_ROW = f"field:string,{_V_VALUES},raw_evidence:string,label_matched:string,score:double,confidence:string,ambiguous:boolean,reason_codes:array<string>"
MAPPED = f"array<struct<{_ROW}>>"
POLYGONS = "array<array<array<double>>>"
MAPPED_TOKENS = f"array<struct<{_ROW},language:string,bbox:{POLYGONS},second:struct<value:string,evidence:string,bbox:{POLYGONS}>>>"


#: Pages without boxes that a task remembers, and the characters that such a page has at most.
PAGES, PAGE_CHARS = 4096, 2000


def _resolver(field: str, as_of: str | None):
    def one(text: str | None) -> dict:
        norm = reading.normalise(text)
        found = reading.read(norm, [field])[field]
        best, confidence, tie = reading.choose(found, as_of)
        return {"norm": norm, "candidates": found, "best": best, "confidence": confidence, "ambiguous": tie}

    return one


def row(field: str, norm: str, found: list[dict], as_of: str | None) -> dict:
    """The contents of a result row: value, evidence and how sure it is; confidence none without a candidate."""
    return _row(field, norm, *reading.choose(found, as_of))


def _row(field: str, norm: str, best: dict | None, confidence: str, tie: bool) -> dict:
    out = {"field": field, "confidence": confidence, "ambiguous": tie}
    if best:
        out |= {f"v_{k}": best[k] for k in VALUES}
        out |= {"raw_evidence": norm[best["start"] : best["end"]], "label_matched": best["label_matched"], "score": best["score"], "reason_codes": [*best["reason_codes"], "NEAREST_VALUE"]}
    return out


def _mapper(as_of: str | None):
    def one(text: str | None) -> list[dict]:
        norm = reading.normalise(text)
        return [row(f, norm, found, as_of) for f, found in reading.read(norm).items()]

    return one


def _token_mapper(as_of: str | None, second_pass: bool):
    """One image's tokens: the fields read from the joined text; where the last three stand; and the second pass."""

    read: dict[tuple, list[dict]] = {}

    def one(tokens: list[dict] | None) -> list[dict]:
        """As :func:`whole`; pages without boxes that say the same are read once as long as they are remembered."""
        said, length = [], 0
        for t in tokens or ():
            if t is not None and (text := t["text"]) is not None:
                if t["bbox"] is not None or (length := length + len(text)) > PAGE_CHARS:
                    return whole(tokens)
                said.append((text, t["confidence"], t["language"]))
        key = tuple(said)
        if (out := read.get(key)) is None:
            if len(read) >= PAGES:
                read.clear()
            out = read[key] = whole(tokens)
        return out

    def whole(tokens: list[dict] | None) -> list[dict]:
        page = layout.Page(tokens or [])
        norm, offsets = reading.normalise_with_offsets(page.text)
        rows = {}
        for f, found in reading.read(norm).items():
            best, confidence, tie = reading.choose(found, as_of)
            r = rows[f] = _row(f, norm, best, confidence, tie)
            if best and f not in ("MRP", "NET_QUANTITY"):
                r |= _evidence(page, offsets, best)
            if r["confidence"] == "high" and (r.pop("ocr", None) or 1.0) < V.LOW_OCR:
                r["confidence"] = "low"
        for field, second in (page.second_pass() if second_pass else {}).items():
            rows.setdefault(field, {"field": field, "confidence": "none", "ambiguous": False})["second"] = second
        return list(rows.values())

    def _evidence(page: layout.Page, offsets: list[int], best: dict) -> dict:
        near = page.supporting(*reading.original_span(offsets, best["start"], best["end"], len(page.text)))
        return {"ocr": layout.mean_confidence(near), "language": layout.main_language(near), "bbox": [t.polygon for t in near if t.polygon is not None]}

    return one


def candidates(df: DataFrame, field: str, text: str = "norm") -> DataFrame:
    """``df`` with ``candidates``: all of a field's candidates in a normalised text, in the order they are found."""
    find = X.arrow(f"array<{CANDIDATE}>", lambda t: reading.read(t or "", [field])[field])
    return df.withColumn("candidates", find(F.col(text)))


def best(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """The best unsuppressed candidate of each row (score, then place, then order found), its confidence and whether the
    runner-up is as good but differs.  ``as_of``: full dates after it have low confidence."""
    alive = F.filter("candidates", lambda c: ~c["suppressed"])
    ranked = F.array_sort(F.transform(alive, lambda c, i: F.struct((-c["score"]).alias("s"), c["start"].alias("at"), i.alias("i"), c.alias("c"))))

    def choose(r: Column) -> Column:
        return X.let(F.struct(F.get(r, F.lit(0))["c"].alias("top"), F.get(r, F.lit(1))["c"].alias("next")), judge)

    def judge(v: Column) -> Column:
        top, next_ = v["top"], v["next"]
        same = F.lit(True)
        for k in VALUES:
            same = same & top[k].eqNullSafe(next_[k])
        low = top["forced_low"] | (top["score"] < V.HIGH_SCORE) | F.coalesce((top["field"] == "MRP") & (top["amount"] >= V.LARGE_PRICE), F.lit(False))
        if as_of:
            low = low | F.coalesce((F.length(top["date"]) == 10) & (top["date"] > as_of), F.lit(False))
        confidence = F.when(top.isNull(), "none").when(low, "low").otherwise("high")
        ambiguous = F.coalesce((F.abs(top["score"] - next_["score"]) < 1e-9) & ~same, F.lit(False))
        return F.struct(top.alias("best"), confidence.alias("confidence"), ambiguous.alias("ambiguous"))

    out = df.withColumn("__chosen", X.let(ranked, choose))
    return out.select(*df.columns, "__chosen.*")


def resolve(df: DataFrame, field: str, text: str = "text", as_of: str | None = None) -> DataFrame:
    """``df`` with ``norm``, ``candidates``, ``best``, ``confidence`` and ``ambiguous`` for one field of its text."""
    found = X.spread(df).withColumn("__found", X.arrow(RESOLVED, _resolver(field, as_of))(F.col(text)))
    return found.select(*df.columns, "__found.*")


def _exploded(df: DataFrame, keys: list[str], rows: Column, spread: bool = True) -> DataFrame:
    # every row has some: an inner explode would have the optimizer test that by reading the texts once more, before the deal
    return (X.spread(df) if spread else df).select(*keys, rows.alias("__rows")).select(*keys, F.explode_outer("__rows").alias("__r")).select(*keys, "__r.*")


def map_fields(df: DataFrame, keys: list[str], text: str = "text", as_of: str | None = None) -> DataFrame:
    """Long form: a row per key and field with value, evidence, confidence; fields without a candidate have confidence none."""
    return _exploded(df.select(*keys, text), keys, X.arrow(MAPPED, _mapper(as_of))(F.col(text)))


def map_tokens(df: DataFrame, keys: list[str], tokens: str = "tokens", as_of: str | None = None, second_pass: bool = True, spread: bool = True) -> DataFrame:
    """As :func:`map_fields` for rows of OCR tokens, an image each, with language and boxes of the evidence of the last three
    fields, and ``second``: what the second pass finds for a field (value, evidence, boxes), or null.  A field that only the
    second pass knows (the expiry date) has a row if it is found.  ``spread``: deal small inputs to all cores first."""
    return _exploded(df.select(*keys, tokens), keys, X.arrow(MAPPED_TOKENS, _token_mapper(as_of, second_pass))(F.col(tokens)), spread)


def finalize(df: DataFrame) -> DataFrame:
    """For extended fields: back-maps the best span, finds its tokens, and lowers confidence if OCR was unsure.  Needs
    ``best``, ``offsets``, ``text`` and ``index`` (see :func:`tagwise.functions.text.token_index`)."""
    span = X.back_map(F.col("offsets"), F.col("best")["start"], F.col("best")["end"], F.length("text"))
    out = df.withColumn("span", F.when(F.col("best").isNotNull(), span)).withColumn("evidence_tokens", X.supporting(F.col("index"), F.col("span")["start"], F.col("span")["end"]))
    ocr = X.mean_confidence(F.col("evidence_tokens"))
    return (
        out.withColumn("ocr_confidence", ocr)
        .withColumn("language", X.main_language(F.col("evidence_tokens")))
        .withColumn("bbox", F.filter(F.transform("evidence_tokens", lambda t: t["bbox"]), lambda b: b.isNotNull()))
        .withColumn("confidence", F.when((F.col("confidence") == "high") & (F.col("ocr_confidence") < V.LOW_OCR), "low").otherwise(F.col("confidence")))
    )


def keywords(spark: SparkSession) -> DataFrame:
    """The labels of each field as a table: field, label, pattern, in order of precedence."""
    return spark.createDataFrame([(f, i, name, p) for f, labels in V.LABELS.items() for i, (p, name) in enumerate(labels)], "field string, label_ord int, label string, pattern string")


def to_json(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with ``fields``: a JSON object of the mapped rows by field; nulls are left out."""
    rest = [c for c in mapped.columns if c not in (*keys, "field")]
    entry = F.struct("field", F.struct(*rest).alias("value"))
    return mapped.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["field"] < b["field"], -1).when(a["field"] > b["field"], 1).otherwise(0)))).alias("fields"))
