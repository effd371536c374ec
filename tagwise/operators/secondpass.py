"""Second pass: value normalizers, unlabelled sweeps, override of the first pass, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

MONTHS = {k.upper(): v for k, v in V.MONTHS.items()}
#: Unicode's digits, letters and blanks, with regard to case.
EXACT = "(?U)"


def _nullif(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_mrp(value: Column) -> Column:
    return X.let(F.regexp_extract(value, EXACT + V.SECOND_PRICE, 0), lambda found: F.translate(found, ",", "").try_cast("double"))


def normalize_quantity(value: Column) -> Column:
    """struct<amount, unit>, null for an unknown unit."""
    amount, unit = (F.regexp_extract(value, X.FLAGS + V.SECOND_QUANTITY, k) for k in (1, 2))
    known = X.let(F.lower(unit), lambda u: F.coalesce(X.lookup(V.SECOND_SINGULAR, u), u))
    return X.let(amount, lambda a: F.when(a != "", F.struct(a.try_cast("double").alias("amount"), known.alias("unit"))))


def normalize_date(value: Column) -> Column:
    """Day or month precision, without calendar checks; six bare digits are no date."""
    given = F.upper(F.trim(value))
    full, month, named = (EXACT + V.SECOND_DATES[k] for k in ("full", "month", "named"))
    year = lambda y: X.let(y.try_cast("int"), lambda n: F.lpad(F.when(n < 100, n + 2000).otherwise(n).cast("string"), 4, "0"))
    two = lambda x: F.lpad(x.try_cast("int").cast("string"), 2, "0")

    def read(text: Column) -> Column:
        g = lambda p, k: F.regexp_extract(text, p, k)
        number = X.lookup(MONTHS, F.substring(g(named, 1), 1, 3))
        return (
            F.when(text.rlike(full), F.concat(year(g(full, 3)), F.lit("-"), two(g(full, 2)), F.lit("-"), two(g(full, 1))))
            .when(text.rlike(month) & g(month, 1).try_cast("int").between(1, 12), F.concat(year(g(month, 2)), F.lit("-"), two(g(month, 1))))
            .otherwise(X.let(number, lambda n: F.when(n.isNotNull(), F.concat(year(g(named, 2)), F.lit("-"), two(n)))))
        )

    return F.when(~given.rlike(EXACT + V.SECOND_DATES["refused"]), X.let(F.regexp_replace(given, EXACT + r"[\s.\-]+", "/"), read))


def normalize_care(value: Column) -> Column:
    """struct<phone, email>; two nulls for a text without either."""
    toll_free = F.trim(value).rlike(EXACT + V.TOLL_FREE)
    numbered = lambda p: F.when(p != "", F.when(toll_free & ~p.startswith("1-"), F.concat(F.lit("1-"), p)).otherwise(p))
    phone = X.let(F.trim(F.regexp_extract(value, EXACT + V.SECOND_PHONE, 0)), numbered)
    email = X.let(F.regexp_extract(value, X.FLAGS + V.SECOND_EMAIL, 0), _nullif)
    return F.when(value.isNotNull(), F.struct(phone.alias("phone"), email.alias("email")))


def sweep_mrp(text: Column) -> Column:
    """struct<value, evidence>: the largest amount behind a price word anywhere; the first of equal ones."""
    p = X.FLAGS + V.SWEEP["MRP"]
    amounts = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda a: F.regexp_replace(a, ",", "").try_cast("double"))
    whole = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    ranked = F.filter(F.transform(amounts, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), lambda x: x["v"].isNotNull())
    return X.let(F.array_min(ranked), lambda b: F.when(b.isNotNull(), F.struct((-b["v"]).alias("value"), F.get(whole, b["i"]).alias("evidence"))))


def _first(text: Column, key: str, k: int = 0, flags: str = X.FLAGS) -> Column:
    return _nullif(F.regexp_extract(text, flags + V.SWEEP[key], k))


def sweep(text: Column) -> dict[str, Column]:
    """The first match of each field anywhere in a text, as text; the largest price."""
    maker = F.trim(_first(text, "MANUFACTURER_ADDRESS", 1, "(?iusU)"))
    return {
        "MRP": sweep_mrp(text)["evidence"],
        "NET_QUANTITY": _first(text, "NET_QUANTITY"),
        "MANUFACTURER_ADDRESS": F.when(F.length(maker) > 10, maker),
        "MANUFACTURING_DATE": F.coalesce(_first(text, "DATE_STRICT"), _first(text, "DATE_MONTH_YEAR")),
        "CONSUMER_CARE": _first(text, "CONSUMER_CARE"),
    }


VALUES = ("v_amount", "v_unit", "v_text", "v_date", "v_phone", "v_email")


def normalized(rows: DataFrame, value: str = "value", prefix: str = "v_") -> DataFrame:
    """Rows with ``field`` and a text value, to the value columns of the first pass, and whether there is a value.  An
    address is stripped, and none if blank; other fields than the five keep their text."""
    is_ = lambda f: F.col("field") == f
    v = F.col(value)
    blank = F.lit(" \t\n\r\x0b\x0c")
    quantity, care = F.col("__quantity"), F.col("__care")
    # a column for each field, so that a value is normalized once and the code for it stays small enough to be compiled
    each = {
        "__price": F.when(is_("MRP"), normalize_mrp(v)),
        "__quantity": F.when(is_("NET_QUANTITY"), normalize_quantity(v)),
        "__text": F.when(is_("MANUFACTURER_ADDRESS"), X.let(F.btrim(v, blank), _nullif)).when(~F.col("field").isin(*V.FIELDS), v),
        "__day": F.when(is_("MANUFACTURING_DATE"), normalize_date(v)),
        "__care": F.when(is_("CONSUMER_CARE"), normalize_care(v)),
    }
    return (
        rows.withColumns(each)
        .withColumns(
            {
                f"{prefix}amount": F.coalesce("__price", quantity["amount"]),
                f"{prefix}unit": quantity["unit"],
                f"{prefix}text": F.col("__text"),
                f"{prefix}date": F.col("__day"),
                f"{prefix}phone": care["phone"],
                f"{prefix}email": care["email"],
                "has_value": F.when(is_("MRP"), F.col("__price").isNotNull())
                .when(is_("NET_QUANTITY"), quantity["amount"].isNotNull())
                .when(is_("MANUFACTURER_ADDRESS"), F.col("__text").isNotNull())
                .when(is_("MANUFACTURING_DATE"), F.col("__day").isNotNull())
                .otherwise(v.isNotNull()),
            }
        )
        .drop(*each)
    )


def sweep_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Long second-pass rows (keys, field, value) of the fields that a sweep finds."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in sweep(F.col(text)).items()))
    return df.select(*keys, F.explode_outer(pairs).alias("p")).select(*keys, "p.*").where("value IS NOT NULL")


def missing(confidence: str = "confidence") -> Column:
    """A field without value or without confidence."""
    return X.all_null(*VALUES) | F.col(confidence).isin("none", "low")


def missing_fields(mapped: DataFrame, keys: list[str]) -> DataFrame:
    return mapped.where(missing()).groupBy(*keys).agg(F.array_sort(F.collect_list("field")).alias("missing"))


def override(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Second-pass values replace the first pass wherever they can be normalized; fields only the second has are added."""
    found = normalized(second).where("has_value").select(*keys, "field", *(F.col(v).alias(f"n{v}") for v in VALUES), F.col("value").alias("n_evidence"), F.lit(True).alias("hit"))
    joined = first.join(found, [*keys, "field"], "full")
    pick = {v: F.when(F.col("hit"), F.col(f"n{v}")).otherwise(F.col(v)) for v in VALUES}
    return joined.select(
        *keys,
        "field",
        *(c.alias(v) for v, c in pick.items()),
        F.when(F.col("hit"), F.col("n_evidence")).otherwise(F.col("raw_evidence")).alias("raw_evidence"),
        F.when(F.col("hit"), "high").otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("hit") | (F.col("confidence") != "none"), "regex").otherwise("none").alias("method"),
    )


def overridden(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of :func:`tagwise.operators.extract.map_tokens` after the second pass: what it found in the same row replaces
    the first pass wherever it can be normalized, whatever the confidence.  No join."""
    rows = normalized(mapped.withColumn("__value", F.col("second.value")), "__value", "n_")
    hit = F.col("has_value")
    same = {v: F.when(hit, F.col(f"n_{v[2:]}")).otherwise(F.col(v)) for v in VALUES}
    out = rows.select(
        *keys,
        "field",
        *(c.alias(v) for v, c in same.items()),
        F.when(hit, F.col("second.evidence")).otherwise(F.col("raw_evidence")).alias("raw_evidence"),
        F.when(hit, "high").otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit | (F.col("confidence") != "none"), "regex").otherwise("none").alias("method"),
        F.when(hit, F.col("second.bbox")).otherwise(F.col("bbox")).alias("bbox"),
        *(F.when(~hit, F.col(c)).alias(c) for c in ("label_matched", "score", "ambiguous", "reason_codes", "language")),
        F.col("__value").isNotNull().alias("__found"),
    )
    # what is no field of the first pass has a value if the second pass found one
    return out.where(F.col("field").isin(*V.FIELDS) | F.col("__found")).drop("__found")


def enrich(mapped: DataFrame, enrichment: DataFrame, keys: list[str]) -> DataFrame:
    """Fills missing fields from an external long table (keys, field, value); present fields are left alone.  Other columns
    of ``mapped`` stay."""
    extra = normalized(enrichment).where("has_value").select(*keys, "field", *(F.col(v).alias(f"n{v}") for v in VALUES), F.col("value").alias("n_evidence"))
    return _filled(mapped.join(extra, [*keys, "field"], "left"), mapped.columns, keys)


GIVEN = "given"


def with_given(images: DataFrame, enrichment: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Images (keys, tokens) with :data:`GIVEN`, the normalized rows of ``enrichment`` for each of them, dealt by the first key.

    One shuffle of tokens and of short rows in place of one of all fields of all images; null keys match nothing."""
    found = normalized(enrichment.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))).where("has_value")
    value = F.struct("field", F.col("value").alias("n_evidence"), *(F.col(v).alias(f"n{v}") for v in VALUES))
    pages = images.select(*keys, F.struct("tokens").alias("page")).withColumn("value", F.lit(None).cast(found.select(value.alias("v")).schema["v"].dataType))
    rows = pages.unionByName(found.select(*keys, value.alias("value")), allowMissingColumns=True).repartition(parts, keys[0])
    each = rows.groupBy(*keys).agg(F.collect_list("page").alias("pages"), F.array_sort(F.collect_list("value")).alias(GIVEN))
    return each.select(*keys, F.explode("pages").alias("page"), GIVEN).select(*keys, "page.tokens", GIVEN)


def enrich_given(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`enrich` with what :func:`with_given` has put into the rows.  Of several values for a field the least counts."""
    one = F.get(F.filter(GIVEN, lambda g: g["field"] == F.col("field")), F.lit(0))
    names = ["n_evidence", *(f"n{v}" for v in VALUES)]
    rows = mapped.withColumn("__one", one).select(*mapped.columns, *(F.col("__one")[n].alias(n) for n in names))
    return _filled(rows, [c for c in mapped.columns if c != GIVEN], keys)


def _filled(joined: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    fill = missing() & F.col("n_evidence").isNotNull()
    new = {v: F.when(fill, F.col(f"n{v}")).otherwise(F.col(v)) for v in VALUES}
    new |= {
        "raw_evidence": F.when(fill, F.col("n_evidence")).otherwise(F.col("raw_evidence")),
        "confidence": F.when(fill, "high").otherwise(F.col("confidence")),
        "method": F.when(fill, "llm").otherwise(F.col("method")),
    }
    rest = [c for c in columns if c not in (*keys, "field", *new)]
    return joined.select(*keys, "field", *(c.alias(n) for n, c in new.items()), *rest)
