"""Accuracy of extracted fields against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def expected_price(text: Column) -> Column:
    t = F.regexp_replace(text, X.FLAGS + V.PRICE_WORDS, " ")
    t = F.regexp_replace(F.replace(F.translate(t, "₹$", "  "), F.lit("/-"), F.lit(" ")), r"(?<=\d)\s+(?=\d)", "")
    return F.regexp_replace(F.nullif(F.regexp_extract(t, X.FLAGS + V.EXPECTED_PRICE, 0), F.lit("")), ",", "").try_cast("double")


def expected_quantity(text: Column) -> Column:
    """struct<amount, unit> in mg, g, kg, ml or l; null for anything else."""
    t = F.lower(F.trim(text))
    for long, short in V.UNIT_WORDS.items():
        t = F.replace(t, F.lit(long), F.lit(short))
    p = X.FLAGS + V.EXPECTED_QUANTITY
    amount = F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.when(amount.isNotNull(), F.struct(amount.cast("double").alias("amount"), F.regexp_extract(t, p, 2).alias("unit")))


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def contact(phone: Column, email: Column) -> Column:
    return F.nullif(plain(F.concat_ws(" / ", phone, email)), F.lit(""))


def accuracy(rows: DataFrame) -> DataFrame:
    """Share of rows whose ``expected`` equals ``actual`` (nulls equal), per field and, under ALL, overall: one rollup."""
    ok = F.col("expected").eqNullSafe(F.col("actual")).cast("int")
    return rows.rollup("field").agg(F.count("*").alias("total"), F.sum(ok).alias("correct")).select(
        F.coalesce("field", F.lit("ALL")).alias("field"), "total", "correct", F.round(F.col("correct") / F.col("total"), 4).alias("accuracy")
    )


def word_set(text: Column) -> Column:
    lower = F.split(F.lower(F.replace(text, F.lit("₹"), F.lit(""))), "[^a-zA-Z0-9\\x{0900}-\\x{097F}]+")
    words = F.filter(lower, lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]+$"))
    return F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))))


def recall(expected: Column, actual: Column) -> Column:
    """Share of the expected words that the actual text has."""
    want = word_set(expected)
    return F.size(F.array_intersect(want, word_set(actual))) / F.nullif(F.size(want), F.lit(0))


def batch_recall(rows: DataFrame, least: float = V.RECALL_LEAST) -> DataFrame:
    """One row for texts ``expected`` and ``actual``: how many, their mean recall, and how many reach ``least``; texts
    without words don't count."""
    share = recall(F.col("expected"), F.col("actual"))
    scored = rows.select(share.alias("recall")).where("recall IS NOT NULL")
    return scored.agg(F.count("*").alias("total"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.count_if(F.col("recall") >= least).alias("passed"))


def relative_error(measured: Column, truth: Column) -> Column:
    return F.abs(measured - truth) / truth
