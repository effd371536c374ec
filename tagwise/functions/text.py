"""Column functions over text and tokens; those that Spark's own functions can't do in linear time are Arrow functions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..shipping import ship
from . import layout, reading

#: Case-insensitive, with Unicode's letters, digits and blanks.
FLAGS = "(?iuU)"
#: Inputs of fewer bytes for each core are dealt anew before work that is bound by the processor, but not more thinly than the
#: latter.
SPREAD_BYTES, LEAST_BYTES = 16 << 20, 64 << 10
#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 256

_BBOX = "array<array<double>>"
INDEX = f"array<struct<start:int,end:int,i:int,text:string,confidence:double,language:string,bbox:{_BBOX}>>"


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def all_null(*columns: str) -> Column:
    return reduce(Column.__and__, (F.col(c).isNull() for c in columns))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores if the input is so small that its files may give fewer partitions than cores; a larger input
    stays as it is read."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(cores, size // LEAST_BYTES)
    return df.repartition(parts) if parts > 1 and size < cores * SPREAD_BYTES else df


def parts_by_key(df: DataFrame) -> int:
    """Partitions for rows that are dealt by a key before work that is bound by the processor: as many as the session shuffles
    to, for all cores at least; fewer for an input that isn't worth them."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(least, size // LEAST_BYTES))


def arrow(result: str, one):
    """An Arrow function: ``one`` of each value, null included, gives a value of the type ``result``."""
    ship(SparkSession.active())
    kind = to_arrow_type(DataType.fromDDL(result))

    @F.arrow_udf(returnType=result)
    def call(column: pa.Array) -> pa.Array:
        # some rows at a time: as Python objects they take many times the room
        parts = [pa.array([one(x) for x in column.slice(s, SLICE_ROWS).to_pylist()], kind) for s in range(0, len(column), SLICE_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return call


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def normalize_text(text: Column) -> Column:
    """Blanks, spellings and digits made alike for matching; null as an empty text."""
    return arrow("string", reading.normalise)(text)


def normalize_with_map(df: DataFrame, text: str, name: str = "mapped") -> DataFrame:
    """``df`` with struct<t, o>: the normalised text and, for each of its characters, the offset in the original."""
    both = arrow("struct<t:string,o:array<int>>", lambda t: dict(zip("to", reading.normalise_with_offsets(t), strict=True)))
    return df.withColumn(name, both(F.col(text)))


def back_map(offsets: Column, start: Column, end: Column, length: Column) -> Column:
    """struct<start, end> in the original text of a half-open span of the normalised one; at least one wide."""
    n = F.size(offsets)
    s = F.get(offsets, F.greatest(F.lit(0), F.least(start, n - 1)))
    e = F.get(offsets, F.greatest(F.lit(0), F.least(end - 1, n - 1))) + 1
    return F.when(n == 0, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).otherwise(
        F.struct(s.alias("start"), F.least(length, F.greatest(e, s + 1)).alias("end"))
    )


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _index(tokens: list[dict] | None) -> list[dict]:
    return [
        {"start": t.start, "end": t.end, "i": i, "text": t.text, "confidence": t.confidence, "language": t.language, "bbox": t.polygon}
        for i, t in enumerate(layout.Page(tokens or []).tokens)
    ]


def token_index(tokens: Column) -> Column:
    """array<struct<start, end, i, text, ...>>: place of each token that has a text in the blank-joined text."""
    return arrow(INDEX, _index)(tokens)


def joined_text(tokens: Column) -> Column:
    return F.array_join(F.transform(F.filter(tokens, lambda t: t["text"].isNotNull()), lambda t: t["text"]), " ")


def supporting(index: Column, start: Column, end: Column) -> Column:
    """Tokens that overlap a half-open span, in order."""
    return F.filter(index, lambda t: (t["end"] > start) & (t["start"] < end))


def mean_confidence(tokens: Column) -> Column:
    some = F.filter(tokens, lambda t: t["confidence"].isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size(some))


def main_language(tokens: Column) -> Column:
    """The most common language; the first seen wins ties; ``en`` if there is none."""
    langs = F.filter(F.transform(tokens, lambda t: t["language"]), lambda x: F.coalesce(x, F.lit("")) != "")
    ranked = F.transform(F.array_distinct(langs), lambda x, i: F.struct((-F.size(F.filter(langs, lambda y: y == x))).alias("n"), i.alias("i"), x.alias("x")))
    return F.coalesce(F.array_min(ranked)["x"], F.lit("en"))
