"""Merging the images of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def merge_images(mapped: DataFrame, keys: list[str], image: str = "image_index", values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Per key and field the best image: one with a value, then the surer, then the earlier.

    One aggregation with a map-side part, equal to folding the images in order."""
    has = ~X.all_null(*values)
    rank = F.when(has, F.coalesce(X.lookup(V.CONFIDENCE_RANK, F.col("confidence")), F.lit(0))).otherwise(F.lit(0))
    rest = [c for c in mapped.columns if c not in (*keys, "field")]
    best = F.max_by(F.struct(*rest), F.struct(has.alias("has"), rank.alias("rank"), (-F.col(image)).alias("image")))
    return mapped.groupBy(*keys, "field").agg(best.alias("b")).select(*keys, "field", "b.*")


def primary_image_boxes(rows: DataFrame, primary: int = 0, image: str = "image_index", box: str = "bbox") -> DataFrame:
    """Boxes of other images than the primary one are void there."""
    return rows.withColumn(box, F.when(F.col(image) == primary, F.col(box)))


def field_images(merged: DataFrame, image: str = "image_index") -> DataFrame:
    """Which image each contract field came from."""
    return merged.withColumn("field_name", X.lookup(V.CONTRACT_NAMES, F.col("field"))).where("field_name IS NOT NULL")


def public_keys(m: Column) -> Column:
    """A map without internal keys, which start with ``_``; the image index stays."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_") | (k == "_image_index"))
