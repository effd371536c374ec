"""Boxes: polygons to rectangles, overlap, directional neighbours, rotations, second OCR pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

BOX = ("xmin", "ymin", "xmax", "ymax")


def rectangle(polygon: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax> of any number of corners, or of flat [x1, y1, x2, y2] given as the only point."""
    points = F.when((F.size(polygon) == 1) & (F.size(F.get(polygon, F.lit(0))) == 4), F.array(F.slice(F.get(polygon, F.lit(0)), 1, 2), F.slice(F.get(polygon, F.lit(0)), 3, 2))).otherwise(polygon)
    axis = lambda k: F.transform(points, lambda p: F.get(p, F.lit(k)))
    return F.when(F.size(polygon) > 0, F.struct(F.array_min(axis(0)).alias("xmin"), F.array_min(axis(1)).alias("ymin"), F.array_max(axis(0)).alias("xmax"), F.array_max(axis(1)).alias("ymax")))


def polygon(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def merged_box(polygons: Column) -> Column:
    """Rectangle around all points of several polygons."""
    return rectangle(F.flatten(polygons))


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}")


def iou(a: str = "a", b: str = "b") -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(_c(a, hi), _c(b, hi)) - F.greatest(_c(a, lo), _c(b, lo)))
    area = lambda p: F.greatest(F.lit(0.0), _c(p, "xmax") - _c(p, "xmin")) * F.greatest(F.lit(0.0), _c(p, "ymax") - _c(p, "ymin"))
    both = side("xmin", "xmax") * side("ymin", "ymax")
    union = area(a) + area(b) - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / union)


def in_window(a: str = "a", b: str = "b") -> Column:
    """Whether box b lies right of or near anchor box a, on about the same line."""
    return (
        (_c(b, "xmin") >= _c(a, "xmin") - V.MAX_LEFT)
        & (_c(b, "xmin") <= _c(a, "xmax") + V.MAX_RIGHT)
        & (_c(b, "ymin") >= _c(a, "ymin") - V.MAX_UP)
        & (_c(b, "ymax") <= _c(a, "ymax") + V.MAX_DOWN)
    )


def distance(a: str = "a", b: str = "b") -> Column:
    centre = lambda p, lo, hi: (_c(p, lo) + _c(p, hi)) / 2
    d = lambda lo, hi: centre(b, lo, hi) - centre(a, lo, hi)
    return F.sqrt(d("xmin", "xmax") * d("xmin", "xmax") + d("ymin", "ymax") * d("ymin", "ymax"))


def _same_image(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return on


def pairs(tokens: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Ordered pairs of different tokens of one image that meet a condition on boxes a and b: an equality join on the image
    with the condition inside it; an image has few tokens."""
    return tokens.alias("a").join(tokens.alias("b"), _same_image(keys) & (F.col("a.token_index") != F.col("b.token_index")) & condition)


def anchored(tokens: DataFrame, keys: list[str], field: str, value_pattern: str) -> DataFrame:
    """The first anchor token with a neighbour that matches, and its nearest such neighbour; tokens equal to the anchor in
    text and box don't count."""
    same = (F.col("a.text") == F.col("b.text")) & (F.col("a.xmin") == F.col("b.xmin")) & (F.col("a.ymin") == F.col("b.ymin"))
    near = pairs(tokens, keys, in_window() & F.upper("a.text").rlike("(?uU)" + "|".join(V.ANCHORS[field])) & F.col("b.text").rlike(X.FLAGS + value_pattern) & ~same)
    rows = near.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.token_index").alias("anchor"), F.col("b.token_index").alias("neighbour"), F.col("b.text").alias("evidence"), distance().alias("distance"))
    order = Window.partitionBy(*keys).orderBy("anchor", "distance", "neighbour")
    value = F.regexp_extract("evidence", X.FLAGS + value_pattern, 0)
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*keys, F.lit(field).alias("field"), "anchor", "neighbour", value.alias("value"), F.round("distance", 4).alias("distance"))


def merge_tokens(passes: DataFrame, keys: list[str], dedupe: bool = False) -> DataFrame:
    """Union of OCR passes; with ``dedupe`` a token goes if one of the same image overlaps it by half and is surer."""
    if not dedupe:
        return passes
    surer = (F.col("b.confidence") > F.col("a.confidence")) | ((F.col("b.confidence") == F.col("a.confidence")) & (F.col("b.token_index") < F.col("a.token_index")))
    return passes.alias("a").join(passes.alias("b"), _same_image(keys) & (iou() > 0.5) & surer, "left_anti")


def rotation_scores(detections: DataFrame) -> DataFrame:
    """Score of each rotation: sure long texts count, one or two characters hardly, compliance words a lot."""
    text = F.trim("text")
    own = F.when(F.length(text) <= 2, F.col("confidence") * 0.1).otherwise(F.col("confidence") * F.length(text)) + F.when(text.rlike(X.FLAGS + V.ROTATION_WORDS), 100.0).otherwise(0.0)
    return detections.where("text IS NOT NULL AND confidence IS NOT NULL").groupBy("image_id", "rotation").agg(F.round(F.sum(own), 6).alias("score"))


def best_rotation(detections: DataFrame) -> DataFrame:
    """Rotation of highest score; the first wins ties."""
    best = F.max_by(F.struct("rotation", "score"), F.struct("score", (-F.col("rotation")).alias("r")))
    return rotation_scores(detections).groupBy("image_id").agg(best.alias("b")).select("image_id", "b.rotation", "b.score")


def needs_second_pass(tokens: Column) -> Column:
    """No tokens, no price or date signal, or low mean confidence."""
    signal = F.array_join(F.transform(tokens, lambda t: F.coalesce(t["text"], F.lit(""))), " ").rlike(X.FLAGS + V.TRIGGER)
    return F.coalesce(F.size(tokens) == 0, F.lit(True)) | ~F.coalesce(signal, F.lit(False)) | (F.coalesce(X.mean_confidence(tokens), F.lit(0.0)) < 0.45)
