"""Letter heights from boxes and a coin, against the slabs for a quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def required_mm(quantity: Column) -> Column:
    """Half-open slabs; anything else needs the largest height."""
    out = F.when(F.lit(False), 0.0)
    for low, high, mm in V.SLABS:
        out = out.when((quantity >= low) & (quantity < high), mm)
    return out.otherwise(V.SLABS[-1][2])


def mm_per_pixel(coin: Column, radius: Column) -> Column:
    """Null for an unknown coin or no radius."""
    return F.when(radius > 0, X.lookup(V.COIN_MM, coin) / (2 * radius))


def base_quantity(amount: Column, unit: Column) -> Column:
    """Grams or millilitres; null for units that are counted or unknown."""
    return amount * X.lookup(V.BASE_UNITS, F.lower(unit))


def quantity_of_token(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def check(boxes: DataFrame) -> DataFrame:
    """``boxes`` (y1, y2, coin_key, coin_radius_px, quantity, unit) with measured and required height and verdict."""
    q = base_quantity(F.col("quantity"), F.col("unit"))
    height = F.round((F.col("y2") - F.col("y1")) * mm_per_pixel(F.col("coin_key"), F.col("coin_radius_px")), 3)
    out = boxes.withColumns({"measured_mm": height, "base_quantity": q})
    need = required_mm(F.col("base_quantity"))
    return out.withColumns(
        {
            "required_mm": need,
            "is_compliant": F.col("measured_mm") >= need,
            "confidence": F.when(F.col("base_quantity").isNull(), "low").otherwise("high"),
            "notes": F.when(F.col("base_quantity").isNull(), "unit not supported").when(F.col("measured_mm") < need, "FAIL").otherwise("PASS"),
        }
    )


def of_fields(fields: DataFrame, calibrations: DataFrame, keys: list[str]) -> DataFrame:
    """The checked fields: each contract row with a box, in a scan with a calibration (keys, coin_key, coin_radius_px), with
    measured and required height.

    The quantity is the declared one in grams or millilitres; else the digits of the declaration; else the requirement is
    unknown and the confidence low.  ``note`` says that the unit is counted or unknown.  Scans with an unknown coin or no
    radius have no rows."""
    scale = calibrations.select(*keys, mm_per_pixel(F.col("coin_key"), F.col("coin_radius_px")).alias("mm_per_px")).where("mm_per_px IS NOT NULL")
    declared = F.col("field_name") == "net_quantity"
    base = F.when(declared, base_quantity(F.col("amount"), F.col("unit")))
    digits = F.when(declared & F.col("bbox").isNotNull(), quantity_of_token(F.col("raw_value")))
    odd = F.when(declared & F.col("unit").isNotNull(), base.isNull())
    own = fields.where(F.col("field_name").isin(*V.CONTRACT_NAMES.values()))
    of_scan = own.groupBy(*keys).agg(
        F.coalesce(F.max(base), F.max(digits)).alias("quantity"),
        F.coalesce(F.bool_or(odd), F.lit(False)).alias("odd"),
        F.collect_list(F.when(F.col("bbox").isNotNull(), F.struct("field_name", "bbox"))).alias("boxes"),
    )
    rows = of_scan.join(scale, keys).select(*keys, "quantity", "odd", "mm_per_px", F.explode("boxes").alias("b")).select("*", "b.*")
    height = F.round((F.col("bbox.ymax") - F.col("bbox.ymin")) * F.col("mm_per_px"), 3)
    need = F.when(F.col("quantity").isNotNull(), required_mm(F.col("quantity")))
    return rows.select(
        *keys, "field_name", "bbox", height.alias("measured_mm"), need.alias("required_mm"), (height >= need).alias("is_compliant"),
        F.when(need.isNull(), "low").otherwise("high").alias("confidence"), F.when(F.col("odd"), "unit not supported").alias("note"),
    )


def contract_rows(checked: DataFrame, keys: list[str], like: DataFrame) -> DataFrame:
    """A FONT_SIZE contract row for each scan with checked fields, in the columns of ``like``: the smallest height, and FAIL
    in its notes if any field is too small."""
    least = F.min_by(F.struct("measured_mm", "bbox"), F.struct("measured_mm", "field_name"))
    failed = F.coalesce(F.bool_or(~F.col("is_compliant")), F.lit(False))
    one = checked.groupBy(*keys).agg(least.alias("least"), failed.alias("failed"))
    value = {
        "field_name": F.lit("FONT_SIZE"), "raw_value": F.concat(F.format_string("%.3f", "least.measured_mm"), F.lit(" mm")), "confidence": F.lit(V.CONFIDENCE_VALUE["high"]),
        "method": F.lit("regex"), "notes": F.when(F.col("failed"), "FAIL").otherwise("PASS"), "bbox": F.col("least.bbox"),
    }
    return one.select(*keys, *(value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema if f.name not in keys))
