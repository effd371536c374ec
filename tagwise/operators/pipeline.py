"""From the tokens of a scan's images to its fields, violations and verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from . import extract, fontsize, merge, rules, secondpass

SCAN, IMAGE = ["scan_id"], ["scan_id", "image_index"]


def map_images(images: DataFrame, enrichment: DataFrame | None = None, as_of: str | None = None, keys: list[str] = IMAGE) -> DataFrame:
    """Fields of each image (keys, tokens): the first pass, replaced by what the second pass finds in the same row, and what
    is missing still filled from ``enrichment`` (keys, field, value; an image without rows there stays as it is)."""
    if enrichment is None:
        return secondpass.overridden(extract.map_tokens(images, keys, as_of=as_of), keys)
    rows = secondpass.with_given(images, enrichment, keys, X.parts_by_key(images))
    carried = [*keys, secondpass.GIVEN]
    return secondpass.enrich_given(secondpass.overridden(extract.map_tokens(rows, carried, as_of=as_of, spread=False), carried), keys)


@dataclass
class Checked:
    """``fields``: contract rows; ``merged``: the best image of each field; ``scores``: per scan.  All lazy: save ``merged``
    first if more than one of them is needed."""

    merged: DataFrame
    fields: DataFrame
    violations: DataFrame
    scores: DataFrame


def check(merged: DataFrame, calibrations: DataFrame | None = None, rule_rows: DataFrame | None = None, mandatory: tuple[str, ...] = V.MANDATORY) -> Checked:
    """Rules on the merged fields of scans; with ``calibrations`` letter heights are measured and judged."""
    fields = rules.contract(merged, SCAN)
    if calibrations is not None:
        fields = fields.unionByName(fontsize.contract_rows(fontsize.of_fields(fields, calibrations, SCAN), SCAN, fields))
    # every scan has contract rows, so that they are also the list of scans: the texts are read once for each result
    return Checked(merged, fields, rules.violations(fields, None, SCAN, rule_rows, mandatory), rules.scores_of_fields(fields, SCAN, rule_rows, mandatory))


def check_images(
    images: DataFrame, enrichment: DataFrame | None = None, calibrations: DataFrame | None = None, rule_rows: DataFrame | None = None, as_of: str | None = None,
    mandatory: tuple[str, ...] = V.MANDATORY,
) -> Checked:
    """Scans given as images (scan_id, image_index, tokens); null or empty tokens are an image without text."""
    merged = merge.merge_images(map_images(images, enrichment, as_of), SCAN, values=secondpass.VALUES)
    return check(merged, calibrations, rule_rows, mandatory)


def check_scans(texts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Violations and scores of scans given as one text each."""
    fields = rules.contract(extract.map_fields(texts, keys), keys)
    found = rules.violations(fields, texts, keys)
    return found, rules.scores(texts, found, keys)


def scan_rows(images: DataFrame, checked: Checked) -> DataFrame:
    """The rows that are stored for scans: verdict, texts of all images, fields as JSON, to be synchronised."""
    text = F.struct("image_index", X.joined_text(F.col("tokens")).alias("text"))
    texts = images.groupBy(*SCAN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("combined_text"))
    fields = extract.to_json(checked.merged, SCAN).withColumnRenamed("fields", "extracted_fields")
    rows = checked.scores.join(texts, SCAN, "left").join(fields, SCAN, "left")
    return rows.select(
        *SCAN, F.lit("completed").alias("status"), "is_compliant", F.col("score").alias("compliance_score"), "combined_text", "extracted_fields", F.lit("pending_sync").alias("sync_status")
    )
