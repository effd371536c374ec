"""Contract adaptation and rule evaluation: presence, formats, severities, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from . import spatial

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
# The texts of issues.
NO_TAXES = "MRP is present but does not declare 'inclusive of all taxes' as required"
NO_UNIT = "net_quantity is present but its unit could not be verified against standard metric units"
WRONG_UNIT = ("net_quantity unit '", "' is not a standard metric unit (expected one of: ", ")")
TOO_SMALL = ("Text height (", ") is below the required statutory minimum.")
NOT_MEASURED = "Rule 9 Font Calibration is pending or could not be auto-detected (requires manual coin tap)."
MISSING = ("'", "' is missing from the label")
CATEGORY = "TEXT_CONTENT"


def contract(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Five contract rows per key (missing ones empty) plus the constant commodity and country rows.

    ``mapped``: long rows of :func:`tagwise.operators.extract.map_fields`, optionally with ``method``, ``bbox`` (polygons,
    of which the rectangle around all is kept) and ``image_index``."""
    name = X.lookup(V.CONTRACT_NAMES, F.col("field"))
    method = F.col("method") if "method" in mapped.columns else F.lit(None).cast("string")
    box = spatial.merged_box(F.col("bbox")) if "bbox" in mapped.columns else F.lit(None).cast(BOX)
    image = F.col("image_index").cast("int") if "image_index" in mapped.columns else F.lit(None).cast("int")
    present = ~X.all_null(*(f"v_{k}" for k in ("amount", "text", "date", "phone", "email")))
    own = F.struct(
        name.alias("field_name"),
        F.when(present, F.col("raw_evidence")).alias("raw_value"),
        F.col("v_amount").alias("amount"),
        F.col("v_unit").alias("unit"),
        F.when(present, F.coalesce(X.lookup(V.CONFIDENCE_VALUE, F.col("confidence")), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(~present, "none").otherwise(F.coalesce(method, F.lit("regex"))).alias("method"),
        F.lit(None).cast("string").alias("notes"),
        box.cast(BOX).alias("bbox"),
        image.alias("image_index"),
    )

    def constant(field: str, value: str | None) -> Column:
        empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("amount", "double"), ("unit", "string"), ("notes", "string"), ("bbox", BOX), ("image_index", "int"))}
        how = F.lit("none" if value is None else "regex").alias("method")
        return F.struct(F.lit(field).alias("field_name"), F.lit(value).cast("string").alias("raw_value"), empty["amount"], empty["unit"], F.lit(0.0).alias("confidence"), how, empty["notes"], empty["bbox"], empty["image_index"])

    # the constant rows come with the first field of each key, so that the fields are computed once
    extra = F.when(F.col("field") == V.FIELDS[0], F.array(own, constant("commodity_name", "Packaged Product"), constant("country_of_origin", None))).otherwise(F.array(own))
    return mapped.select(*keys, F.explode_outer(extra).alias("r")).select(*keys, "r.*").where("field_name IS NOT NULL")


def rules(spark: SparkSession) -> DataFrame:
    """The built-in rule table; see :func:`tagwise.sources.read_rules` for one from a file."""
    rows = [(r, c, f, s, V.PENALTY, V.VALID_UNITS if f == "net_quantity" else None, None) for r, c, f, s in V.RULES]
    return spark.createDataFrame(rows, "rule_id string, clause string, field string, severity string, penalty_ref string, valid_units array<string>, regex_pattern string")


def severity(rule_severity: Column) -> Column:
    return F.coalesce(X.lookup(V.SEVERITY, F.upper(rule_severity)), F.lit("critical"))


def legal_reference(clause: Column, penalty: Column) -> Column:
    return F.when(clause.isNotNull() & penalty.isNotNull(), F.concat(clause, F.lit(" -- "), penalty)).otherwise(clause)


def is_present() -> Column:
    return F.col("raw_value").isNotNull() & (F.col("method") != "none")


def violations(fields: DataFrame, scans: DataFrame | None, keys: list[str], rule_rows: DataFrame | None = None, mandatory: tuple[str, ...] = V.MANDATORY) -> DataFrame:
    """One row per broken rule.  ``fields``: contract rows; ``scans``: all keys, so that a scan without fields counts; None if
    each has some.

    ``image_index`` is the image that the field was taken from, ``measured_value`` what was measured if it is too small.  One
    aggregation of the contract rows per scan gathers present names and wrong formats; the gaps are an array difference.  The
    built-in rules are broadcast; a table of rules is left to the optimizer, which does so by its size."""
    return _violations(fields, scans, keys, rule_rows, mandatory, F.explode)


def _violations(fields: DataFrame, scans: DataFrame | None, keys: list[str], rule_rows: DataFrame | None, mandatory: tuple[str, ...], explode) -> DataFrame:
    rule = (rule_rows if rule_rows is not None else F.broadcast(rules(fields.sparkSession))).select(
        F.lower("field").alias("rule_field"), "clause", "penalty_ref", F.col("severity").alias("rule_severity"), "valid_units", "regex_pattern"
    )
    with_rule = lambda df: df.join(rule, F.lower("field_name") == F.col("rule_field"), "left")
    unit, name = F.lower("unit"), F.col("field_name")
    small = (name == "FONT_SIZE") & F.col("notes").contains("FAIL")
    said = lambda parts, *values: F.concat(*(x for pair in zip(map(F.lit, parts), [*values, F.lit("")], strict=True) for x in pair))
    issue = (
        F.when((name == "mrp") & F.col("regex_pattern").isNotNull() & ~F.expr(f"raw_value RLIKE concat('{X.FLAGS}', regex_pattern)"), NO_TAXES)
        .when((name == "net_quantity") & F.col("valid_units").isNotNull() & F.col("unit").isNull(), NO_UNIT)
        .when((name == "net_quantity") & ~F.array_contains("valid_units", unit), said(WRONG_UNIT, unit, F.array_join("valid_units", ", ")))
        .when(small, said(TOO_SMALL, F.col("raw_value")))
    )
    if "image_index" not in fields.columns:
        fields = fields.withColumns({"image_index": F.lit(None).cast("int"), "bbox": F.lit(None).cast(BOX)})
    here = with_rule(fields).withColumn("issue", F.when(is_present(), issue))
    place = F.struct("field_name", "image_index")
    wrong = F.struct("field_name", "issue", "image_index", "bbox", F.when(small, F.col("raw_value")).alias("measured_value"))
    kind = f"array<struct<field_name:string,issue:string,image_index:int,bbox:{BOX},measured_value:string>>"
    gathered = here.groupBy(*keys).agg(
        F.collect_set(F.when(is_present(), F.col("field_name"))).alias("have"),
        F.collect_list(F.when(F.col("issue").isNotNull(), wrong)).cast(kind).alias("wrong"),
        F.collect_list(F.when(F.col("image_index").isNotNull(), place)).alias("places"),
    )
    nothing = lambda kind: F.array().cast(kind)
    gaps = F.array_except(F.array(*map(F.lit, mandatory)), F.coalesce("have", nothing("array<string>")))

    def absent(f: Column) -> Column:
        image = F.get(F.filter("places", lambda p: p["field_name"] == f), F.lit(0))["image_index"]
        empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("issue", "string"), ("bbox", BOX), ("measured_value", "string"))}
        return F.struct(f.alias("field_name"), empty["issue"], image.alias("image_index"), empty["bbox"], empty["measured_value"])

    every = F.concat(F.transform(gaps, absent).cast(kind), F.coalesce("wrong", nothing(kind)))
    of_scans = gathered if scans is None else scans.select(*keys).join(gathered, keys, "left")
    rows = of_scans.select(*keys, explode(every).alias("v")).select(*keys, "v.*")
    missing = F.when(F.col("field_name") == "FONT_SIZE", NOT_MEASURED).otherwise(said(MISSING, F.col("field_name")))
    reference = F.when(F.col("issue").isNull(), F.col("clause")).otherwise(legal_reference(F.col("clause"), F.col("penalty_ref")))
    return with_rule(rows).select(
        *keys, "field_name", F.coalesce("issue", missing).alias("issue"), severity(F.col("rule_severity")).alias("severity"), reference.alias("legal_reference"),
        F.lit(CATEGORY).alias("violation_category"), "measured_value", "bbox", "image_index",
    )


def _deduction() -> Column:
    return F.coalesce(X.lookup(V.DEDUCTION, F.col("severity")), F.lit(0))


def scores(scans: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per scan: violations, score (100 less deductions, 0 at least) and verdict; clean scans have 100."""
    lost = found.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(_deduction()).alias("lost"))
    return _verdicts(scans.select(*keys).join(lost, keys, "left"), keys)


def scores_of_fields(fields: DataFrame, keys: list[str], rule_rows: DataFrame | None = None, mandatory: tuple[str, ...] = V.MANDATORY) -> DataFrame:
    """As :func:`scores` of all scans that have contract rows, without a list of them."""
    broken = F.col("field_name").isNotNull()  # a clean scan has one row without a violation
    found = _violations(fields, None, keys, rule_rows, mandatory, F.explode_outer)
    return _verdicts(found.groupBy(*keys).agg(F.count_if(broken).alias("n"), F.sum(F.when(broken, _deduction())).alias("lost")), keys)


def _verdicts(lost: DataFrame, keys: list[str]) -> DataFrame:
    n = F.coalesce("n", F.lit(0)).cast("long")
    return lost.select(*keys, n.alias("n_violations"), F.greatest(F.lit(0.0), 100.0 - F.coalesce("lost", F.lit(0))).alias("score"), (n == 0).alias("is_compliant"))
