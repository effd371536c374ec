"""Questions about stored scans and violations, and changes to them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEX = re.compile(r"(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?", re.IGNORECASE)


def _of_officer(scans: DataFrame, officer: str | int | None) -> Column | None:
    """The scans of one officer; None, so all scans, for no id or one that can't be an id: not a number where ids are
    numbers, not a UUID in any spelling where they are texts."""
    text = str(officer if officer is not None else "").strip()
    if scans.schema["officer_id"].dataType.typeName() != "string":
        return F.col("officer_id") == int(text) if re.fullmatch(r"-?\d+", text) else None
    m = _HEX.fullmatch(text)
    return F.lower(F.replace("officer_id", F.lit("-"), F.lit(""))) == "".join(m.groups()).lower() if m else None


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.bround(part * 100.0 / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))


def metrics(scans: DataFrame, violations: DataFrame, officer: str | int | None = None) -> DataFrame:
    """Total, pass rate and most frequent violation (of equally frequent ones the first by name); the join is there only if
    an officer is given."""
    if (own := _of_officer(scans, officer)) is not None:
        scans = scans.where(own)
        violations = violations.join(scans.select("scan_id"), "scan_id")
    totals = scans.agg(F.count("*").alias("total"), F.count_if("is_compliant").alias("compliant"))
    top = violations.groupBy("field_name").count().orderBy(F.desc("count"), "field_name").limit(1).select(F.col("field_name").alias("top_violation"))
    one = totals.join(top, F.lit(True), "left")  # one row each
    return one.select(
        "total",
        _percent(F.col("compliant"), F.col("total")).alias("pass_rate"),
        F.when(F.col("total") == 0, "None").otherwise(F.coalesce("top_violation", F.lit("None"))).alias("top_violation"),
    )


def metrics_by_officer(scans: DataFrame, violations: DataFrame) -> DataFrame:
    totals = scans.groupBy("officer_id").agg(F.count("*").alias("total"), F.count_if("is_compliant").alias("compliant"))
    counts = violations.join(scans.select("scan_id", "officer_id"), "scan_id").groupBy("officer_id", "field_name").count()
    first = Window.partitionBy("officer_id").orderBy(F.desc("count"), "field_name")
    top = counts.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("officer_id", F.col("field_name").alias("top_violation"))
    return totals.join(top, "officer_id", "left").select("officer_id", "total", _percent(F.col("compliant"), F.col("total")).alias("pass_rate"), F.coalesce("top_violation", F.lit("None")).alias("top_violation"))


def history(scans: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    named = F.coalesce("product_name", F.lit("Unregistered Product"))
    return scans.orderBy(F.desc("created_at"), "scan_id").offset(offset).limit(limit).withColumn("product_name", named)


def latest(scans: DataFrame, officer: str | int | None = None) -> DataFrame:
    """The newest scan; of equally new ones the least id.  One row, null without scans."""
    own = _of_officer(scans, officer)
    rows = scans if own is None else scans.where(own)
    age = -F.unix_micros(F.col("created_at").cast("timestamp"))
    return rows.agg(F.min_by("scan_id", F.struct(age.alias("age"), "scan_id")).alias("scan_id"))


def detail(scans: DataFrame, violations: DataFrame, scan: Column | None = None) -> DataFrame:
    """Scans with their violations nested, sorted."""
    rows = scans if scan is None else scans.where(scan)
    children = violations.join(rows.select("scan_id"), "scan_id", "left_semi").groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "severity", "issue"))).alias("violations"))
    empty = F.array().cast("array<struct<field_name:string,severity:string,issue:string>>")
    return rows.join(children, "scan_id", "left").withColumn("violations", F.coalesce("violations", empty))


def prefix_lookup(scans: DataFrame, number: str, key: str = "scan_key") -> DataFrame:
    """Scans whose id starts with a certificate number without its CERT- or CR- lead, and how many there are.

    The count comes from a second, narrow scan: a window over all matches would put them into one task."""
    prefix = number.upper().replace("CERT-", "").replace("CR-", "").strip()
    found = scans.where(F.upper(key).startswith(prefix))
    return found.crossJoin(found.agg(F.count("*").alias("match_count")))  # one row


def image_paths(value: Column) -> Column:
    """A JSON list, a JSON text or a bare path, as a list."""
    many = F.try_parse_json(value)
    return F.coalesce(F.try_variant_get(many, "$", "array<string>"), F.when(value.isNotNull(), F.array(F.coalesce(F.try_variant_get(many, "$", "string"), value))))


def apply_overrides(violations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Last override per scan and rule: PASS removes the violation, FAIL adds it or replaces its issue."""
    last = Window.partitionBy("scan_id", "field_name").orderBy(F.desc("seq"))
    newest = overrides.withColumnRenamed("rule_key", "field_name").withColumn("rn", F.row_number().over(last)).where("rn = 1").select("scan_id", "field_name", "status", "evidence")
    joined = violations.join(newest, ["scan_id", "field_name"], "full")
    added = F.col("issue").isNull()
    return joined.where("status IS NULL OR status <> 'PASS'").select(
        "scan_id", "field_name", F.coalesce("evidence", "issue").alias("issue"), F.when(added, "HIGH").otherwise(F.col("severity")).alias("severity"), F.col("status").isNotNull().alias("overridden")
    )


def apply_overrides_to_fields(fields: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Rows (keys, field, value, confidence) after the last override of each rule: PASS sets the evidence as a sure value,
    FAIL takes the value away; ``manual_override`` is the status.  Rules that have no row get one."""
    newest = overrides.groupBy(*keys, F.col("rule_key").alias("field")).agg(F.max_by(F.struct("status", "evidence"), "seq").alias("o"))
    passed, touched = F.col("o.status") == "PASS", F.col("o").isNotNull()
    value = F.when(touched, F.when(passed, F.col("o.evidence"))).otherwise(F.col("value"))
    sure = F.when(touched, F.when(passed, "high").otherwise("none")).otherwise(F.col("confidence"))
    return fields.join(newest, [*keys, "field"], "full").select(*keys, "field", value.alias("value"), sure.alias("confidence"), F.col("o.status").alias("manual_override"))


def apply_verdicts(scans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Score and verdict as an override gives them; ``verdicts``: scan_id, score, is_compliant, seq; the last counts."""
    last = verdicts.groupBy("scan_id").agg(F.max_by(F.struct(F.col("score").cast("double").alias("score"), "is_compliant"), "seq").alias("__v"))
    given = F.col("__v").isNotNull()
    return scans.join(last, "scan_id", "left").withColumns(
        {"compliance_score": F.when(given, F.col("__v.score")).otherwise(F.col("compliance_score")), "is_compliant": F.when(given, F.col("__v.is_compliant")).otherwise(F.col("is_compliant"))}
    ).drop("__v")


def pending(scans: DataFrame) -> DataFrame:
    """Scans that still have to be sent, in the shape that is sent."""
    return scans.where("sync_status = 'pending_sync'").select("scan_id", "officer_id", "is_compliant", "compliance_score", "created_at")


def mark_synced(scans: DataFrame, sent: DataFrame) -> DataFrame:
    done = sent.select("scan_id").distinct().withColumn("__sent", F.lit(True))
    return scans.join(done, "scan_id", "left").withColumn("sync_status", F.when(F.col("__sent"), "synced").otherwise(F.col("sync_status"))).drop("__sent")


def set_calibration(scans: DataFrame, results: DataFrame) -> DataFrame:
    """``results``: scan_id, passed.  Unknown scans are ignored."""
    r = results.select("scan_id", F.col("passed").alias("__p"))
    known = F.col("__p").isNotNull()
    verdict = F.when(F.col("__p"), "pass").otherwise("fail")
    return scans.join(r, "scan_id", "left").withColumns(
        {"calibrator_used": known | F.col("calibrator_used"), "calibrator_result": F.when(known, verdict).otherwise(F.col("calibrator_result"))}
    ).drop("__p")


def add_missing(existing: DataFrame, seed: DataFrame, key: str = "email") -> DataFrame:
    """Existing rows and those of ``seed`` whose key is new."""
    return existing.unionByName(seed.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def with_officer(scans: DataFrame, users: DataFrame) -> DataFrame:
    label = F.concat("name", F.lit(", "), "role", F.lit(" ("), F.col("user_key").cast("string"), F.lit(")"))
    return scans.join(users.withColumnRenamed("officer_id", "user_key"), F.col("officer_id") == F.col("user_key"), "left").withColumn("officer", F.coalesce(label, F.lit("N/A")))


def with_address(scans: DataFrame, places: DataFrame, digits: int = 3) -> DataFrame:
    """Stored address, else that of the rounded coordinates; ``places``: lat, lon (rounded), address."""
    p = places.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("address").alias("__a"))
    on = (F.round("latitude", digits) == F.col("__lat")) & (F.round("longitude", digits) == F.col("__lon"))
    return scans.join(p, on, "left").withColumn("location_address", F.coalesce("location_address", "__a")).drop("__lat", "__lon", "__a")
