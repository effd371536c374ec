"""Certificate rows and the text forms of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value, "[^\\x00-\\xFF]", "?"), F.lit("N/A"))


def format_mrp(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Rs. "), F.format_string("%.2f", value)), F.lit("N/A"))


def format_quantity(amount: Column, unit: Column) -> Column:
    """The amount to six significant digits, without needless zeros and with an exponent below 1e-4 and from 1e6 on, and
    its unit."""
    exponent = F.regexp_extract(F.format_string("%.5e", amount), "e([+-][0-9]+)$", 1).try_cast("int")
    zeros = lambda c: F.regexp_replace(F.regexp_replace(c, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    mantissa = zeros(F.regexp_extract(F.format_string("%.5e", amount), "^(-?[0-9.]+)e", 1))
    sign = F.when(exponent < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    places = 5 - exponent
    plain = F.lit(None).cast("string")
    for k in range(10):  # exponents -4 to 5
        plain = F.when(places == k, zeros(F.format_string(f"%.{k}f", amount))).otherwise(plain)
    number = F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)
    return F.coalesce(F.concat(number, F.lit(" "), unit), F.lit("N/A"))


def format_date(value: Column) -> Column:
    return safe(value)


def format_manufacturer(value: Column) -> Column:
    return safe(F.when(F.length(value) > 60, F.concat(F.substring(value, 1, 57), F.lit("..."))).otherwise(value))


def commodity(name: Column) -> Column:
    return F.coalesce(name, F.lit("Packaged Product"))


def certificate_number(key: Column) -> Column:
    return F.concat(F.lit("CERT-"), F.upper(F.substring(key, 1, 8)))


def report_number(key: Column, created: Column) -> Column:
    return F.concat(F.lit("CR-"), F.year(created).cast("string"), F.lit("-"), F.upper(F.substring(key, 1, 8)))


def verdict(compliant: Column) -> Column:
    return F.when(compliant, "PASS").otherwise("FAIL")


def format_score(value: Column) -> Column:
    """Without decimals; halves go to the even neighbour."""
    return F.coalesce(F.bround(value, 0).cast("long").cast("string"), F.lit("N/A"))


def certificates(scans: DataFrame, violations: DataFrame, key: str = "scan_key") -> DataFrame:
    """A certificate for each scan (scan_id, ``key``, created_at, is_compliant, compliance_score, product_name): numbers, date,
    verdict, score, commodity, and its violations as lines in order of their fields; empty for a scan without any."""
    lines = violations.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "severity", "issue"))).alias("__v"))
    none = F.array().cast("array<string>")
    return scans.join(lines, "scan_id", "left").select(
        "scan_id", certificate_number(F.col(key)).alias("certificate"), report_number(F.col(key), F.col("created_at")).alias("report"), F.date_format("created_at", "dd-MM-yyyy").alias("issued"),
        verdict(F.col("is_compliant")).alias("verdict"), format_score(F.col("compliance_score")).alias("score"), safe(commodity(F.col("product_name"))).alias("commodity"),
        F.coalesce(violation_lines(F.col("__v")), none).alias("violations"),
    )


def violation_lines(violations: Column) -> Column:
    return F.transform(violations, lambda v: F.concat(F.lit("["), F.upper(v["severity"]), F.lit("] "), v["field_name"], F.lit(": "), v["issue"]))
