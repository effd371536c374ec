"""Tables that the library reads and writes: explicit schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "struct<text:string,bbox:array<array<double>>,confidence:double,language:string>"
TOKENS_SCHEMA = f"scan_id bigint, image_index int, tokens array<{TOKEN}>"
LABELS_SCHEMA = "image string, MRP string, NET_QUANTITY string, MANUFACTURER_ADDRESS string, MANUFACTURING_DATE string, CONSUMER_CARE string"
FONT_SCHEMA = "image string, tap_point array<int>, coin_key string, ocr_bbox array<int>, ground_truth_mm double"
RULES_SCHEMA = (
    "rules array<struct<rule_id:string,clause:string,field:string,description:string,mandatory:boolean,severity:string,penalty_ref:string,check_target:string,"
    "valid_units:array<string>,regex_pattern:string,calibration_slabs:array<struct<max_capacity:string,min_height_mm:double>>>>"
)
EXTRACTION_SCHEMA = "MRP string, NET_QUANTITY string, MANUFACTURER_ADDRESS string, MANUFACTURING_DATE string, CONSUMER_CARE string"
SCANS_SCHEMA = (
    "scan_id bigint, product_id string, officer_id string, image_paths string, status string, is_compliant boolean, compliance_score double, raw_ocr string,"
    " extracted_fields string, sync_status string, latitude double, longitude double, location_address string, calibrator_used boolean, calibrator_result string, created_at timestamp"
)
VIOLATIONS_SCHEMA = (
    "scan_id bigint, field_name string, issue string, severity string, violation_category string, measured_value string, bbox string, legal_reference string, image_index int, created_at timestamp"
)
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif"}


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of OCR tokens per scan and image; malformed lines become null rows and are dropped."""
    return spark.read.schema(TOKENS_SCHEMA).option("mode", "PERMISSIVE").json(path).where("scan_id IS NOT NULL")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as bytes with their MIME type; unknown suffixes have none."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return spark.read.format("binaryFile").load(path).withColumn("mime", mime_type(kind))


def mime_type(suffix: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), suffix)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RULES_SCHEMA).option("multiLine", True).json(path).select(F.explode("rules").alias("r")).select("r.*")
    return rows.withColumn("field", F.lower("field"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS_SCHEMA).option("multiLine", True).json(path)


def read_font_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FONT_SCHEMA).option("multiLine", True).json(path)


def parse_extraction(response: Column) -> Column:
    """struct of five fields from a model's answer: a code fence is stripped; null unless all five keys are there."""
    body = F.regexp_replace(F.regexp_replace(F.trim(response), "^```[A-Za-z]*\\s*", ""), "\\s*```$", "")
    keys = F.json_object_keys(F.when(F.try_parse_json(body).isNotNull(), body))
    wanted = F.array(*(F.lit(x.split()[0]) for x in EXTRACTION_SCHEMA.split(", ")))
    return F.when(F.size(F.array_except(wanted, keys)) == 0, F.from_json(body, EXTRACTION_SCHEMA))


def detections_to_tokens(detections: Column) -> Column:
    """Detections (text, polygon, confidence) to tokens; those without text or polygon are skipped."""
    some = F.filter(detections, lambda d: d["text"].isNotNull() & d["bbox"].isNotNull())
    return F.transform(some, lambda d: F.struct(d["text"].cast("string").alias("text"), d["bbox"].alias("bbox"), d["confidence"].try_cast("double").alias("confidence"), F.lit("en").alias("language")))


def tokens_to_json(tokens: Column) -> Column:
    """Tokens as a JSON text, as a recognizer hands them over."""
    return F.to_json(tokens, {"ignoreNullFields": "false"})


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str) -> None:
    """Add rows; columns that the table has and ``df`` lacks are null."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
        return
    empty = spark.createDataFrame([], spark.read.parquet(path).schema)
    empty.unionByName(df, allowMissingColumns=True).write.mode("append").parquet(path)


def save_scans(scans: DataFrame, violations: DataFrame, path: str) -> None:
    """One batch of scans and violations, keyed by scan_id."""
    append(scans, f"{path}/scans")
    append(violations, f"{path}/violations")


def wipe(spark: SparkSession, path: str) -> None:
    """Empty the scan tables, keep users."""
    for name, schema in (("violations", VIOLATIONS_SCHEMA), ("scans", SCANS_SCHEMA)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
