"""All queries of this library over the driver's tables, and their SQL twins.

Label texts are rendered from the tables; the SQL computes what they should yield from the source columns directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import evaluate, extract, fontsize, merge, pipeline, report, rules, secondpass, spatial, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _fixed(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _best(name: str) -> Column:
    return F.col("best")[name]


# --- extraction


@query("SELECT p_partkey, round(p_retailprice, 2) AS amount, 1.0::DOUBLE AS score, 'high' AS confidence, 'MRP' AS label_matched FROM part")
def extract_mrp(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", _text("Fine goods M.R.P Rs. ", _fixed(F.col("p_retailprice")), "/- incl. of all taxes").alias("text"))
    out = extract.resolve(rows, "MRP")
    return out.select("p_partkey", _best("amount").alias("amount"), _best("score").alias("score"), "confidence", _best("label_matched").alias("label_matched"))


@query("""SELECT p_partkey, p_size::DOUBLE AS amount, CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' ELSE 'pieces' END AS unit,
  CASE WHEN p_partkey % 5 = 0 THEN 0.98 ELSE 1.0 END::DOUBLE AS score FROM part""")
def extract_net_quantity(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("g", "kilograms", "ml", "pcs"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    colon = F.when(F.col("p_partkey") % 5 == 0, ":").otherwise("")
    rows = _read(spark, sf_dir, "part").select("p_partkey", _text("Net Qty", colon, " ", F.col("p_size").cast("string"), " ", unit, " Protein 3 g").alias("text"))
    return extract.resolve(rows, "NET_QUANTITY").select("p_partkey", _best("amount").alias("amount"), _best("unit").alias("unit"), _best("score").alias("score"))


@query("SELECT s_suppkey, s_name || ', ' || n_name AS manufacturer, 'high' AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def extract_manufacturer(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    rows = rows.select("s_suppkey", _text("MRP 20 Manufactured by: ", F.col("s_name"), ", ", F.col("n_name"), " Net Qty 5 g").alias("text"))
    return extract.resolve(rows, "MANUFACTURER_ADDRESS").select("s_suppkey", _best("text").alias("manufacturer"), "confidence")


_DATE_FORM = "(l_orderkey + l_linenumber) % 6"


@query(f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
  CASE {_DATE_FORM} WHEN 3 THEN '20' || strftime(l_shipdate, '%y-%m-%d') WHEN 4 THEN strftime(l_shipdate, '%Y-%m') WHEN 5 THEN '20' || strftime(l_shipdate, '%y-%m')
    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS mfg_date,
  CASE WHEN {_DATE_FORM} >= 3 THEN 'low' ELSE 'high' END AS confidence FROM lineitem""")
def extract_mfg_date(spark, sf_dir):
    d = lambda f: F.date_format("l_shipdate", f)
    form = F.expr(_DATE_FORM)
    text = (
        F.when(form == 0, _text("Mfg Date ", d("dd/MM/yyyy")))
        .when(form == 1, _text("MFD ", d("yyyy-MM-dd")))
        .when(form == 2, _text("Pkd. Date ", F.upper(d("dd MMM yyyy"))))
        .when(form == 3, _text("MFD: ", d("dd.MM.yy")))
        .when(form == 4, _text("Packed On ", d("MM/yyyy")))
        .otherwise(_text("MFG ", d("MM/yy"), "-12/99"))
    )
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", _text(text, " Batch No. 12").alias("text"))
    return extract.resolve(rows, "MANUFACTURING_DATE").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", _best("date").alias("mfg_date"), "confidence")


@query("""SELECT s_suppkey, '1800-' || (100 + s_suppkey % 900) || '-' || (1000 + s_suppkey % 9000) AS phone,
  CASE WHEN s_suppkey % 3 > 0 THEN 'care' || s_suppkey || '@example.com' END AS email, CASE WHEN s_suppkey % 3 > 0 THEN 'high' ELSE 'low' END AS confidence FROM supplier""")
def extract_consumer_care(spark, sf_dir):
    k = F.col("s_suppkey")
    phone = _text("1800-", (100 + k % 900).cast("string"), "-", (1000 + k % 9000).cast("string"))
    email = F.when(k % 3 > 0, _text(" care", k.cast("string"), " @ example . com")).otherwise("")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", _text("Customer Care No. ", phone, email).alias("text"))
    return extract.resolve(rows, "CONSUMER_CARE").select("s_suppkey", _best("phone").alias("phone"), _best("email").alias("email"), "confidence")


@query("SELECT doc_id, nullif(regexp_extract(text, '(?i)\\b[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}\\b'), '') AS email FROM documents")
def document_contacts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", secondpass.normalize_care(F.col("text"))["email"].alias("email"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS amount, 1::BIGINT AS n_candidates FROM part")
def offer_price_suppressed(spark, sf_dir):
    text = _text("MRP Offer Price Rs ", F.col("p_size").cast("string"), ".00 MRP Rs ", _fixed(F.col("p_retailprice")))
    rows = _read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return extract.resolve(rows, "MRP").select("p_partkey", _best("amount").alias("amount"), F.size("candidates").cast("long").alias("n_candidates"))


@query("SELECT p_partkey, 10.0::DOUBLE AS amount, p_size % 2 = 1 AS ambiguous FROM part")
def ambiguous_candidates(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", _text("MRP Rs 10.00 MRP Rs ", (10 + F.col("p_size") % 2).cast("string"), ".00").alias("text"))
    return extract.resolve(rows, "MRP").select("p_partkey", _best("amount").alias("amount"), "ambiguous")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NEGATIVE_OR_SIGNED_REJECTED' WHEN 1 THEN 'TRAILING_ALPHA_REJECTED' WHEN 2 THEN 'MALFORMED_NUMERIC_REJECTED' END AS reason,
  'none' AS confidence FROM part""")
def rejected_prices(spark, sf_dir):
    """Prices that don't count, and why; a price behind a bounding word is no candidate at all."""
    n = F.col("p_size").cast("string")
    forms = F.array(_text("MRP Rs -", n, ".00"), _text("MRP Rs ", n, "abc"), _text("MRP Rs 1,23,", F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")), _text("MRP Offer Rs ", n))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int")).alias("text"))
    out = extract.resolve(rows, "MRP")
    return out.select("p_partkey", F.get(F.get("candidates", F.lit(0))["reason_codes"], F.lit(1)).alias("reason"), "confidence")


@query("SELECT p_partkey, round(p_retailprice, 2) AS price, p_size::DOUBLE AS amount, 'g' AS unit FROM part")
def unicode_blanks(spark, sf_dir):
    """Labels and values set with no-break blanks."""
    text = _text("MRP\u00a0Rs\u00a0", _fixed(F.col("p_retailprice")), " Net\u00a0Qty\u2003", F.col("p_size").cast("string"), "\u00a0g")
    found = extract.map_fields(_read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"])
    return _wide(found, {"price": ("MRP", "v_amount"), "amount": ("NET_QUANTITY", "v_amount"), "unit": ("NET_QUANTITY", "v_unit")})


def _wide(found: DataFrame, columns: dict[str, tuple[str, str]], key: str = "p_partkey") -> DataFrame:
    """One row per key from long rows of fields."""
    return found.groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.col(c))).alias(n) for n, (f, c) in columns.items()))


#: Texts (``@``: a number, ``#``: it in two digits), the price found and how sure it is, and the quantity found.
_MIXED = [
    ("MRP ₹@49 | Offer ₹199 | Save ₹50 | Net Qty @ g", "n * 100 + 49", "high", "n", "g"),
    ("MRP ₹0 Offer Price ₹199 Net Qty 0 g Protein 5 g", "NULL", "none", "NULL", None),
    ("Net Quantity @ kg MRP: INR 1,0#.50", "1000.5 + n", "high", "n", "kg"),
    ("MRP ₹@49-abc Net Qty 1.2.3 g", "NULL", "none", "NULL", None),
    ("Net Qty 1,23,45,678 g MRP Rs 1,23,45,678", "12345678", "low", "12345678", "g"),
    ("Net Qty 12,3456 g MRP Rs 12,3456", "NULL", "none", "NULL", None),
    ("Protein 5 g Serving Size 30 g Net Wt. @ g", "NULL", "none", "n", "g"),
    ("MRP -@.00 Net Qty +@ g", "NULL", "none", "NULL", None),
    ("m.r.p. rs. @/- only NET WT @ ML", "n", "high", "n", "ml"),
    ("अधिकतम खुदरा मूल्य ₹ @ Contents: @ tablets", "n", "high", "n", "tablets"),
    ("MRP @ Servings 5 g", "n", "low", "NULL", None),
    ("MRP ? @.00 Weight @ Kilograms", "n", "low", "n", "kg"),
    ("Offer Price ₹9 MRP\nRs . @.50\nNet Vol. @ litres", "n + 0.5", "high", "n", "l"),
    ("Maximum Retail Price see R= .@. 50 Pack of 3 pieces", "n + 0.5", "low", "NULL", None),
]


def _case(column: int, quote: bool) -> str:
    value = lambda v: "NULL" if v is None else f"'{v}'" if quote else v
    return "CASE p_partkey % " + str(len(_MIXED)) + "".join(f" WHEN {i} THEN {value(m[column])}" for i, m in enumerate(_MIXED)) + " END"


@query(f"""WITH p AS (SELECT p_partkey, 10 + p_size % 90 AS n FROM part)
SELECT p_partkey, ({_case(1, False)})::DOUBLE AS price, {_case(2, True)} AS confidence, ({_case(3, False)})::DOUBLE AS amount, ({_case(4, True)})::VARCHAR AS unit FROM p""")
def mixed_labels(spark, sf_dir):
    """Several prices, quantities and bounding words on one label, malformed and damaged ones among them."""
    n = (10 + F.col("p_size") % 90).cast("string")
    form = F.element_at(F.array(*(F.lit(m[0]) for m in _MIXED)), (F.col("p_partkey") % len(_MIXED) + 1).cast("int"))
    text = F.replace(F.replace(form, F.lit("@"), n), F.lit("#"), n)
    found = extract.map_fields(_read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"])
    return _wide(found, {"price": ("MRP", "v_amount"), "confidence": ("MRP", "confidence"), "amount": ("NET_QUANTITY", "v_amount"), "unit": ("NET_QUANTITY", "v_unit")})


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS mfg_date, CASE WHEN o_orderdate >= TIMESTAMP '1995-06-18' THEN 'low' ELSE 'high' END AS confidence FROM orders")
def future_dates(spark, sf_dir):
    """Dates after a given day are not trusted."""
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", _text("MFD ", F.date_format("o_orderdate", "dd/MM/yyyy")).alias("text"))
    out = extract.resolve(rows, "MANUFACTURING_DATE", as_of="1995-06-17")
    return out.select("o_orderkey", _best("date").alias("mfg_date"), "confidence")


@query(f"""SELECT * FROM (VALUES {", ".join(f"('{f}', {len(v)}::BIGINT, '{v[0][1]}')" for f, v in V.LABELS.items())}) t(field, n_labels, first_label)""")
def label_keywords(spark, sf_dir):
    return extract.keywords(spark).groupBy("field").agg(F.count("*").alias("n_labels"), F.min_by("label", "label_ord").alias("first_label"))


@query("""SELECT p_partkey, '{"MRP":{"v_amount":' || p_size || '.5,"confidence":"high"},"NET_QUANTITY":{"confidence":"none"}}' AS fields FROM part""")
def mapped_json(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", _text("MRP Rs ", F.col("p_size").cast("string"), ".50").alias("text"))
    found = extract.map_fields(rows, ["p_partkey"]).where("field IN ('MRP', 'NET_QUANTITY')").select("p_partkey", "field", "v_amount", "confidence")
    return extract.to_json(found, ["p_partkey"])


def _tokens(words: Column) -> Column:
    """Words as OCR tokens."""
    none = F.lit(None).cast("array<array<double>>")
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), none.alias("bbox"), (0.3 + (i % 2) * 0.4).cast("double").alias("confidence"), F.when(i % 3 == 2, "hi").otherwise("en").alias("language")))


_WORDS = """WITH w AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))),
t AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM w)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents as the tokens of a page."""
    rows = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _tokens(F.split("text", " ")).alias("tokens"))
    return X.spread(rows).select("doc_id", X.token_index(F.col("tokens")).alias("t"))


@query(f"""{_WORDS} SELECT doc_id, i - 1 AS token_index, (stop - 1 - length(x))::BIGINT AS token_start, (stop - 1)::BIGINT AS token_end FROM t""")
def token_offsets(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.explode_outer("t").alias("t")).select(
        "doc_id", F.col("t.i").cast("long").alias("token_index"), F.col("t.start").cast("long").alias("token_start"), F.col("t.end").cast("long").alias("token_end")
    )


@query(f"""{_WORDS} SELECT doc_id, coalesce(string_agg(x, '|' ORDER BY i) FILTER (stop - 1 > 40 AND stop - 1 - length(x) < 90), '') AS evidence,
  round(avg(CASE WHEN i % 2 = 0 THEN 0.7 ELSE 0.3 END) FILTER (stop - 1 > 40 AND stop - 1 - length(x) < 90), 6) AS confidence FROM t GROUP BY doc_id""")
def span_overlap(spark, sf_dir):
    rows = _words(spark, sf_dir).select("doc_id", X.supporting(F.col("t"), F.lit(40), F.lit(90)).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda t: t["text"]), "|").alias("evidence"), F.round(X.mean_confidence(F.col("t")), 6).alias("confidence"))


@query("SELECT s_suppkey, s_name AS manufacturer, 1::BIGINT AS n_tokens, 'low' AS confidence, 'en' AS language FROM supplier")
def evidence_provenance(spark, sf_dir):
    """Back-mapped evidence tokens of an address whose OCR was unsure."""
    token = F.array(F.struct(_text("Manufactured  by:  ", F.col("s_name")).alias("text"), F.lit(None).cast("array<array<double>>").alias("bbox"), F.lit(0.3).alias("confidence"), F.lit("en").alias("language")))
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", token.alias("tokens")).withColumns({"text": X.joined_text(F.col("tokens")), "index": X.token_index(F.col("tokens"))})
    mapped = X.normalize_with_map(rows, "text").withColumns({"norm": F.col("mapped.t"), "offsets": F.col("mapped.o")})
    out = extract.finalize(extract.best(extract.candidates(mapped, "MANUFACTURER_ADDRESS")))
    return out.select("s_suppkey", _best("text").alias("manufacturer"), F.size("evidence_tokens").cast("long").alias("n_tokens"), "confidence", "language")


# --- scans: extraction, contract, rules


def _scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label text per order; declarations are left out by the key."""
    k = F.col("o_orderkey")
    part = lambda n, text: F.when(k % n != 0, text).otherwise("")
    quantity = F.when(k % 11 == 0, F.lit(" Net Qty 5 mg")).otherwise(F.lit(" Net Qty 5 g"))
    text = _text(
        "Goods ", part(5, _text("MRP Rs ", _fixed(F.col("o_totalprice") / 1000))), part(7, quantity), part(3, F.lit(" Manufactured by Acme Foods Ltd")),
        part(13, F.lit(" Mfg Date 05/06/2024")), part(17, F.lit(" Customer Care 1800-123-4567 a@example.com")),
    )
    return _read(spark, sf_dir, "orders").select(k.alias("scan_id"), text.alias("text"))


_VIOLATIONS = """
SELECT o_orderkey AS scan_id, field_name, severity, clause AS legal_reference FROM orders, (VALUES
  ('mrp', 5, 'critical', 'Rule 6(1)(e)'), ('net_quantity', 7, 'major', 'Rule 6(1)(c)'), ('manufacturer', 3, 'major', 'Rule 6(1)(a)'),
  ('mfg_date', 13, 'major', 'Rule 6(1)(d)'), ('consumer_care', 17, 'minor', 'Rule 6(1)(h)'), ('FONT_SIZE', 1, 'major', NULL)) v(field_name, n, severity, clause)
WHERE o_orderkey % n = 0
UNION ALL SELECT o_orderkey, 'net_quantity', 'major', 'Rule 6(1)(c) -- Section 36(1) of Legal Metrology Act, 2009' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0
"""


@query(_VIOLATIONS.replace("('FONT_SIZE', 1, 'major', NULL)", "('FONT_SIZE', 1, 'major', 'Rule 9(1)')"))
def scan_violations(spark, sf_dir):
    return pipeline.check_scans(_scan_texts(spark, sf_dir), ["scan_id"])[0].select("scan_id", "field_name", "severity", "legal_reference")


@query(f"SELECT field_name, severity, count(*) AS n FROM ({_VIOLATIONS}) GROUP BY ALL")
def violations_by_field(spark, sf_dir):
    return pipeline.check_scans(_scan_texts(spark, sf_dir), ["scan_id"])[0].groupBy("field_name", "severity").agg(F.count("*").alias("n"))


@query(f"""SELECT scan_id, count(*) AS n_violations, greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 30 WHEN 'major' THEN 15 ELSE 5 END))::DOUBLE AS score, FALSE AS is_compliant
FROM ({_VIOLATIONS}) GROUP BY scan_id""")
def compliance_score(spark, sf_dir):
    return pipeline.check_scans(_scan_texts(spark, sf_dir), ["scan_id"])[1]


@query("""SELECT o_orderkey AS scan_id, concat_ws(',', CASE WHEN o_orderkey % 17 = 0 THEN 'CONSUMER_CARE' END, CASE WHEN o_orderkey % 3 = 0 THEN 'MANUFACTURER_ADDRESS' END,
  CASE WHEN o_orderkey % 13 = 0 THEN 'MANUFACTURING_DATE' END, CASE WHEN o_orderkey % 5 = 0 THEN 'MRP' END, CASE WHEN o_orderkey % 7 = 0 THEN 'NET_QUANTITY' END) AS missing
FROM orders WHERE 0 IN (o_orderkey % 3, o_orderkey % 5, o_orderkey % 7, o_orderkey % 13, o_orderkey % 17)""")
def missing_fields(spark, sf_dir):
    found = secondpass.missing_fields(extract.map_fields(_scan_texts(spark, sf_dir), ["scan_id"]), ["scan_id"])
    return found.select("scan_id", F.array_join("missing", ",").alias("missing"))


# --- second pass and images


@query("""SELECT p_partkey, greatest(round(p_retailprice, 2), p_size::DOUBLE) AS amount FROM part""")
def sweep_largest_price(spark, sf_dir):
    text = _text("USP ", F.col("p_size").cast("string"), " Offer Price ", _fixed(F.col("p_retailprice")), " INR 1")
    return _read(spark, sf_dir, "part").select("p_partkey", secondpass.normalize_mrp(secondpass.sweep_mrp(text)["evidence"]).alias("amount"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
  CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y-%m') ELSE '20' || strftime(l_shipdate, '%y-%m') END AS day FROM lineitem""")
def normalize_dates(spark, sf_dir):
    """Second-pass dates: day forms, month forms, and named months, which lose their day."""
    d = lambda f: F.date_format("l_shipdate", f)
    text = F.when(F.col("l_linenumber") % 3 == 0, d("dd-MM-yyyy")).when(F.col("l_linenumber") % 3 == 1, d("MM.yyyy")).otherwise(F.upper(d("dd/MMM/yy")))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", secondpass.normalize_date(text).alias("day"))


@query("""SELECT s_suppkey, '1-1800-' || (100 + s_suppkey % 900) || '-' || (1000 + s_suppkey % 9000) AS phone, 'x' || s_suppkey || '@a.org' AS email FROM supplier""")
def normalize_contacts(spark, sf_dir):
    k = F.col("s_suppkey")
    care = secondpass.normalize_care(_text("1800-", (100 + k % 900).cast("string"), "-", (1000 + k % 9000).cast("string"), " x", k.cast("string"), "@a.org"))
    return _read(spark, sf_dir, "supplier").select("s_suppkey", care["phone"].alias("phone"), care["email"].alias("email"))


@query("""SELECT p_partkey, field, CASE WHEN field = 'MRP' AND p_partkey % 2 = 0 THEN 99.5 WHEN field = 'MRP' THEN round(p_retailprice, 2) WHEN field = 'NET_QUANTITY' THEN p_size::DOUBLE END AS amount,
  CASE WHEN field IN ('MRP', 'NET_QUANTITY') THEN 'high' ELSE 'none' END AS confidence
FROM part, (VALUES ('MRP'), ('NET_QUANTITY'), ('MANUFACTURER_ADDRESS'), ('MANUFACTURING_DATE'), ('CONSUMER_CARE')) f(field)""")
def second_pass_override(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    first = extract.map_fields(part.select("p_partkey", _text("MRP Rs ", _fixed(F.col("p_retailprice")), " Net Qty ", F.col("p_size").cast("string"), " g").alias("text")), ["p_partkey"])
    second = part.where("p_partkey % 2 = 0").select("p_partkey", F.lit("MRP").alias("field"), F.lit("PRICE 99.50").alias("value"))
    return secondpass.override(first, second, ["p_partkey"]).select("p_partkey", "field", F.col("v_amount").alias("amount"), "confidence")


@query("""SELECT p_partkey, field, CASE WHEN field = 'MRP' THEN round(p_retailprice, 2) WHEN field = 'NET_QUANTITY' AND p_partkey % 3 = 0 THEN 7.0 END AS amount,
  CASE WHEN field = 'MRP' THEN 'regex' WHEN field = 'NET_QUANTITY' AND p_partkey % 3 = 0 THEN 'llm' ELSE 'none' END AS method
FROM part, (VALUES ('MRP'), ('NET_QUANTITY'), ('MANUFACTURER_ADDRESS'), ('MANUFACTURING_DATE'), ('CONSUMER_CARE')) f(field)""")
def enrichment_fill(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    first = extract.map_fields(part.select("p_partkey", _text("MRP Rs ", _fixed(F.col("p_retailprice"))).alias("text")), ["p_partkey"])
    first = first.withColumn("method", F.when(F.col("confidence") == "none", "none").otherwise("regex"))
    extra = part.where("p_partkey % 3 = 0").select("p_partkey", F.explode(F.array(F.struct(F.lit("NET_QUANTITY").alias("field"), F.lit("7 pcs").alias("value")), F.struct(F.lit("MRP").alias("field"), F.lit("1").alias("value")))).alias("e")).select("p_partkey", "e.*")
    return secondpass.enrich(first, extra, ["p_partkey"]).select("p_partkey", "field", F.col("v_amount").alias("amount"), "method")


_LINES = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS k, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"), F.min("l_quantity").alias("q"))


@query(f"""SELECT l_orderkey AS scan_id, value, confidence, l_linenumber AS image_index FROM (
  SELECT *, CASE WHEN k % 3 > 0 THEN q END AS value, CASE WHEN k % 3 = 0 THEN 'none' WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM ({_LINES}))
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY value IS NOT NULL DESC, CASE WHEN value IS NULL THEN 0 WHEN confidence = 'high' THEN 2 ELSE 1 END DESC, l_linenumber) = 1""")
def merge_images(spark, sf_dir):
    k = F.col("k")
    rows = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("scan_id"), F.lit("MRP").alias("field"), F.col("l_linenumber").alias("image_index"), F.when(k % 3 > 0, F.col("q")).alias("value"),
        F.when(k % 3 == 0, "none").when(k % 2 == 0, "high").otherwise("low").alias("confidence"),
    )
    return merge.merge_images(rows, ["scan_id"]).select("scan_id", "value", "confidence", "image_index")


_BOXES = f"SELECT l_orderkey AS image_id, l_linenumber AS token_index, (k % 300)::DOUBLE AS xmin, (l_linenumber * 25)::DOUBLE AS ymin, (k % 300 + 40)::DOUBLE AS xmax, (l_linenumber * 25 + 30)::DOUBLE AS ymax FROM ({_LINES})"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("k") % 300, F.col("l_linenumber") * 25
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("token_index"), x.cast("double").alias("xmin"), y.cast("double").alias("ymin"),
        (x + 40).cast("double").alias("xmax"), (y + 30).cast("double").alias("ymax"),
    )


@query(f"""WITH t AS ({_BOXES}) SELECT a.image_id, a.token_index AS anchor, b.token_index AS neighbour,
  round(sqrt(((b.xmin + b.xmax) / 2 - (a.xmin + a.xmax) / 2) ** 2 + ((b.ymin + b.ymax) / 2 - (a.ymin + a.ymax) / 2) ** 2), 4) AS distance
FROM t a JOIN t b ON a.image_id = b.image_id AND a.token_index <> b.token_index
WHERE b.xmin >= a.xmin - 40 AND b.xmin <= a.xmax + 400 AND b.ymin >= a.ymin - 40 AND b.ymax <= a.ymax + 60""")
def spatial_neighbours(spark, sf_dir):
    near = spatial.pairs(_boxes(spark, sf_dir), ["image_id"], spatial.in_window())
    return near.select(F.col("a.image_id").alias("image_id"), F.col("a.token_index").alias("anchor"), F.col("b.token_index").alias("neighbour"), F.round(spatial.distance(), 4).alias("distance"))


_OVERLAP = "greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"


@query(f"""WITH t AS ({_BOXES}) SELECT a.image_id, a.token_index AS i, b.token_index AS j, round({_OVERLAP} / (2400.0 - {_OVERLAP}), 6) AS iou
FROM t a JOIN t b ON a.image_id = b.image_id AND a.token_index < b.token_index WHERE {_OVERLAP} > 0""")
def token_iou(spark, sf_dir):
    first = F.col("a.token_index") < F.col("b.token_index")
    near = spatial.pairs(_boxes(spark, sf_dir), ["image_id"], first & (spatial.iou() > 0))
    return near.select(F.col("a.image_id").alias("image_id"), F.col("a.token_index").alias("i"), F.col("b.token_index").alias("j"), F.round(spatial.iou(), 6).alias("iou"))


@query(f"""WITH t AS (SELECT *, (token_index * 7 % 5) / 10.0 AS confidence FROM ({_BOXES})) SELECT a.image_id, a.token_index FROM t a WHERE NOT EXISTS (
  SELECT 1 FROM t b WHERE a.image_id = b.image_id AND a.token_index <> b.token_index AND {_OVERLAP} / (2400.0 - {_OVERLAP}) > 0.5
  AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.token_index < a.token_index)))""")
def merge_tokens(spark, sf_dir):
    tokens = _boxes(spark, sf_dir).withColumn("confidence", F.col("token_index") * 7 % 5 / 10.0)
    return spatial.merge_tokens(tokens, ["image_id"], dedupe=True).select("image_id", "token_index")


@query(f"""WITH d AS (SELECT l_orderkey AS image_id, l_linenumber % 4 AS rotation, q, l_linenumber AS n FROM ({_LINES})), s AS (
  SELECT image_id, rotation, round(sum(CASE WHEN n = 1 THEN 100 + 3 * q / 100 WHEN n % 2 = 0 THEN 7 * q / 100 ELSE q / 1000 END), 6) AS score FROM d GROUP BY ALL)
SELECT image_id, rotation, score FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, rotation) = 1""")
def best_rotation(spark, sf_dir):
    n = F.col("l_linenumber")
    text = F.when(n == 1, "MRP").when(n % 2 == 0, "abcdefg").otherwise("ab")
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("image_id"), (n % 4).alias("rotation"), text.alias("text"), (F.col("q") / 100).alias("confidence"))
    return spatial.best_rotation(rows)


@query("""SELECT p_partkey, 'MRP' AS field, 1 AS anchor, 2 AS neighbour, 'Rs ' || p_size || '.00' AS value, 100.0::DOUBLE AS distance FROM part""")
def anchor_pass(spark, sf_dir):
    """The nearest price right of a price label, not the farther or the lower one."""
    token = lambda i, text, x, y: F.struct(F.lit(i).alias("token_index"), text.alias("text"), F.lit(float(x)).alias("xmin"), F.lit(float(y)).alias("ymin"), F.lit(x + 50.0).alias("xmax"), F.lit(y + 20.0).alias("ymax"))
    size = F.col("p_size").cast("string")
    tokens = F.array(token(0, F.lit("Goods"), 0, 0), token(1, F.lit("MRP"), 0, 30), token(2, _text("Rs ", size, ".00"), 100, 30), token(3, F.lit("Rs 999.00"), 300, 30), token(4, F.lit("Rs 1.00"), 100, 300))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.explode(tokens).alias("t")).select("p_partkey", "t.*")
    return spatial.anchored(rows, ["p_partkey"], "MRP", V.SWEEP["MRP"])


# --- pages of tokens: second pass, images of a scan, letter heights


def _token(text: Column | str, x: float | None = None, y: float = 0.0, width: float = 50.0, height: Column | float = 20.0) -> Column:
    """An OCR token; without ``x`` it has no box."""
    box = F.lit(None).cast("array<array<double>>")
    if x is not None:
        at = lambda v: v if isinstance(v, Column) else F.lit(float(v))
        box = spatial.polygon(at(x), at(y), at(x + width), (F.lit(float(y)) + height).cast("double"))
    return F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), box.alias("bbox"), F.lit(0.9).alias("confidence"), F.lit("en").alias("language"))


@query("""SELECT p_partkey, field, CASE field WHEN 'MRP' THEN 100.0 + p_size WHEN 'NET_QUANTITY' THEN p_size END::DOUBLE AS amount, CASE field WHEN 'NET_QUANTITY' THEN 'kg' END AS unit,
  CASE field WHEN 'MANUFACTURER_ADDRESS' THEN 'Zed Foods Limited, Pune' WHEN 'EXPIRY_DATE' THEN '06/2027' END AS text, CASE field WHEN 'MANUFACTURING_DATE' THEN '2027-06' END AS date,
  CASE field WHEN 'CONSUMER_CARE' THEN '1-1800-123-4567' END AS phone, 'high' AS confidence, CASE field WHEN 'MRP' THEN 100.0 WHEN 'EXPIRY_DATE' THEN 60.0 WHEN 'MANUFACTURING_DATE' THEN 0.0 END::DOUBLE AS x
FROM part, (VALUES ('MRP'), ('NET_QUANTITY'), ('MANUFACTURER_ADDRESS'), ('MANUFACTURING_DATE'), ('CONSUMER_CARE'), ('EXPIRY_DATE')) f(field)""")
def second_pass_page(spark, sf_dir):
    """Values beside their anchors, else anywhere on the page, replace those of the first pass; the expiry date is a sixth field."""
    n = F.col("p_size").cast("string")
    tokens = F.array(
        _token("Goods", 0, 0), _token("MRP", 0, 30), _token(_text("Rs ", (F.col("p_size") + 100).cast("string"), ".00"), 100, 30), _token("Rs 999.00", 300, 30), _token("EXP", 0, 60), _token("06/2027", 60, 60),
        _token(_text("Net Wt ", n, " kg")), _token("Marketed by: Zed Foods Limited, Pune"), _token(_text("Customer Care 1800-123-4567 x", n, "@a.org")),
    )
    out = pipeline.map_images(_read(spark, sf_dir, "part").select("p_partkey", tokens.alias("tokens")), keys=["p_partkey"])
    x = spatial.merged_box(F.col("bbox"))["xmin"]
    return out.select("p_partkey", "field", F.col("v_amount").alias("amount"), F.col("v_unit").alias("unit"), F.col("v_text").alias("text"), F.col("v_date").alias("date"), F.col("v_phone").alias("phone"), "confidence", x.alias("x"))


@query("""SELECT p_partkey, field, CASE field WHEN 'MRP' THEN 'USP ' || p_size WHEN 'NET_QUANTITY' THEN '3 pieces' WHEN 'MANUFACTURER_ADDRESS' THEN 'Zed Foods Limited' WHEN 'MANUFACTURING_DATE' THEN '05/06/2024'
  ELSE '1800 123 4567' END AS value FROM part, (VALUES ('MRP'), ('NET_QUANTITY'), ('MANUFACTURER_ADDRESS'), ('MANUFACTURING_DATE'), ('CONSUMER_CARE')) f(field)""")
def sweep_fields(spark, sf_dir):
    """Values anywhere in a text, without labels."""
    text = _text("USP ", F.col("p_size").cast("string"), " Sold as 3 pieces Packed by Zed Foods Limited FSSAI 10 made 05/06/2024 call 1800 123 4567")
    return secondpass.sweep_rows(_read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"])


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images per order; declarations are left out by the key."""
    k = F.col("o_orderkey")
    some = lambda *parts: F.filter(F.array(*(F.when(k % n != 0, _token(t)) for n, t in parts)), lambda t: t.isNotNull())
    first = F.concat(F.array(_token("Goods")), some((5, "MRP Rs 50.00"), (7, "Net Qty 5 g")))
    second = some((3, "Manufactured by Acme Foods Ltd"), (13, "Mfg Date 05/06/2024"), (17, "Customer Care 1800-123-4567 a@example.com"))
    return _read(spark, sf_dir, "orders").select(k.alias("scan_id"), F.posexplode(F.array(first, second)).alias("image_index", "tokens"))


def _enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices known from elsewhere, for the first image of every other order."""
    return _read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("scan_id"), F.lit(0).alias("image_index"), F.lit("MRP").alias("field"), F.lit("Rs 75").alias("value"))


_OF_IMAGES = """SELECT o_orderkey AS scan_id, field_name, severity, CASE WHEN field_name <> 'FONT_SIZE' THEN 0 END AS image_index FROM orders, (VALUES
  ('mrp', 5, 'critical'), ('net_quantity', 7, 'major'), ('manufacturer', 3, 'major'), ('mfg_date', 13, 'major'), ('consumer_care', 17, 'minor'), ('FONT_SIZE', 1, 'major')) v(field_name, n, severity)
WHERE o_orderkey % n = 0 AND NOT (field_name = 'mrp' AND o_orderkey % 2 = 0)"""


@query(_OF_IMAGES)
def image_violations(spark, sf_dir):
    """Tokens of images to violations: both passes, enrichment, merging, contract, rules."""
    return pipeline.check_images(_images(spark, sf_dir), _enrichment(spark, sf_dir)).violations.select("scan_id", "field_name", "severity", "image_index")


@query(f"""WITH s AS (SELECT scan_id, greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 30 WHEN 'major' THEN 15 ELSE 5 END))::DOUBLE AS score FROM ({_OF_IMAGES}) GROUP BY scan_id)
SELECT o_orderkey AS scan_id, 'pending_sync' AS sync_status, FALSE AS is_compliant, score AS compliance_score,
  concat_ws(' ', 'Goods', CASE WHEN o_orderkey % 5 <> 0 THEN 'MRP Rs 50.00' END, CASE WHEN o_orderkey % 7 <> 0 THEN 'Net Qty 5 g' END) || chr(10) || chr(10) || concat_ws(' ',
  CASE WHEN o_orderkey % 3 <> 0 THEN 'Manufactured by Acme Foods Ltd' END, CASE WHEN o_orderkey % 13 <> 0 THEN 'Mfg Date 05/06/2024' END, CASE WHEN o_orderkey % 17 <> 0 THEN 'Customer Care 1800-123-4567 a@example.com' END) AS combined_text
FROM orders JOIN s ON scan_id = o_orderkey""")
def stored_scan_rows(spark, sf_dir):
    images = _images(spark, sf_dir)
    return pipeline.scan_rows(images, pipeline.check_images(images, _enrichment(spark, sf_dir))).select("scan_id", "sync_status", "is_compliant", "compliance_score", "combined_text")


def _measured(spark: SparkSession, sf_dir: str) -> pipeline.Checked:
    """Labels whose price is set in letters of different height; every other one has a coin beside it."""
    part = _read(spark, sf_dir, "part")
    tokens = F.array(_token("MRP Rs 50.00", 0, 0, 100, F.col("p_size") + 5), _token("Net Qty 300 g", 0, 200, 100, 20))
    images = part.select(F.col("p_partkey").alias("scan_id"), F.lit(0).alias("image_index"), tokens.alias("tokens"))
    coins = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("scan_id"), F.lit("10_rupee").alias("coin_key"), F.lit(50.0).alias("coin_radius_px"))
    return pipeline.check_images(images, calibrations=coins)


@query("""SELECT p_partkey AS scan_id, field_name, CASE field_name WHEN 'mrp' THEN round((p_size + 5) * 0.27::DOUBLE, 3) ELSE 5.4 END::DOUBLE AS measured_mm, 2.0::DOUBLE AS required_mm,
  field_name <> 'mrp' OR (p_size + 5) * 0.27::DOUBLE >= 2 AS is_compliant FROM part, (VALUES ('mrp'), ('net_quantity')) f(field_name) WHERE p_partkey % 2 = 0""")
def font_fields(spark, sf_dir):
    """Letter heights of the declared fields of calibrated scans."""
    coins = _read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("scan_id"), F.lit("10_rupee").alias("coin_key"), F.lit(50.0).alias("coin_radius_px"))
    fields = _measured(spark, sf_dir).fields.where("field_name <> 'FONT_SIZE'")
    return fontsize.of_fields(fields, coins, ["scan_id"]).select("scan_id", "field_name", "measured_mm", "required_mm", "is_compliant")


@query(f"""SELECT p_partkey AS scan_id, CASE WHEN p_partkey % 2 = 1 THEN '{rules.NOT_MEASURED}' ELSE 'Text height (' || printf('%.3f', (p_size + 5) * 0.27::DOUBLE) || ' mm) is below the required statutory minimum.' END AS issue,
  'major' AS severity, CASE WHEN p_partkey % 2 = 0 THEN printf('%.3f mm', (p_size + 5) * 0.27::DOUBLE) END AS measured_value, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 5)::DOUBLE END AS ymax
FROM part WHERE p_partkey % 2 = 1 OR (p_size + 5) * 0.27::DOUBLE < 2""")
def font_rule(spark, sf_dir):
    """Letters that are too small, and scans without a coin."""
    found = _measured(spark, sf_dir).violations.where("field_name = 'FONT_SIZE'")
    return found.select("scan_id", "issue", "severity", "measured_value", F.col("bbox.ymax").alias("ymax"))


@query(f"""SELECT p_partkey, "field_name", issue, legal_reference, 'TEXT_CONTENT' AS violation_category FROM (SELECT p_partkey, 'mrp' AS field_name, '{rules.NO_TAXES.replace("'", "''")}' AS issue,
  'Rule 6(1)(e) -- Section 36(1) of Legal Metrology Act, 2009' AS legal_reference FROM part WHERE p_partkey % 2 = 1)""")
def mrp_rule(spark, sf_dir):
    """A rule table with a pattern that the evidence of prices must match."""
    text = F.when(F.col("p_partkey") % 2 == 1, "MRP Rs 50.00").otherwise("MRP ₹ 50.00")
    rows = _read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    table = rules.rules(spark).withColumn("regex_pattern", F.when(F.col("field") == "mrp", "₹|incl.*taxes"))
    found = rules.violations(rules.contract(extract.map_fields(rows, ["p_partkey"]), ["p_partkey"]), rows, ["p_partkey"], table, ("mrp",))
    return found.select("p_partkey", "field_name", "issue", "legal_reference", "violation_category")


@query("""SELECT p_partkey, kind, x AS xmin, 2.0::DOUBLE AS ymin, x + p_size AS xmax, 2.0::DOUBLE + p_size AS ymax FROM (SELECT p_partkey, p_size, (p_partkey % 100)::DOUBLE AS x FROM part), (VALUES ('flat'), ('corners'), ('several')) k(kind)""")
def rectangles(spark, sf_dir):
    """Flat boxes, polygons, and the rectangle around several polygons."""
    x, y = (F.col("p_partkey") % 100).cast("double"), F.lit(2.0)
    x2, y2 = x + F.col("p_size"), y + F.col("p_size")
    several = F.array(spatial.polygon(x, y, x + 1, y + 1), spatial.polygon(x, y, x2, y2))
    boxes = {"flat": spatial.rectangle(F.array(F.array(x, y, x2, y2))), "corners": spatial.rectangle(spatial.polygon(x, y, x2, y2)), "several": spatial.merged_box(several)}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), b.alias("box")) for k, b in boxes.items())))
    return _read(spark, sf_dir, "part").select("p_partkey", rows.alias("r")).select("p_partkey", "r.kind", "r.box.*")


@query("""SELECT p_partkey, p_partkey % 4 <> 1 AS again FROM part""")
def second_ocr_pass(spark, sf_dir):
    """Pages that are to be read again: nothing found, no price or date, or unsure."""
    sure = lambda c: F.array(F.struct(F.lit("MRP 5").alias("text"), F.lit(None).cast("array<array<double>>").alias("bbox"), F.lit(c).alias("confidence"), F.lit("en").alias("language")))
    k = F.col("p_partkey") % 4
    tokens = F.when(k == 0, F.array().cast(f"array<{sources.TOKEN}>")).when(k == 1, sure(0.9)).when(k == 2, sure(0.3)).otherwise(F.array(_token("Goods")))
    return _read(spark, sf_dir, "part").select("p_partkey", spatial.needs_second_pass(tokens).alias("again"))


# --- stored scans


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending_sync").otherwise("synced")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("officer_id"), (F.col("o_orderstatus") == "F").alias("is_compliant"), F.round("o_totalprice", 2).alias("compliance_score"),
        F.col("o_orderdate").alias("created_at"), status.alias("sync_status"), F.md5(F.col("o_orderkey").cast("string")).alias("scan_key"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("product_name"),
    )


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_returnflag").alias("field_name")).distinct()
    return rows.withColumn("issue", F.concat(F.lit("issue "), "field_name")).withColumn("severity", F.when(F.col("field_name") == "A", "critical").otherwise("minor"))


_FOUND = "SELECT DISTINCT l_orderkey AS scan_id, l_returnflag AS field_name, 'issue ' || l_returnflag AS issue, CASE WHEN l_returnflag = 'A' THEN 'critical' ELSE 'minor' END AS severity FROM lineitem"
_RATE = "coalesce(round_even(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 1), 0)::DOUBLE"


@query(f"""SELECT count(*) AS total, {_RATE} AS pass_rate, (SELECT field_name FROM ({_FOUND}) GROUP BY field_name ORDER BY count(*) DESC, field_name LIMIT 1) AS top_violation FROM orders""")
def scan_metrics(spark, sf_dir):
    return store.metrics(_scans(spark, sf_dir), _found(spark, sf_dir))


@query(f"""WITH c AS (SELECT o_custkey, field_name, count(*) AS n FROM ({_FOUND}) JOIN orders ON o_orderkey = scan_id GROUP BY ALL), top AS (
  SELECT o_custkey, field_name FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, field_name) = 1)
SELECT o_custkey AS officer_id, count(*) AS total, {_RATE} AS pass_rate, coalesce(any_value(field_name), 'None') AS top_violation FROM orders LEFT JOIN top USING (o_custkey) GROUP BY o_custkey""")
def metrics_by_officer(spark, sf_dir):
    return store.metrics_by_officer(_scans(spark, sf_dir), _found(spark, sf_dir))


@query("""SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Unregistered Product' END AS product_name FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 10""")
def scan_history(spark, sf_dir):
    return store.history(_scans(spark, sf_dir), 25, 10).select("scan_id", "product_name")


@query("SELECT o_orderkey AS scan_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_scan(spark, sf_dir):
    return store.latest(_scans(spark, sf_dir))


@query(f"""SELECT o_orderkey AS scan_id, coalesce(string_agg(field_name || ':' || severity, ',' ORDER BY field_name), '') AS violations FROM orders LEFT JOIN ({_FOUND}) ON scan_id = o_orderkey GROUP BY o_orderkey""")
def scan_detail(spark, sf_dir):
    rows = store.detail(_scans(spark, sf_dir), _found(spark, sf_dir))
    return rows.select("scan_id", F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v["field_name"], v["severity"])), ",").alias("violations"))


@query("SELECT o_orderkey AS scan_id, count(*) OVER () AS match_count FROM orders WHERE starts_with(upper(md5(o_orderkey::VARCHAR)), 'A7')")
def prefix_lookup(spark, sf_dir):
    return store.prefix_lookup(_scans(spark, sf_dir), "CERT-a7").select("scan_id", "match_count")


_OVERRIDES = """SELECT o_orderkey AS scan_id, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'MRP' END AS field_name, CASE WHEN o_orderkey % 4 = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN o_orderkey % 5 > 0 THEN 'seen' END AS evidence FROM orders WHERE o_orderkey % 2 = 0"""


@query(f"""SELECT scan_id, field_name, coalesce(evidence, issue) AS issue, CASE WHEN issue IS NULL THEN 'HIGH' ELSE severity END AS severity, status IS NOT NULL AS overridden
FROM ({_FOUND}) FULL JOIN ({_OVERRIDES}) USING (scan_id, field_name) WHERE status IS NULL OR status <> 'PASS'""")
def override_apply(spark, sf_dir):
    k = F.col("o_orderkey")
    one = _read(spark, sf_dir, "orders").where(k % 2 == 0).select(
        k.alias("scan_id"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("MRP").alias("rule_key"), F.when(k % 4 == 0, "PASS").otherwise("FAIL").alias("status"),
        F.when(k % 5 > 0, "seen").alias("evidence"), F.lit(2).alias("seq"),
    )
    earlier = one.withColumns({"status": F.lit("PASS"), "evidence": F.lit("old"), "seq": F.lit(1)})
    return store.apply_overrides(_found(spark, sf_dir), one.unionByName(earlier))


@query("SELECT o_orderkey AS scan_id, o_custkey AS officer_id, o_orderstatus = 'F' AS is_compliant, round(o_totalprice, 2) AS compliance_score, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O'")
def pending_sync(spark, sf_dir):
    return store.pending(_scans(spark, sf_dir))


@query("SELECT CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 1 THEN 'pending_sync' ELSE 'synced' END AS sync_status, count(*) AS n FROM orders GROUP BY 1")
def sync_update(spark, sf_dir):
    scans = _scans(spark, sf_dir)
    sent = store.pending(scans).where("scan_id % 2 = 0")
    return store.mark_synced(scans, sent).groupBy("sync_status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 4 = 0 THEN 'pass' WHEN o_orderkey % 4 = 2 THEN 'fail' END AS calibrator_result, o_orderkey % 2 = 0 AS calibrator_used FROM orders")
def calibration_update(spark, sf_dir):
    scans = _scans(spark, sf_dir).withColumns({"calibrator_used": F.lit(False), "calibrator_result": F.lit(None).cast("string")})
    results = scans.where("scan_id % 2 = 0").select("scan_id", (F.col("scan_id") % 4 == 0).alias("passed")).union(spark.createDataFrame([(-1, True)], "scan_id long, passed boolean"))
    return store.set_calibration(scans, results).select("scan_id", "calibrator_result", "calibrator_used")


@query("SELECT c_name AS email, c_custkey AS officer_id FROM customer")
def seed_new_accounts(spark, sf_dir):
    users = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("email"), F.col("c_custkey").alias("officer_id"))
    return store.add_missing(users.where("officer_id % 3 = 0"), users)


@query("SELECT o_orderkey AS scan_id, coalesce(c_name || ', ' || c_mktsegment || ' (' || c_custkey || ')', 'N/A') AS officer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def scan_officer(spark, sf_dir):
    users = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("officer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    return store.with_officer(_scans(spark, sf_dir), users).select("scan_id", "officer")


@query("""SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' WHEN o_custkey % 25 < 20 THEN 'place ' || (o_custkey % 25) END AS location_address FROM orders""")
def scan_address(spark, sf_dir):
    at = (F.col("officer_id") % 25).cast("double")
    scans = _scans(spark, sf_dir).withColumns({"latitude": at + 0.0001, "longitude": at, "location_address": F.when(F.col("scan_id") % 3 == 0, "stored")})
    n = F.col("n_nationkey")
    places = _read(spark, sf_dir, "nation").where(n < 20).select(n.cast("double").alias("lat"), n.cast("double").alias("lon"), _text("place ", n.cast("string")).alias("address"))
    return store.with_address(scans, places).select("scan_id", "location_address")


@query("""SELECT p_partkey AS scan_id, 'mrp' AS field_name, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS image_index, p_partkey % 3 > 0 AS has_box FROM part""")
def field_images(spark, sf_dir):
    """The image that each field was taken from; boxes of other images than the first are void."""
    k = F.col("p_partkey")
    box = F.array(F.array(F.lit(1.0), F.lit(2.0)))
    image = lambda i, value: F.struct(F.lit(i).alias("image_index"), value.alias("value"), F.when(value.isNotNull(), "high").otherwise("none").alias("confidence"), box.alias("bbox"))
    images = F.explode(F.array(image(0, F.when(k % 3 > 0, F.lit(1.0))), image(1, F.lit(2.0))))
    rows = _read(spark, sf_dir, "part").select(k.alias("scan_id"), F.lit("MRP").alias("field"), images.alias("i")).select("scan_id", "field", "i.*")
    merged = merge.primary_image_boxes(merge.merge_images(rows, ["scan_id"]))
    return merge.field_images(merged).select("scan_id", "field_name", "image_index", F.col("bbox").isNotNull().alias("has_box"))


@query("""WITH f AS (SELECT o_orderkey AS scan_id, 'MRP' AS field, 'old' AS value, 'low' AS confidence FROM orders), o AS (
  SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 3 = 0 THEN 'MRP' ELSE 'mrp' END AS field, CASE WHEN o_orderkey % 4 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders WHERE o_orderkey % 2 = 0)
SELECT scan_id, field, CASE WHEN status IS NULL THEN value WHEN status = 'PASS' THEN 'seen' END AS value, CASE WHEN status IS NULL THEN confidence WHEN status = 'PASS' THEN 'high' ELSE 'none' END AS confidence, status AS manual_override
FROM f FULL JOIN o USING (scan_id, field)""")
def override_fields(spark, sf_dir):
    """What overrides write to a scan's fields: keys as given, the last one counts."""
    k = F.col("o_orderkey")
    orders = _read(spark, sf_dir, "orders")
    fields = orders.select(k.alias("scan_id"), F.lit("MRP").alias("field"), F.lit("old").alias("value"), F.lit("low").alias("confidence"))
    one = orders.where(k % 2 == 0).select(k.alias("scan_id"), F.when(k % 3 == 0, "MRP").otherwise("mrp").alias("rule_key"), F.when(k % 4 == 0, "PASS").otherwise("FAIL").alias("status"), F.lit("seen").alias("evidence"), F.lit(2).alias("seq"))
    earlier = one.withColumns({"status": F.lit("PASS"), "evidence": F.lit("before"), "seq": F.lit(1)})
    return store.apply_overrides_to_fields(fields, one.unionByName(earlier))


@query("""SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100)::DOUBLE ELSE round(o_totalprice, 2) END AS compliance_score,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 >= 50 ELSE o_orderstatus = 'F' END AS is_compliant FROM orders""")
def override_verdicts(spark, sf_dir):
    scans, k = _scans(spark, sf_dir), F.col("scan_id")
    given = scans.where(k % 2 == 0).select("scan_id", (k % 100).alias("score"), (k % 100 >= 50).alias("is_compliant"), F.lit(2).alias("seq"))
    earlier = given.withColumns({"score": F.lit(1).cast("long"), "seq": F.lit(1)})
    return store.apply_verdicts(scans, given.unionByName(earlier)).select("scan_id", "compliance_score", "is_compliant")


@query(f"""WITH f AS ({_FOUND}), w AS (SELECT 'one' AS asked, * FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'all', * FROM orders)
SELECT asked, count(*) AS total, {_RATE} AS pass_rate, coalesce((SELECT field_name FROM f JOIN w x ON o_orderkey = scan_id WHERE x.asked = w.asked GROUP BY field_name ORDER BY count(*) DESC, field_name LIMIT 1), 'None') AS top_violation
FROM w GROUP BY asked""")
def officer_metrics(spark, sf_dir):
    """Metrics of one officer, and of an id that can't be one, which is ignored."""
    scans, found = _scans(spark, sf_dir), _found(spark, sf_dir)
    ask = lambda name, officer: store.metrics(scans, found, officer).select(F.lit(name).alias("asked"), "*")
    return ask("one", 7).unionByName(ask("all", "nobody"))


@query("SELECT md5(o_orderkey::VARCHAR) AS scan_id FROM orders ORDER BY o_orderdate DESC, md5(o_orderkey::VARCHAR) LIMIT 1")
def latest_text_id(spark, sf_dir):
    return store.latest(_scans(spark, sf_dir).withColumn("scan_id", F.col("scan_key")))


# --- font size, certificates, evaluation


@query("""WITH b AS (SELECT p_partkey, round((p_size + 5) * (21.93::DOUBLE / (2 * (20.37::DOUBLE + p_partkey % 30))), 3) AS measured_mm, CASE p_partkey % 3 WHEN 0 THEN p_size * 20.0 WHEN 1 THEN p_size * 20000.0 END AS q FROM part)
SELECT p_partkey, measured_mm, CASE WHEN q < 200 THEN 1.0 WHEN q < 500 THEN 2.0 ELSE 4.0 END::DOUBLE AS required_mm, measured_mm >= CASE WHEN q < 200 THEN 1.0 WHEN q < 500 THEN 2.0 ELSE 4.0 END AS is_compliant,
  CASE WHEN q IS NULL THEN 'low' ELSE 'high' END AS confidence FROM b""")
def font_size_check(spark, sf_dir):
    k = F.col("p_partkey")
    boxes = _read(spark, sf_dir, "part").select(
        "p_partkey", F.lit(0).alias("y1"), (F.col("p_size") + 5).alias("y2"), F.lit("1_rupee").alias("coin_key"), (20.37 + k % 30).alias("coin_radius_px"),
        (F.col("p_size") * 20.0).alias("quantity"), F.element_at(F.array(F.lit("g"), F.lit("kg"), F.lit("pieces")), (k % 3 + 1).cast("int")).alias("unit"),
    )
    return fontsize.check(boxes).select("p_partkey", "measured_mm", "required_mm", "is_compliant", "confidence")


@query("""SELECT o_orderkey AS scan_id, 'CERT-' || upper(md5(o_orderkey::VARCHAR)[1:8]) AS certificate, 'CR-' || year(o_orderdate) || '-' || upper(md5(o_orderkey::VARCHAR)[1:8]) AS report,
  strftime(o_orderdate, '%d-%m-%Y') AS issued, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END AS verdict, 'Rs. ' || printf('%.2f', round(o_totalprice, 2)) AS mrp,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Packaged Product' END AS commodity FROM orders""")
def certificate_rows(spark, sf_dir):
    s = _scans(spark, sf_dir)
    return s.select(
        "scan_id", report.certificate_number(F.col("scan_key")).alias("certificate"), report.report_number(F.col("scan_key"), F.col("created_at")).alias("report"), F.date_format("created_at", "dd-MM-yyyy").alias("issued"),
        report.verdict(F.col("is_compliant")).alias("verdict"), report.format_mrp(F.col("compliance_score")).alias("mrp"), report.commodity(F.col("product_name")).alias("commodity"),
    )


@query(f"""SELECT o_orderkey AS scan_id, 'CERT-' || upper(md5(o_orderkey::VARCHAR)[1:8]) AS certificate, 'CR-' || year(o_orderdate) || '-' || upper(md5(o_orderkey::VARCHAR)[1:8]) AS report,
  strftime(o_orderdate, '%d-%m-%Y') AS issued, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END AS verdict, round_even(round(o_totalprice, 2), 0)::BIGINT::VARCHAR AS score,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Packaged Product' END AS commodity, coalesce(string_agg('[' || upper(severity) || '] ' || field_name || ': ' || issue, chr(10) ORDER BY field_name), '') AS violations
FROM orders LEFT JOIN ({_FOUND}) ON scan_id = o_orderkey GROUP BY ALL""")
def certificates(spark, sf_dir):
    return report.certificates(_scans(spark, sf_dir), _found(spark, sf_dir)).withColumn("violations", F.array_join("violations", "\n"))


@query("""SELECT coalesce(field, 'ALL') AS field, count(*) AS total, sum(ok)::BIGINT AS correct, round(avg(ok), 4) AS accuracy FROM (
  SELECT 'MRP' AS field, CASE WHEN p_partkey % 10 > 0 THEN 1 ELSE 0 END AS ok FROM part UNION ALL SELECT 'NET_QUANTITY', CASE WHEN p_partkey % 4 > 0 THEN 1 ELSE 0 END FROM part) GROUP BY ROLLUP (field)""")
def field_accuracy(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = part.select(F.lit("MRP").alias("field"), evaluate.expected_price(_text("MRP ₹ ", _fixed(F.col("p_retailprice")), "/-")).cast("string").alias("expected"), F.round(F.col("p_retailprice") + F.when(k % 10 == 0, 1.0).otherwise(0.0), 2).cast("string").alias("actual"))
    found = evaluate.expected_quantity(_text(F.col("p_size").cast("string"), F.when(k % 4 == 0, " Pairs").otherwise(" Kilograms")))
    quantity = part.select(F.lit("NET_QUANTITY").alias("field"), F.concat_ws(" ", found["amount"].cast("string"), found["unit"]).alias("expected"), F.concat_ws(" ", F.col("p_size").cast("double").cast("string"), F.lit("kg")).alias("actual"))
    return evaluate.accuracy(price.unionByName(quantity))


@query("""WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: len(x) >= 2)) AS a, list_distinct(list_filter(string_split(lower(p_name || ' x9'), ' '), lambda x: len(x) >= 2)) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(a), 6) AS recall FROM w""")
def word_recall(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(evaluate.recall(F.concat_ws(" ", "p_name", "p_type"), _text(F.col("p_name"), " x9")), 6).alias("recall"))


@query("""WITH q AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 1234567.0 WHEN 3 THEN 0.00001234 WHEN 4 THEN p_retailprice ELSE 0.0 END::DOUBLE AS amount,
  repeat(p_name || ' ₹ ', CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 1 END) AS maker FROM part)
SELECT p_partkey, printf('%g g', amount) AS quantity, regexp_replace(CASE WHEN length(maker) > 60 THEN maker[1:57] || '...' ELSE maker END, '₹', '?', 'g') AS manufacturer FROM q""")
def report_values(spark, sf_dir):
    """Quantities and makers as certificates print them."""
    k = F.col("p_partkey")
    amount = F.when(k % 6 == 0, F.col("p_size").cast("double")).when(k % 6 == 1, F.col("p_size") + 0.5).when(k % 6 == 2, 1234567.0).when(k % 6 == 3, 0.00001234).when(k % 6 == 4, F.col("p_retailprice")).otherwise(0.0)
    maker = F.repeat(_text(F.col("p_name"), " ₹ "), F.when(k % 2 == 0, 9).otherwise(1))
    return _read(spark, sf_dir, "part").select("p_partkey", report.format_quantity(amount, F.lit("g")).alias("quantity"), report.format_manufacturer(maker).alias("manufacturer"))


@query("""WITH w AS (SELECT list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: len(x) >= 2)) AS a, list_distinct(list_filter(string_split(lower(p_name || ' x9'), ' '), lambda x: len(x) >= 2)) AS b FROM part),
r AS (SELECT len(list_intersect(a, b)) / len(a) AS recall FROM w) SELECT count(*) AS total, round(avg(recall), 6) AS mean_recall, count(*) FILTER (recall >= 0.6) AS passed FROM r""")
def recall_of_batch(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("expected"), _text(F.col("p_name"), " x9").alias("actual"))
    return evaluate.batch_recall(rows)
