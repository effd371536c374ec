"""Cases of our own for extraction, spans, merging, rules, sources and streaming."""

import datetime
import itertools
import json
import random
import time

from pyspark.sql import functions as F

from tagwise import sources, streaming
from tagwise.functions import layout, reading
from tagwise.functions import text as X
from tagwise.functions import vocabulary as V
from tagwise.operators import evaluate, extract, fontsize, merge, pipeline, report, rules, secondpass, spatial, store
from tagwise.plans import catalogue


CASES = [
    ("MRP", "M.R.P: Rs. 1,249.50/-", "v_amount", 1249.5, "high"),
    ("MRP", "MRP ₹12,34,567 only", "v_amount", 1234567.0, "low"),
    ("MRP", "MRP INR 12,345,6", "v_amount", None, "none"),
    ("MRP", "mrp 75", "v_amount", 75.0, "low"),
    ("MRP", "MRP see R= .45. 50", "v_amount", 45.5, "low"),
    ("MRP", "अधिकतम खुदरा मूल्य ₹ ५०", "v_amount", 50.0, "high"),
    ("MRP", "Price Rs 50", "v_amount", None, "none"),
    ("NET_QUANTITY", "Net Wt. 2 Kilograms", "v_unit", "kg", "high"),
    ("NET_QUANTITY", "Contents: 0 g", "v_unit", None, "none"),
    ("NET_QUANTITY", "Net Qty -5 g", "v_amount", None, "none"),
    ("MANUFACTURER_ADDRESS", "Mktd x Marketed by Zed Corp, Pune MRP Rs 4", "v_text", "Zed Corp, Pune", "high"),
    ("MANUFACTURER_ADDRESS", "Manufactured by 99", "v_text", None, "none"),
    ("MANUFACTURING_DATE", "MFG 31/02/2024", "v_date", None, "none"),
    ("MANUFACTURING_DATE", "MFD 2024-02-29", "v_date", "2024-02-29", "high"),
    ("MANUFACTURING_DATE", "Packed On Exp 01/01/2024", "v_date", None, "none"),
    ("CONSUMER_CARE", "Feedback: care@x.in", "v_email", "care@x.in", "low"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "id int, text string")
    found = {(r["id"], r["field"]): r for r in extract.map_fields(df, ["id"]).collect()}
    for i, (field, _, column, value, confidence) in enumerate(CASES):
        r = found[i, field]
        assert (r[column], r["confidence"]) == (value, confidence), CASES[i]


def test_null_and_empty_texts_and_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    out = extract.map_fields(df, ["id"]).collect()
    assert len(out) == 10 and {r["confidence"] for r in out} == {"none"}
    assert extract.map_fields(df.limit(0), ["id"]).count() == 0


def test_mapped_normalisation_equals_the_plain_one(spark):
    texts = ["  M . R . P  Rs . 5\n\nNet  Qty. ५ g", "", "ː Cuslomer：conlact", "a\t\tb", "Net Vol. 3 ml"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in X.normalize_with_map(df, "text").withColumn("plain", X.normalize_text(F.col("text"))).collect():
        assert r["mapped"]["t"] == r["plain"] and len(r["mapped"]["o"]) == len(r["plain"])


def test_merge_equals_the_fold(spark):
    kinds = [(None, "none"), (1, "low"), (2, "high"), (3, "none")]
    rank = {"high": 2, "low": 1, "none": 0}
    rows, want = [], {}
    for n, images in enumerate(itertools.product(kinds, repeat=3)):
        best = None
        for i, (v, c) in enumerate(images):
            rows.append((n, "f", i, v, c))
            if best is None or (v is not None and (best[0] is None or rank[c] > rank[best[1]])):
                best = (v, c, i)
        want[n] = best
    df = spark.createDataFrame(rows, "k int, field string, image_index int, value int, confidence string")
    for r in merge.merge_images(df, ["k"]).collect():
        assert (r["value"], r["confidence"], r["image_index"]) == want[r["k"]]


def test_second_pass_normalizers(spark):
    df = spark.createDataFrame([("06/FEB/26", "45/13/2026", "123456", ", 5", "10 pieces", "3 litre")], "a string, b string, c string, d string, e string, f string")
    r = df.select(
        secondpass.normalize_date(F.col("a")), secondpass.normalize_date(F.col("b")), secondpass.normalize_date(F.col("c")), secondpass.normalize_mrp(F.col("d")),
        secondpass.normalize_quantity(F.col("e"))["unit"], secondpass.normalize_quantity(F.col("f")),
    ).first()
    assert tuple(r) == ("2026-02", "2026-13-45", None, None, "piece", None)


def test_clean_scan_and_variant_without_font_size(spark):
    text = "MRP Rs 5 Net Qty 5 g Manufactured by Acme Foods Mfg Date 05/06/2024 Customer Care 1800-123-4567 a@b.com"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "scan_id int, text string")
    fields = rules.contract(extract.map_fields(df, ["scan_id"]), ["scan_id"])
    assert fields.count() == 14
    for mandatory, want in ((rules.V.MANDATORY, {1: 85.0, 2: 5.0}), (rules.V.MANDATORY[:5], {1: 100.0, 2: 20.0})):
        found = rules.violations(fields, df, ["scan_id"], mandatory=mandatory)
        assert {r["scan_id"]: r["score"] for r in rules.scores(df, found, ["scan_id"]).collect()} == want


def test_boxes_and_second_ocr_pass(spark):
    poly = [[1.0, 2.0], [5.0, 2.0], [5.0, 4.0], [1.0, 4.0]]
    df = spark.createDataFrame([(poly, [("MRP 5", None, 0.9, "en")]), (None, [])], f"p array<array<double>>, tokens array<{sources.TOKEN}>")
    r = df.select(spatial.rectangle(F.col("p")).alias("r"), spatial.needs_second_pass(F.col("tokens")).alias("n")).collect()
    assert tuple(r[0]["r"]) == (1.0, 2.0, 5.0, 4.0) and [x["n"] for x in r] == [False, True] and r[1]["r"] is None


def test_image_paths_and_metrics_of_nothing(spark):
    df = spark.createDataFrame([('["a","b"]',), ('"a"',), ("x.jpg",), (None,)], "p string")
    assert [r[0] for r in df.select(store.image_paths(F.col("p"))).collect()] == [["a", "b"], ["a"], ["x.jpg"], None]
    scans = spark.createDataFrame([], "scan_id int, officer_id string, is_compliant boolean")
    found = spark.createDataFrame([], "scan_id int, field_name string")
    assert tuple(store.metrics(scans, found).first()) == (0, 0.0, "None")


def test_sources_round_trip(spark, tmp_path):
    rule = {"rules": [{"rule_id": "R", "clause": "C", "field": "MRP", "severity": "HIGH", "valid_units": ["g"], "extra": 1}]}
    (tmp_path / "rules.json").write_text(json.dumps(rule, indent=1))
    assert sources.read_rules(spark, str(tmp_path / "rules.json")).first()["field"] == "mrp"
    good = '```json\n{"MRP": "5", "NET_QUANTITY": null, "MANUFACTURER_ADDRESS": null, "MANUFACTURING_DATE": null, "CONSUMER_CARE": "x"}\n```'
    df = spark.createDataFrame([(good,), ('{"MRP": 1}',), ("nonsense",)], "r string")
    assert [r[0] and r[0]["MRP"] for r in df.select(sources.parse_extraction(F.col("r"))).collect()] == ["5", None, None]
    scans = spark.createDataFrame([(1,)], "scan_id long")
    sources.save_scans(scans, scans.withColumn("field_name", F.lit("mrp")), str(tmp_path / "db"))
    sources.save_scans(scans.withColumn("scan_id", F.lit(2).cast("long")), scans, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/scans")).count() == 2
    sources.wipe(spark, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/violations")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"scan_id": i, "image_index": 0, "tokens": [{"text": "MRP"}, {"text": f"Rs {i}.00"}]} for i in (1, 2)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    q = streaming.extract_stream(streaming.read_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("field = 'MRP'").select("scan_id", "v_amount").collect()
    assert sorted(map(tuple, got)) == [(1, 1.0), (2, 2.0)]


def test_reading_is_linear_in_the_text():
    """1,600 labels with values, which took minutes as column functions."""
    text = reading.normalise("MRP Rs 5.00 Net Qty 5 g Manufactured by Acme Foods Mfg Date 05/06/2024 Feedback a@b.com " * 1600)
    start = time.time()
    found = reading.read(text)
    assert [len(found[f]) for f in V.FIELDS] == [1600, 1600, 1600, 3200, 1600] and time.time() - start < 2


def test_labels_of_any_script_and_case():
    marks = reading.Marks("\u017fave MR\u212a mrp NETQTY B.No bno अधिकतमखुदरा मूल्य")
    assert [m.name for m in marks.labels("MRP")] == ["MRP", "Maximum Retail Price (Hindi)"]
    assert len(marks.by["price words"]) == 1 and len(marks.labels("NET_QUANTITY")) == 1 and len(marks.by["batch words"]) == 2


def test_marks_are_all_matches_of_all_patterns():
    rng = random.Random(1)
    parts = ["MRP", "Net", " ", "Qty", "Wt", ".", "Packed", "by", "On", "MFD", "Mfd", "Date", "exp", "Consumer", "Care", "No", "Details", "B", "LOT", "for", "queries", "customer", "é", "1", "\n", "Contact", "Us", "-", "_"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=20))
        marks = reading.Marks(text)
        for group, patterns in reading._GROUPS.items():
            want = sorted((m.start(), m.end(), i) for i, (p, _) in enumerate(patterns) for m in reading.re.finditer(p, text, reading.re.IGNORECASE))
            assert sorted((m.start, m.end, m.order) for m in marks.by.get(group, [])) == want


def test_choice_as_columns_equals_the_one_in_rows(spark):
    texts = ["MRP Rs 10.00 MRP Rs 11.00", "MRP 5 MRP Rs 5.00", "MRP Rs -1", "x", "MRP Rs 1000000", "MRP ? 5.00"]
    df = spark.createDataFrame([(t, reading.normalise(t)) for t in texts], "text string, norm string")
    by_column = extract.best(extract.candidates(df, "MRP")).select("text", "best", "confidence", "ambiguous").collect()
    in_row = extract.resolve(df.select("text"), "MRP").select("text", "best", "confidence", "ambiguous").collect()
    assert sorted(map(str, by_column)) == sorted(map(str, in_row))


def test_tokens_and_texts_give_the_same_first_pass(spark):
    tokens = [("Manufactured  by:", None, 0.3, "hi"), ("Zed Foods", [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]], 0.4, "hi"), (None, None, None, None), ("MRP Rs 5.00", None, None, "en")]
    df = spark.createDataFrame([(1, tokens), (2, []), (3, None), (3, None)], f"k int, tokens array<{sources.TOKEN}>")
    got = extract.map_tokens(df, ["k"], second_pass=False)
    rows = {r["field"]: r for r in got.where("k = 1").collect()}
    plain = {r["field"]: r for r in extract.map_fields(df.withColumn("text", X.joined_text(F.col("tokens"))).where("k = 1"), ["k"]).collect()}
    assert {f: (r["v_amount"], r["v_text"], r["raw_evidence"]) for f, r in rows.items()} == {f: (r["v_amount"], r["v_text"], r["raw_evidence"]) for f, r in plain.items()}
    maker = rows["MANUFACTURER_ADDRESS"]
    assert (plain["MANUFACTURER_ADDRESS"]["confidence"], maker["confidence"], maker["language"], len(maker["bbox"])) == ("high", "low", "hi", 1)
    assert rows["MRP"]["confidence"] == "high" and rows["MRP"]["bbox"] is None
    assert got.groupBy("k").count().orderBy("k").collect() == [(1, 5), (2, 5), (3, 10)] and extract.map_tokens(df.limit(0), ["k"]).count() == 0


def test_sweeps_of_pages_equal_those_of_texts(spark):
    rng = random.Random(3)
    parts = ["USP 20", "Rs 1,249.50", "3 pieces", "Packed by Zed Foods Limited, Pune", "FSSAI", "05/06/2024", "EXP 06/27", "1800 123 4567", "a@b.in", "MRP", "é", "JAN 24", "₹ 7", "MFD. BY x", "Net", "12345678901"]
    texts = [" ".join(rng.choices(parts, k=6)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {(r["k"], r["field"]): r["value"] for r in secondpass.sweep_rows(df, ["k"]).collect()}
    want = {}
    for k, t in enumerate(texts):
        page = layout.Page([{"text": t, "bbox": None, "confidence": None, "language": None}])
        want |= {(k, f): hit["evidence"] if f == "MRP" else hit["value"] for f in V.FIELDS if (hit := page.swept(f))}
    assert got == want and len(got) > 150


def test_anchors_in_rows_equal_those_of_tables(spark):
    rng = random.Random(4)
    words = ["MRP", "Rs 5.00", "Rs 7.00", "PRICE", "Goods", "MRP", "Net Wt", "5 kg", "7 ml"]
    tables, want = [], {}
    for k in range(60):
        tokens = []
        for i in range(8):
            x, y, w = rng.randrange(0, 300, 10), rng.randrange(0, 120, 10), rng.choice(words)
            tables.append((k, i, w, float(x), float(y), x + 50.0, y + 20.0))
            tokens.append({"text": w, "bbox": [[x, y, x + 50, y + 20]], "confidence": 0.5 + i / 100, "language": "en"})
        page = layout.Page(tokens)
        want |= {(k, f): hit["value"] for f in ("MRP", "NET_QUANTITY") if (hit := page.anchored(f))}
    df = spark.createDataFrame(tables, "k int, token_index int, text string, xmin double, ymin double, xmax double, ymax double")
    got = {}
    for f in ("MRP", "NET_QUANTITY"):
        got |= {(r["k"], f): r["value"].strip() for r in spatial.anchored(df, ["k"], f, V.SWEEP[f]).collect()}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in got) > 0.9 * len(got) and len(got) > 30


def test_boxes_of_any_form():
    corners = [[1, 2], [5, 2], [5, 4], [1, 4]]
    assert layout.bounds(corners) == layout.bounds([1, 2, 5, 4]) == layout.bounds([[1, 2, 5, 4]]) == (1, 2, 5, 4)
    assert [layout.bounds(x) for x in (None, [], [[1, 2]], [[1, 2], None, [3, 4], [5, 6]], [1, 2])] == [None] * 5


def test_blank_addresses_and_unknown_fields(spark):
    df = spark.createDataFrame([("MANUFACTURER_ADDRESS", "   "), ("MANUFACTURER_ADDRESS", " Zed "), ("EXPIRY_DATE", "06/27"), ("CONSUMER_CARE", "x"), ("MRP", None)], "field string, value string")
    assert [(r["v_text"], r["has_value"]) for r in secondpass.normalized(df).collect()] == [(None, False), ("Zed", True), ("06/27", True), (None, True), (None, False)]


def test_officers_given_as_text(spark):
    a, b = "12345678-1234-1234-1234-123456789abc", "00000000-0000-0000-0000-000000000001"
    scans = spark.createDataFrame([("s1", a, True, datetime.datetime(2024, 1, 1)), ("s2", b, False, datetime.datetime(2024, 1, 2)), ("s0", b, False, datetime.datetime(2024, 1, 2))], "scan_id string, officer_id string, is_compliant boolean, created_at timestamp")
    found = spark.createDataFrame([("s1", "mrp"), ("s2", "date")], "scan_id string, field_name string")
    assert [store.metrics(scans, found, x).first()["total"] for x in (a, a.upper(), "{" + a + "}", a.replace("-", ""), "nobody", "", None)] == [1, 1, 1, 1, 3, 3, 3]
    assert store.metrics(scans, found, a).first()["top_violation"] == "mrp"
    assert [store.latest(scans, x).first()[0] for x in (None, a)] == ["s0", "s1"] and store.latest(scans.limit(0)).first()[0] is None


def test_report_values(spark):
    values = [0.0, 5.0, 1234567.0, 123456.7, 1e-7, 0.0001, 0.00012345678, 99999.93, 999999.7, 1e22, -2.5, 100.0, 0.1, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(report.format_quantity(F.col("v"), F.lit("g"))).collect()]
    assert got == ["N/A" if v is None else f"{v:g} g" for v in values]
    long = "x" * 58 + "₹yz"
    assert spark.createDataFrame([(long,), ("a₹",), (None,)], "v string").select(report.format_manufacturer(F.col("v"))).collect() == [("x" * 57 + "...",), ("a?",), ("N/A",)]


def test_repeated_scans_and_empty_images(spark):
    page = [("MRP Rs 5.00", None, 0.9, "en")]
    df = spark.createDataFrame([(1, 0, page), (1, 0, page), (2, 0, None), (2, 1, [])], f"scan_id int, image_index int, tokens array<{sources.TOKEN}>")
    checked = pipeline.check_images(df)
    assert {r["scan_id"]: (r["n_violations"], r["score"]) for r in checked.scores.collect()} == {1: (5, 35.0), 2: (6, 5.0)}
    assert {r["image_index"] for r in checked.violations.where("field_name <> 'FONT_SIZE'").collect()} == {0}
    assert pipeline.check_images(df.limit(0)).violations.count() == 0
    rows = {r["scan_id"]: r for r in pipeline.scan_rows(df, checked).collect()}
    assert rows[2]["combined_text"] == "\n\n" and json.loads(rows[1]["extracted_fields"])["MRP"]["v_amount"] == 5.0


def test_counted_units_and_unknown_coins(spark):
    box = {"xmin": 0.0, "ymin": 0.0, "xmax": 10.0, "ymax": 10.0}
    rows = [(k, "net_quantity", raw, a, u, box) for k, raw, a, u in ((1, "10 pieces", 10.0, "pieces"), (2, "2 kg", 2.0, "kg"), (3, None, None, None))] + [(k, "mrp", "Rs 5", 5.0, None, box) for k in (1, 2, 3, 4, 5)]
    fields = spark.createDataFrame(rows, f"scan_id int, field_name string, raw_value string, amount double, unit string, bbox {rules.BOX}")
    coins = spark.createDataFrame([(k, "1_rupee" if k < 5 else "token", 21.93 / 2 if k != 4 else 0.0) for k in range(1, 6)], "scan_id int, coin_key string, coin_radius_px double")
    got = {(r["scan_id"], r["field_name"]): (r["measured_mm"], r["required_mm"], r["confidence"], r["note"]) for r in fontsize.of_fields(fields, coins, ["scan_id"]).collect()}
    assert {k for k, _ in got} == {1, 2, 3}
    assert [got[k, "mrp"] for k in (1, 2, 3)] == [(10.0, 1.0, "high", "unit not supported"), (10.0, 4.0, "high", None), (10.0, None, "low", None)]


def test_sources(spark, tmp_path):
    page = {"scan_id": 1, "image_index": 0, "tokens": [{"text": "MRP 5", "bbox": [[1, 2], [3, 2], [3, 4], [1, 4]], "confidence": 0.5, "language": "en"}]}
    (tmp_path / "t.json").write_text(json.dumps(page) + "\nbroken\n")
    tokens = sources.read_tokens(spark, str(tmp_path / "t.json"))
    assert tokens.count() == 1
    out = json.loads(tokens.select(sources.tokens_to_json(F.col("tokens")).alias("j")).first()["j"])
    assert out == page["tokens"]
    found = spark.createDataFrame([([("a", [[1.0]], "0.5"), (None, [[1.0]], "1"), ("b", None, "1"), ("c", [[1.0]], "?")],)], "d array<struct<text:string,bbox:array<array<double>>,confidence:string>>")
    assert [(t["text"], t["confidence"]) for t in found.select(sources.detections_to_tokens(F.col("d")).alias("t")).first()["t"]] == [("a", 0.5), ("c", None)]
    (tmp_path / "x.JPG").write_bytes(b"1")
    (tmp_path / "y.bin").write_bytes(b"2")
    assert sorted((r["mime"] or "", bytes(r["content"])) for r in sources.read_images(spark, str(tmp_path / "[xy].*")).collect()) == [("", b"2"), ("image/jpeg", b"1")]
    (tmp_path / "labels.json").write_text(json.dumps([{"image": "a.jpg", "MRP": "5"}]))
    (tmp_path / "font.json").write_text(json.dumps([{"image": "a.jpg", "tap_point": [1, 2], "coin_key": "1_rupee", "ocr_bbox": [1, 2, 3, 4], "ground_truth_mm": 2.5}]))
    assert sources.read_labels(spark, str(tmp_path / "labels.json")).first()["MRP"] == "5" and sources.read_font_labels(spark, str(tmp_path / "font.json")).first()["ground_truth_mm"] == 2.5


def test_contacts_errors_and_public_keys(spark):
    df = spark.createDataFrame([("1 2", " A@B.in", 2.0, 2.5, {"_a": 1, "_image_index": 2, "b": 3}), (None, None, None, 1.0, {})], "p string, e string, m double, t double, k map<string,int>")
    got = df.select(evaluate.contact(F.col("p"), F.col("e")), F.round(evaluate.relative_error(F.col("m"), F.col("t")), 6), merge.public_keys(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("1 2 / a@b.in", 0.2, {"_image_index": 2, "b": 3}), (None, None, {})]


def test_repeated_batches_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "MRP Rs 5.00")], "scan_id long, image_index int, text string")
    for _ in range(2):
        extract.map_fields(df, ["scan_id", "image_index"]).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=0")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_values_on_certificates(spark):
    df = spark.createDataFrame([("a", datetime.datetime(2024, 5, 6), True, 84.5, "Tea ₹"), (None, None, None, None, None)], "scan_key string, created_at timestamp, is_compliant boolean, compliance_score double, product_name string")
    df = df.withColumn("scan_id", F.monotonically_increasing_id())
    got = report.certificates(df, spark.createDataFrame([], "scan_id long, field_name string, severity string, issue string")).orderBy(F.col("scan_key").isNull()).collect()
    assert (got[0]["certificate"], got[0]["report"], got[0]["issued"], got[0]["verdict"], got[0]["score"], got[0]["commodity"], got[0]["violations"]) == ("CERT-A", "CR-2024-A", "06-05-2024", "PASS", "84", "Tea ?", [])
    assert (got[1]["verdict"], got[1]["score"], got[1]["commodity"]) == ("FAIL", "N/A", "Packaged Product")
    values = spark.createDataFrame([("2024-05",), (None,), ("₹",)], "v string")
    assert [r[0] for r in values.select(report.format_date(F.col("v"))).collect()] == ["2024-05", "N/A", "?"]


def _png_of(a, filters=(0, 1, 2, 3, 4), extra=b""):
    """A PNG image whose rows take all filters in turn."""
    import struct
    import zlib

    import numpy as np

    h, w = a.shape[:2]
    n = 1 if a.ndim == 2 else a.shape[2]
    rows, flat = b"", a.reshape(h, w * n).astype(int)
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * n, int)
        left, corner = np.concatenate([np.zeros(n, int), flat[y][:-n]]), np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - corner
        paeth = np.array([min((a_, b_, c_), key=lambda v: abs(q - v)) for a_, b_, c_, q in zip(left, up, corner, p)])
        k = filters[y % len(filters)]
        rows += bytes([k]) + bytes(((flat[y] - (0, left, up, (left + up) // 2, paeth)[k]) % 256).tolist())
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_are_decoded_and_turned():
    import numpy as np

    from tagwise.operators import pixels

    rng = np.random.default_rng(0)
    for shape in ((7, 5), (6, 9, 3), (5, 4, 4)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (pixels.decode(_png_of(a)) == a).all()
    a = rng.integers(0, 256, (4, 3, 3)).astype(np.uint8)
    assert (pixels.decode(b"P6\n# x\n3 4\n255\n" + a.tobytes()) == a).all()
    tiff = b"MM\0*\0\0\0\x08\0\x01" + b"\x01\x12\0\x03\0\0\0\x01\0\x06\0\0" + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(tiff) + 8).to_bytes(2, "big") + b"Exif\0\0" + tiff + b"\xff\xda"
    assert pixels.orientation(jpeg) == 6 and pixels.orientation(b"\xff\xd8\xff\xda") == pixels.orientation(b"x") == 1
    one = np.array([[1, 2], [3, 4]])
    assert [pixels.upright(one, k).tolist() for k in range(1, 9)] == [
        [[1, 2], [3, 4]], [[2, 1], [4, 3]], [[4, 3], [2, 1]], [[3, 4], [1, 2]], [[1, 3], [2, 4]], [[3, 1], [4, 2]], [[4, 2], [3, 1]], [[2, 4], [1, 3]],
    ]
    assert pixels.rotate(one, 90).tolist() == [[3, 1], [4, 2]] and pixels.rotate(one, 270).tolist() == [[2, 4], [1, 3]]
    small = pixels.shrink(np.arange(64, dtype=np.uint8).reshape(8, 8), 4)
    assert small.tolist() == [[round((16 * i + 2 * j) + 4.5) for j in range(4)] for i in range(4)]
    assert pixels.shrink(np.zeros((30, 10, 3), np.uint8), 7).shape == (7, 2, 3) and pixels.shrink(one, 2) is one


def test_faint_strokes_stand_out():
    import numpy as np

    from tagwise.operators import pixels

    a = np.full((64, 64), 120, np.uint8)
    a[20:44, 30:33] = 100  # a faint stroke
    out = pixels.stamped(a)
    assert (out[22:42, 31] == 255).all() and (out[:, :20] == 0).mean() > 0.9 and set(np.unique(out)) <= {0, 255}
    dots = np.full((64, 64), 200, np.uint8)
    dots[10:50:2, 30] = 40
    assert (pixels.stamped(dots)[12:48, 30] == 255).all()  # gaps of one pixel are closed
    assert pixels.stamped(np.zeros((1, 1), np.uint8)).shape == (1, 1)


def test_tokens_of_images(spark):
    import numpy as np

    from tagwise.operators import pixels

    def marks_reader():
        """Reads "MRP 5" where the upper left pixel is bright; fails on arrays that are higher than wide."""

        def read(a, faint):
            if a.shape[0] > a.shape[1]:
                raise ValueError("too high")
            if faint:
                return [([[0, 0], [1, 1]], "x", 0.5), ("malformed",)]
            return [([[0, 0], [1, 0], [1, 1], [0, 1]], "MRP 5" if a[0, 0].max() > 200 else "?", 0.9)]

        return read

    a = np.zeros((4, 6, 3), np.uint8)
    a[-1, -1] = 255  # upside down
    df = spark.createDataFrame([(1, bytearray(_png_of(a))), (2, bytearray(b"broken")), (3, None)], "k int, content binary")
    got = {r["k"]: r["tokens"] for r in pixels.recognise(df, marks_reader, ["k"]).collect()}
    assert [t["text"] for t in got[1]] == ["MRP 5", "x"] and got[2] == got[3] == []
    assert pixels.recognise(df.limit(0), marks_reader, ["k"]).count() == 0


def test_batches_longer_than_a_slice(spark):
    df = spark.range(1000).coalesce(1).select("id", F.concat(F.lit("MRP Rs "), (F.col("id") + 1).cast("string"), F.lit(".00")).alias("norm"))
    found = extract.candidates(df, "MRP").select("id", F.get("candidates", F.lit(0))["amount"].alias("amount")).collect()
    assert len(found) == 1000 and all(r["amount"] == r["id"] + 1 for r in found)
    assert X.spread(spark.range(10)).count() == 10


def test_pages_are_read_once(spark):
    for name in ("image_violations", "stored_scan_rows"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name
        assert "SortMergeJoin [lower(field_name" not in plan, name


def test_enrichment_in_the_row(spark):
    page = [("MRP Rs 5.00", None, 0.9, "en"), ("Expiry 06/2027", [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]], 0.9, "en")]
    images = spark.createDataFrame([(1, 0, page), (1, 0, page), (1, 1, None), (2, 0, []), (None, 0, page), (4, None, page)], f"scan_id int, image_index int, tokens array<{sources.TOKEN}>")
    extra = [(1, 0, "MRP", "Rs 9"), (1, 1, "MRP", "Rs 7"), (2, 0, "NET_QUANTITY", "3 kg"), (2, 0, "NET_QUANTITY", "?"), (2, 5, "MRP", "1"), (3, 0, "MRP", "1"), (None, 0, "NET_QUANTITY", "2 g"), (4, None, "NET_QUANTITY", "2 g"), (2, 0, "MRP", None)]
    given = spark.createDataFrame(extra, "scan_id int, image_index int, field string, value string")
    want = secondpass.enrich(pipeline.map_images(images), given, pipeline.IMAGE)
    got = pipeline.map_images(images, given)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    scores = {r["scan_id"]: r["n_violations"] for r in pipeline.check_images(images, given).scores.collect()}
    assert scores == {1: 4, 2: 5, None: 4, 4: 4}


def test_pages_that_say_the_same(spark):
    box = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]
    say = lambda c, lang, b=None: [("Manufactured by Acme Foods Ltd", b, c, lang)]
    pages = [say(0.9, "en"), say(0.1, "en"), say(0.9, "hi"), say(0.9, "en", box), say(0.9, "en"), [(None, None, 0.9, "en"), *say(0.9, "en")]]
    df = spark.createDataFrame(list(enumerate(pages)), f"k int, tokens array<{sources.TOKEN}>").coalesce(1)
    rows = {r["k"]: r for r in extract.map_tokens(df, ["k"], second_pass=False, spread=False).where("field = 'MANUFACTURER_ADDRESS'").collect()}
    assert [(rows[k]["confidence"], rows[k]["language"], rows[k]["bbox"]) for k in range(6)] == [("high", "en", []), ("low", "en", []), ("high", "hi", []), ("high", "en", [box]), ("high", "en", []), ("high", "en", [])]


def test_second_pass_values_that_are_no_numbers(spark):
    values = ["13/2024", "05/13/2024", "JAN24", "FOO24", "123456", "5.6.24", "١٢/٢٠٢٤", "", None, "x"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(secondpass.normalize_date(F.col("v"))).collect()]
    assert got == [None, "2024-13-05", "2024-01", None, None, "2024-06-05", None, None, None, None]
