import json

import pytest
from pyspark.sql import functions as F

from tagwright.operators import report
from tagwright.sources import ingest, schemas, sinks
from tagwright.streaming import ingest as streaming

WINE = {
    "wine_name": "Castel Huniade", "producer": None, "vintage": "2019", "wine_type": "red", "sweetness": "dry", "grape_varieties": ["Merlot"], "region": None, "country": None,
    "volume_ml": "750", "abv_percent": None, "price": 54.59, "currency": None, "price_text": "54,59 lei", "price_kind": "shelf", "original_price": None, "unit_price_text": "72,79 RON/L",
    "promo_text": None, "raw_tag_text": "VIN ROSU 0.75L", "raw_label_text": None, "ocr_price_index": 2.0, "name_source": "price_tag", "pairing_confidence": "high", "pairing_note": None,
    "bottle_bbox": {"x0": 0, "y0": 0, "x1": 0.5, "y1": 1}, "tag_bbox": None,
}
ANSWER = {"wines": [WINE], "unreadable_tags": [{"raw_text": "?", "price": None, "currency": None, "reason": "blur", "tag_bbox": None}], "non_wine_present": False, "notes": ""}
JOB = {"job_id": "j1", "photo": "shop/a.jpg", "photo_sha256": "s", "photo_size": [1000, 500], "store": "Shop", "store_source": "folder", "band_index": 0, "band_label": "shelf 1 (3 prices)", "crop_box": [0.2, 0.0, 0.6, 1.0], "ocr_prices": [58.99, 54.59, 54.70]}


def without(doc, key):
    return {k: v for k, v in doc.items() if k != key}


@pytest.mark.parametrize(
    ("doc", "valid"),
    [
        (ANSWER, True), ({"result": ANSWER}, True), ({"other": ANSWER}, False), (without(ANSWER, "notes"), False), ({**ANSWER, "wines": []}, True), ({**ANSWER, "extra": 1}, True),
        ({**ANSWER, "wines": [without(WINE, "producer")]}, False), ({**ANSWER, "wines": [{**WINE, "wine_type": "blue"}]}, False), ({**ANSWER, "wines": [{**WINE, "price": "cheap"}]}, False),
        ({**ANSWER, "wines": [{**WINE, "ocr_price_index": 2.5}]}, False), ({**ANSWER, "wines": [{**WINE, "wine_name": None}]}, False), ('{"wines": [', False), ("[]", False), ("", False),
    ],
)
def test_answers_are_validated_whole(spark, doc, valid):
    raw = spark.createDataFrame([("j", doc if isinstance(doc, str) else json.dumps(doc))], "job_id string, raw string")
    got = ingest.parse_answers(raw).first()
    assert got["valid"] is valid and (got["wines"] is None) is not valid


def _files(tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    (folder / "j1.json").write_text(json.dumps(ANSWER))
    (folder / "j2.json").write_text("{broken")
    (tmp_path / "manifest.jsonl").write_text("\n".join([json.dumps(JOB), "", json.dumps({**JOB, "job_id": "j2"}), json.dumps({**JOB, "job_id": "j3"})]))
    return folder


def test_rows_from_answers(spark, tmp_path):
    folder = _files(tmp_path)
    jobs, found = ingest.manifest(spark, str(tmp_path / "manifest.jsonl")), ingest.answers(spark, str(folder))
    assert sorted(r["job_id"] for r in ingest.pending(jobs, found).collect()) == ["j2", "j3"]
    assert ingest.missing_errors(jobs, found).count() == 2
    assert tuple(report.status(jobs, found).first()) == (3, 1, 2, "33%")
    rows, unmatched = report.assemble(jobs, found, "m", "now")
    r = rows.first()
    assert (r["volume_ml"], r["currency"], r["price_check"], r["unit_price_check"], r["ocr_price_check"]) == (750.0, "RON", "ok", "ok", "ok")
    assert r["bottle_bbox"] == "0.2000,0.0000,0.4000,1.0000" and r["needs_review"] is None and r["grape_varieties"] == "Merlot"
    assert unmatched.first()["raw_text"] == "?"
    index = report.folder_index(rows.withColumn("duplicate_of", F.lit(None).cast("string")), unmatched).first()
    assert (index["folder"], index["n_rows"], index["median_price"], index["currency"]) == ("shop", 1, 54.59, "RON")
    n = sinks.write_csv_file(rows, str(tmp_path / "out.csv"))
    again = ingest.table(spark, str(tmp_path / "out.csv"))
    assert n == 1 and again.columns == list(schemas.ROW_COLUMNS) and again.first()["price"] == 54.59 and again.first()["producer"] is None
    assert "Castel Huniade" in report.review_html(rows.withColumn("row_id", F.lit("W1"))).first()["section"]


def test_stream_collects_new_files(spark, tmp_path):
    folder, target, mark = _files(tmp_path), str(tmp_path / "table"), str(tmp_path / "mark")
    streaming.collect_available(spark, str(folder), target, mark)
    assert [r["job_id"] for r in streaming.latest_answers(spark, target).collect()] == ["j1"]
    (folder / "j3.json").write_text(json.dumps(ANSWER))
    streaming.collect_available(spark, str(folder), target, mark)
    assert sorted(r["job_id"] for r in streaming.latest_answers(spark, target).collect()) == ["j1", "j3"]


def test_a_repeated_batch_adds_nothing_and_quiet_ends_the_collection(spark, tmp_path):
    folder, target, mark = _files(tmp_path), str(tmp_path / "table"), str(tmp_path / "mark")
    assert streaming.collect_available(spark, str(folder), target, mark) > 0
    before = spark.read.parquet(target).count()
    streaming.collect_available(spark, str(folder), target, str(tmp_path / "other-mark"))  # the same first batch again
    assert spark.read.parquet(target).count() == before
    assert streaming.collect_until_quiet(spark, str(folder), target, mark, quiet=2, every=0.0) == 2


def test_mirror_tree(spark, tmp_path):
    rows = [("W1", "Castel, \"x\"", "a/b/1.jpg", 2.5, None), ("W2", "Vin", "a/b/2.jpg", 3.5, None), ("W1d1", "Castel", "a/b/3.jpg", 2.5, "W1"), ("W3", "Rosu", "4.jpg", None, None)]
    made = spark.createDataFrame(rows, "row_id string, wine_name string, photo string, price double, duplicate_of string").withColumns({"needs_review": F.lit(""), "currency": F.lit("RON")})
    stray = spark.createDataFrame([("a/b/1.jpg", "9,99"), ("c d/5.jpg", "1")], "photo string, raw_text string")
    for _ in range(2):  # a second run replaces the first
        sinks.write_mirror(made, stray, str(tmp_path / "out"))
    found = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.csv") if "index" not in p.parts and not p.name.startswith("."))
    assert found == ["a/b/b.csv", "a/b/unmatched.csv", "c d/c d.csv", "c d/unmatched.csv", "rows.csv"]
    table = lambda name: ingest.table(spark, str(tmp_path / "out" / name))
    assert sorted((r["row_id"], r["wine_name"]) for r in table("a/b/b.csv").collect()) == [("W1", "Castel, \"x\""), ("W2", "Vin")]
    assert table("c d/c d.csv").count() == 0 and [r["raw_text"] for r in table("a/b/unmatched.csv").collect()] == ["9,99"]
    index = {r["folder"]: (r["csv"], r["n_rows"]) for r in spark.read.option("header", "true").csv(str(tmp_path / "out" / "index")).collect()}
    assert index == {"a/b": ("a/b/b.csv", "2"), ".": ("rows.csv", "1"), "c d": ("c d/c d.csv", "0")}


def test_latest_answer_by_file_time(spark, tmp_path):
    rows = [("a", True, "new", 200, 0), ("a", True, "old", 100, 5), ("b", True, "first", 100, 1), ("b", True, "second", 100, 2)]
    made = spark.createDataFrame(rows, "job_id string, valid boolean, notes string, at long, batch int").withColumn("landed_at", F.timestamp_seconds("at")).drop("at")
    made.write.partitionBy("batch").parquet(str(tmp_path / "t"))
    assert {r["job_id"]: r["notes"] for r in streaming.latest_answers(spark, str(tmp_path / "t")).collect()} == {"a": "new", "b": "second"}


def test_batch_results(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "custom_id string, n int")
    results = spark.createDataFrame([("a", "succeeded", "{}"), ("b", "errored", "x"), ("z", "succeeded", "{}")], "custom_id string, kind string, raw string")
    got = {r["custom_id"]: (r["raw"], r["error"]) for r in ingest.batch_results(items, results).collect()}
    assert got == {"a": ("{}", None), "b": (None, "batch result: errored")}


def test_photo_metadata_arithmetic(values):
    south, east = ingest.signed_degrees(F.lit(44), F.lit(30), F.lit(36), F.lit("s")), ingest.signed_degrees(F.lit(26), F.lit(6), F.lit(0), F.lit("E"))
    taken, never = ingest.taken_at(F.lit("rubbish"), F.lit("2026:06:14 10:11:12"), F.lit("2025:01:01 00:00:00")), ingest.taken_at(F.lit(None).cast("string"))
    assert values([south, east, taken, never], [(1,)], "n int") == [(-44.51, 26.1, "2026-06-14 10:11:12", None)]


def test_pages(spark, tmp_path):
    page = {"path": "a", "width": 10, "height": 10, "error": None, "lines": [{"t": "54,59", "c": 1.0, "h": 9, "b": [0.1, 0.2, 0.3, 0.4]}]}
    (tmp_path / "p.jsonl").write_text(json.dumps(page))
    found = ingest.pages(spark, str(tmp_path / "p.jsonl"))
    wanted = spark.createDataFrame([(0, "b"), (1, "a")], "ordinal int, path string")
    got = {r["path"]: r["error"] for r in ingest.pages_for(wanted, found).collect()}
    assert got == {"a": None, "b": "the recogniser returned no record"}
    assert tuple(ingest.lines(found).first()) == ("a", 0, "54,59", 1.0, 9, 0.1, 0.2, 0.3, 0.4)


def test_truth_and_catalogue(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿# note\n  # more\nphoto,rail,position,price,currency,volume_ml,name_contains,notes\na,1,1,27.99,RON,750,Huniade,\na,1,2,,RON,,,\n")
    got = ingest.truth(spark, str(tmp_path / "t.csv")).collect()
    assert [(r["price"], r["volume_ml"], r["name_contains"]) for r in got] == [(27.99, 750.0, "Huniade")]
    (tmp_path / "c.tsv").write_text("﻿Category\tGroup\tWinery\tLabel\tAssortment (product line)\tSKU name (unique)\nc\tg\t w \tl\ta\ts\n")
    assert tuple(ingest.catalogue(spark, str(tmp_path / "c.tsv")).first()) == ("c", "g", "w", "l", "a", "s")


def test_verdicts(spark):
    batches = spark.createDataFrame([("f1", "K", ["A | B | C", "D"]), ("f2", "K", ["E"])], "file string, key string, candidates array<string>")
    picks = spark.createDataFrame([("f1", 0, "K", 2, None), ("f2", 0, "K", 9, "high"), ("f1", 1, "Z", 1, None)], "file string, ordinal int, key string, choice int, confidence string")
    assert [tuple(r) for r in ingest.verdicts(batches, picks).collect()] == [("K", None, "high")]


def test_photos_and_schema(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.JPG", "x/b.heic", "x/.c.jpg", "d.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in ingest.photos(spark, str(tmp_path)).collect()) == ["a.JPG", "b.heic"]
    schema = sinks.json_schema(spark.createDataFrame([], "a string, b array<double>").schema)
    assert schema["required"] == ["a", "b"] and schema["additionalProperties"] is False
    assert ingest.store_aliases("stores:\n  Mega: [mega_image, MI]\n") == {"mega": "Mega", "mega image": "Mega", "mi": "Mega"}
