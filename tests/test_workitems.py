from pyspark.sql import functions as F

from tagwright.functions import geometry
from tagwright.operators import workitems

from .test_operators import _page

C = F.col


def test_jobs(spark):
    rail = [(f"{20 + i},99", 0.1 + 0.09 * i, 0.5, 0.04, 0.01) for i in range(5)]
    text = [("VIN 0.75L", 0.1, 0.48, 0.05, 0.01), ("0,50", 0.1, 0.515, 0.03, 0.005), ("bottle", 0.19, 0.3, 0.03, 0.01), ("floor", 0.5, 0.9, 0.1, 0.01)]
    photos = spark.createDataFrame([("p", "sha", 4284, 5712)], "photo string, photo_sha256 string, width int, height int")
    got = {r["band_index"]: r for r in workitems.jobs(_page(spark, rail + text), photos, "v1").collect()}
    band = next(r for r in got.values() if r["ocr_prices"])
    assert band["ocr_prices"] == [20.99, 21.99, 22.99, 23.99, 24.99] and band["band_label"].endswith("(5 prices)")
    assert "text on the same tag: 'VIN 0.75L'" in band["ocr_digest"] and "'bottle'" in band["ocr_digest"] and "other numbers printed on this tag: '0,50'" in band["ocr_digest"]
    strip = [r for r in got.values() if r["warnings"] == ["no price rail was detected here"]]
    assert strip and all("unread strip" in r["band_label"] for r in strip) and any("'floor'" in r["ocr_digest"] for r in strip)
    assert len({r["job_id"] for r in got.values()}) == len(got)


def test_warnings(values):
    rows = [([1.0, 1.0, 2.0, 2.0, 3.0, 3.0], 0.02), ([1.0, 1.0, 2.0], 0.5)]
    got = values([workitems.band_warnings(F.lit(False), F.lit(False), C("h"), C("p"))], rows, "p array<double>, h double")
    assert [len(g[0]) for g in got] == [2, 0]


def test_regions(values):
    band = F.struct(C("w").alias("contains_wine"), F.lit(0.1).alias("bottles_y0"), C("y").alias("bottles_y1"), F.lit(0.1).alias("tags_y0"), C("y").alias("tags_y1"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1"))
    got = values([geometry.band_regions(band, F.lit(4000), F.lit(3000), F.lit(2576), F.lit("b"))], [(True, 0.5), (False, 0.5), (None, 0.1)], "w boolean, y double")
    assert [len(g[0]) for g in got] == [2, 0, 0] and got[0][0][0]["has_rail"] is True
    grid = values([geometry.grid_regions(C("w"), C("h"))], [(4000, 5000)], "w int, h int")[0][0]
    assert grid[0]["label"].startswith("grid row 1/") and max(t["y1"] for t in grid) == 5000 and max(t["x1"] for t in grid) in (3999, 4000)
    tiles = values([geometry.fallback_tiles(C("w"), C("h"), F.lit(0.0), F.lit(1.0))], [(4284, 5712), (1200, 1600)], "w int, h int")
    assert [len(t[0]) for t in tiles] == [6, 1] and tiles[0][0][-1]["x1"] == 1.0
    box = F.struct(F.lit(0.5).alias("x0"), F.lit(0.5).alias("y0"), F.lit(0.6).alias("x1"), F.lit(0.6).alias("y1"))
    assert tuple(values([geometry.crop_box(box, C("w"), C("w"))], [(1000,)], "w int")[0][0]) == (496, 496, 604, 604)
