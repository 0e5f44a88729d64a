"""Registered queries over synthetic shelf pages, each beside an SQL oracle that follows from how the pages are made.

A page holds 27 orders of a customer as price tags, nine to a row, so that what the layout operators have
to find - rails, bands, slots, warnings - can be said in closed form. Other queries make one small page per part.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagwright.functions import geometry, names
from tagwright.operators import brands, report, score, shelves, workitems
from tagwright.plans.catalog import _sql_tokens, query, t
from tagwright.sources import ingest, sinks
from tagwright.sources.scratch import scratch

# --- whole pages ------------------------------------------------------------------

_PAGES = """WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth FROM orders),
  l AS (SELECT o_custkey || CASE WHEN nth >= 27 THEN '-' || nth // 27 ELSE '' END AS photo, nth % 27 AS line_id, (nth % 27) // 9 AS rail, nth % 9 + 1 AS slot, printf('%.2f', o_totalprice % 1000 + 1) AS text FROM o),
  r AS (SELECT photo, rail, count(*) AS n, 0.05 + 0.1 * (count(*) - 1) + 0.04 AS far FROM l GROUP BY ALL),
  b AS (SELECT *, CASE WHEN rail = 0 THEN 0.0 ELSE 0.21 + 0.25 * (rail - 1) END AS y0, 0.222 + 0.25 * rail AS y1, far - 0.01 < 0.24 AS narrow, greatest(0.0, least((0.05 + far) / 2 - 0.12, 0.76)) AS slid FROM r),
  w AS (SELECT photo, rail, n, y0, y1, CASE WHEN narrow THEN slid ELSE 0.03 END AS x0, CASE WHEN narrow THEN slid + 0.24 ELSE least(1.0, far + 0.02) END AS x1 FROM b)"""


def page_lines(spark, d):
    """Pages of 27 orders per customer, their prices in rows of nine; further orders go to further pages."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = t(spark, d, "orders").withColumn("nth", nth).withColumns({"page": F.floor(F.col("nth") / 27), "line_id": (F.col("nth") % 27).cast("int")})
    photo = F.concat_ws("-", F.col("o_custkey").cast("string"), F.when(F.col("page") > 0, F.col("page").cast("string")))
    x, y = 0.05 + 0.1 * (F.col("line_id") % 9), 0.2 + 0.25 * F.floor(F.col("line_id") / 9)
    text = F.format_string("%.2f", F.pmod("o_totalprice", F.lit(1000)) + 1)
    return o.select(photo.alias("photo"), "line_id", text.alias("text"), F.lit(1.0).alias("conf"), x.alias("x0"), y.alias("y0"), (x + 0.04).alias("x1"), (y + 0.01).alias("y1"))


@query(f"{_PAGES} SELECT photo, rail::INTEGER AS index, rail::INTEGER AS rail, n AS n_slots, round(x0, 6)::DOUBLE AS x0, round(y0, 6)::DOUBLE AS y0, round(x1, 6)::DOUBLE AS x1, round(y1, 6)::DOUBLE AS y1 FROM w")
def shelf_bands(spark, d):
    whole, slots, _ = shelves.bands(page_lines(spark, d))
    n = slots.groupBy("band").agg(F.count("*").alias("n_slots"))
    return whole.join(n, "band", "left").select("photo", "index", "rail", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""{_PAGES}, x AS (SELECT l.photo, l.rail, slot, text, greatest(0.0, least(1.0, (((0.05::DOUBLE + 0.1::DOUBLE * (slot - 1)) + (0.05::DOUBLE + 0.1::DOUBLE * (slot - 1) + 0.04::DOUBLE)) / 2 - x0::DOUBLE) / (x1::DOUBLE - x0::DOUBLE))) AS x FROM l JOIN w ON l.photo = w.photo AND l.rail = w.rail),
  g AS (SELECT photo, rail, count(*) AS n, string_agg(text, ',' ORDER BY slot) AS prices, string_agg(printf('%d. price %s (read as ''%s'', confidence 1.0, x=%.3f)', slot, text, text, x), chr(10) ORDER BY slot) AS digest FROM x GROUP BY ALL),
  c AS (SELECT photo, rail, count(*) AS twice FROM (SELECT photo, rail, text FROM l GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
  j AS (SELECT w.photo, w.rail, g.n, prices, digest, coalesce(twice, 0) AS twice, printf('%.4f,%.4f,%.4f,%.4f', x0::DOUBLE, y0::DOUBLE, x1::DOUBLE, y1::DOUBLE) AS crop FROM w JOIN g ON w.photo = g.photo AND w.rail = g.rail LEFT JOIN c ON w.photo = c.photo AND w.rail = c.rail)
  SELECT substr(sha256('v1|sha' || photo || '|' || rail || '|' || crop || '|' || n), 1, 16) AS job_id, photo, rail::INTEGER AS band_index, 'shelf ' || (rail + 1) || ' (' || n || CASE WHEN n = 1 THEN ' price)' ELSE ' prices)' END AS band_label,
  crop, prices, 'Local OCR read ' || n || ' price(s) along this shelf''s tag rail, listed left to right.' || chr(10) || digest AS ocr_digest, CASE WHEN twice >= 3 THEN 'several prices on this rail repeat' ELSE '' END AS warnings FROM j""")
def page_jobs(spark, d):
    """Work items of all pages, one per band."""
    lines = page_lines(spark, d)
    photos = lines.select("photo", F.concat(F.lit("sha"), "photo").alias("photo_sha256"), F.lit(1000).alias("width"), F.lit(800).alias("height")).distinct()
    return workitems.jobs(lines, photos, "v1").select(
        "job_id", "photo", "band_index", "band_label", F.concat_ws(",", *[F.format_string("%.4f", F.get("crop_box", F.lit(i))) for i in range(4)]).alias("crop"),
        F.concat_ws(",", F.transform("ocr_prices", lambda p: F.format_string("%.2f", p))).alias("prices"), "ocr_digest", F.concat_ws("; ", "warnings").alias("warnings"),
    )


# --- small pages, one per part or per forty parts --------------------------------------


def _pick(k, *values):
    """The value at place k."""
    return F.element_at(F.array(*[v if not isinstance(v, (str, float, int)) else F.lit(v) for v in values]), (k + 1).cast("int"))


def _part_lines(spark, d, spec, photo=None):
    """lines of a page per part: spec gives (line_id, text, x0, y0, x1, y1) as columns or values, a NULL text leaves the line out."""
    p = t(spark, d, "part")
    col = lambda v: F.lit(v) if isinstance(v, (str, float, int)) else v
    one = F.array(*[F.struct(F.lit(i).alias("line_id"), col(text).cast("string").alias("text"), *[col(v).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)]) for i, text, *box in spec])
    each = p.select("*", F.explode(one).alias("l"))
    return each.select((photo if photo is not None else F.col("p_partkey").cast("string")).alias("photo"), "p_partkey", "p_size", "l.*", F.lit(0.9).alias("conf")).filter("text IS NOT NULL")


@query("""WITH l AS (SELECT (p_partkey // 40)::VARCHAR AS photo, (p_partkey % 40)::INTEGER AS line_id, p_size % 8 AS k FROM part), f AS (SELECT photo, max((k = 0)::INT) AS floor FROM l GROUP BY 1)
  SELECT photo, line_id, 12.5::DOUBLE AS value, CASE WHEN k = 0 THEN 'separated' ELSE 'bare' END AS kind FROM l JOIN f USING (photo) WHERE k IN (0, 1) OR (k = 2 AND floor = 0)""")
def line_kinds(spark, d):
    """Separated and bare prices; too small, a measure, a decoy, one digit over and over, unsure, no price."""
    k = F.col("p_size") % 8
    text = _pick(k, "12.50", "1250", "1250", "12.50 L", "garantie 0.50", "1111", "12.50", "Castel")
    y = (F.col("p_partkey") % 40) / 40.0
    lines = t(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("string").alias("photo"), (F.col("p_partkey") % 40).cast("int").alias("line_id"), text.alias("text"), F.when(k == 6, 0.3).otherwise(0.9).alias("conf"),
        F.lit(0.1).alias("x0"), y.alias("y0"), F.lit(0.2).alias("x1"), (y + F.when(k == 2, 0.01).otherwise(0.03)).alias("y1"))
    return shelves.price_tokens(lines).select("photo", "line_id", "value", "kind")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE TRUE END AS flipped, p_size % 3 <> 0 AS measure FROM part""")
def text_shapes(spark, d):
    """Texts that are a price upside down, and suffixes that make a number a measure."""
    k = F.col("p_size") % 4
    text = _pick(k, "0S.ZI", "12.50", "Castel", " 0S'SI ")
    suffix = _pick(F.col("p_size") % 3, "lei", " ml", "Ltr.")
    return t(spark, d, "part").select("p_partkey", shelves.looks_flipped(text).alias("flipped"), shelves.is_measure(suffix).alias("measure"))


@query("""SELECT p_partkey::VARCHAR AS photo, 0 AS l_line_id, 1 AS r_line_id, 10 + p_size + 0.5::DOUBLE AS value, (10 + p_size) || ',50' AS text, 'split' AS kind FROM part WHERE p_size % 4 IN (0, 2)""")
def split_boxes(spark, d):
    """A price read as two boxes; the cents too far off, on another line, or wanted by two whole parts."""
    k = F.col("p_size") % 4
    spec = [(0, 10 + F.col("p_size"), 0.10, 0.10, 0.20, 0.20), (1, "50", _pick(k, 0.22, 0.30, 0.22, 0.22), _pick(k, 0.10, 0.10, 0.10, 0.70), _pick(k, 0.27, 0.35, 0.27, 0.27), _pick(k, 0.16, 0.16, 0.16, 0.76)), (2, F.when(k == 2, "9"), 0.11, 0.11, 0.21, 0.21)]
    lines = _part_lines(spark, d, spec).select("photo", "line_id", "text", "conf", "x0", "y0", "x1", "y1")
    return shelves.split_prices(lines).select("photo", "l_line_id", "r_line_id", "value", "text", F.lit("split").alias("kind"))


@query("""SELECT p_partkey::VARCHAR AS band, 0 AS line_id, CASE p_size % 4 WHEN 0 THEN 2 WHEN 3 THEN NULL ELSE 1 END AS slot, CASE p_size % 4 WHEN 0 THEN 'tag' WHEN 3 THEN 'stray' ELSE 'label' END AS how FROM part""")
def line_slots(spark, d):
    """A line on a tag, over a slot, within reach of one, and beside them all."""
    k = F.col("p_size") % 4
    lines = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("band"), F.lit(0).alias("line_id"), _pick(k, 0.49, 0.17, 0.33, 0.98).alias("x0"), _pick(k, 0.50, 0.10, 0.10, 0.10).alias("y0"), _pick(k, 0.51, 0.21, 0.35, 1.0).alias("x1"), _pick(k, 0.51, 0.15, 0.15, 0.15).alias("y1"))
    places = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("slot"), F.lit(x).alias("x0"), F.lit(0.5).alias("y0"), F.lit(x + 0.04).alias("x1"), F.lit(0.51).alias("y1")) for i, x in enumerate((0.18, 0.48, 0.78))]))
    slots = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("band"), places.alias("s")).select("band", "s.*")
    return shelves.assign_lines(lines, slots)


@query("""WITH l AS (SELECT p_partkey::VARCHAR AS photo, p_size % 2 AS k, unnest([0, 1, 2]) AS line_id FROM part) SELECT photo, line_id FROM l WHERE NOT (line_id = 1 AND k = 0)""")
def lines_read_twice(spark, d):
    """Of two readings of one line the longer text stays; what overlaps little stays as well."""
    k = F.col("p_size") % 2
    spec = [(0, "castel rosu", 0.1, 0.1, 0.3, 0.15), (1, "castel", _pick(k, 0.11, 0.25), 0.1, _pick(k, 0.3, 0.45), 0.15), (2, "castel rosu", 0.1, 0.5, 0.3, 0.55)]
    lines = _part_lines(spark, d, spec).select("photo", "line_id", "text", "conf", "x0", "y0", "x1", "y1")
    return shelves.suppress_overlaps(lines).select("photo", "line_id")


@query("""SELECT p_partkey::VARCHAR AS band, 1 AS slot, CASE WHEN p_size % 2 = 0 THEN '10.50|1250' ELSE '10.50' END AS others FROM part""")
def prices_on_tags(spark, d):
    """Price-shaped lines inside the tag of a price, itself and other texts left out."""
    spec = [(0, "9.99", 0.48, 0.50, 0.52, 0.52), (1, "10.50", 0.46, 0.53, 0.49, 0.54), (2, F.when(F.col("p_size") % 2 == 0, "1250"), 0.50, 0.45, 0.53, 0.46), (3, "rosu", 0.49, 0.53, 0.51, 0.54), (4, "77.70", 0.70, 0.50, 0.74, 0.52)]
    lines = _part_lines(spark, d, spec)
    slots = lines.filter("line_id = 0").select(F.col("photo").alias("band"), F.lit(1).alias("slot"), "photo", "line_id", "x0", "y0", "x1", "y1")
    return workitems.other_prices(slots, lines).select("band", "slot", F.array_join("others", "|").alias("others"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 1 THEN 1 ELSE 3 END AS repeats,
  concat_ws('; ', CASE WHEN p_size % 2 = 0 THEN 'no price rail was detected here' END, CASE WHEN p_size % 3 = 0 THEN 'some text on this photo may have been read upside down' END,
  CASE WHEN p_size % 2 = 1 AND p_size < 4 THEN 'this band is very thin' END, CASE WHEN p_size % 4 > 1 THEN 'several prices on this rail repeat' END) AS warnings FROM part""")
def page_warnings(spark, d):
    s = F.col("p_size")
    rail = lambda *v: F.array(*map(F.lit, v))
    prices = F.when(s % 4 == 0, rail(1.0, 2.0, 3.0)).when(s % 4 == 1, rail(1.0, 1.0, 1.0, 2.0)).otherwise(rail(1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 4.0))
    own = workitems.band_warnings(s % 2 == 0, s % 3 == 0, s / 100.0, prices)
    return t(spark, d, "part").select("p_partkey", workitems.repeated_prices(prices).alias("repeats"), F.concat_ws("; ", own).alias("warnings"))


# --- tiles ---------------------------------------------------------------------------


@query("""WITH RECURSIVE g(w, h, c, r) AS (SELECT DISTINCT p_size * 200 AS w, (p_partkey % 7) * 1500 + 100 AS h, greatest(1, ceil(p_size * 200 / 2200.0))::INT, greatest(1, ceil(greatest(1.0, ((p_partkey % 7) * 1500 + 100) * (0.6::DOUBLE - 0.1)) / 2200.0))::INT FROM part
  UNION ALL SELECT w, h, CASE WHEN r < c THEN c - 1 ELSE c END, CASE WHEN r >= c THEN r - 1 ELSE r END FROM g WHERE c * r > 9),
  e AS (SELECT * FROM g WHERE c * r <= 9), p AS (SELECT p_partkey, c, r FROM part JOIN e ON w = p_size * 200 AND h = (p_partkey % 7) * 1500 + 100),
  x AS (SELECT p_partkey, c, r, unnest(range(0, c * r)) AS tile FROM p), y AS (SELECT *, tile % c AS i, tile // c AS j, 1.0::DOUBLE / (c - (c - 1) * 0.12::DOUBLE) AS sw, 0.5::DOUBLE / (r - (r - 1) * 0.12::DOUBLE) AS sh FROM x)
  SELECT p_partkey, tile::INTEGER AS tile, round(i * CASE WHEN c > 1 THEN (1 - sw) / (c - 1) ELSE 0 END, 6) AS x0, round(0.1 + j * CASE WHEN r > 1 THEN (0.5 - sh) / (r - 1) ELSE 0 END, 6) AS y0,
  round(least(1.0, i * CASE WHEN c > 1 THEN (1 - sw) / (c - 1) ELSE 0 END + sw), 6) AS x1, round(least(0.6, 0.1 + j * CASE WHEN r > 1 THEN (0.5 - sh) / (r - 1) ELSE 0 END + sh), 6) AS y1 FROM y""")
def strip_tiles(spark, d):
    """Strips without a rail, in at most nine overlapping tiles."""
    cut = geometry.fallback_tiles(F.col("p_size") * 200, F.col("p_partkey") % 7 * 1500 + 100, F.lit(0.1), F.lit(0.6))
    return t(spark, d, "part").select("p_partkey", F.posexplode(cut).alias("tile", "b")).select("p_partkey", "tile", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""WITH p AS (SELECT p_partkey, p_size * 211 AS len FROM part), n AS (SELECT *, CASE WHEN len <= 900 THEN 1 ELSE coalesce((SELECT min(g) FROM range(2, 42) r(g) WHERE len / (g - (g - 1) * 0.15::DOUBLE) <= 900), 41) END AS n FROM p),
  s AS (SELECT *, len / (n - (n - 1) * 0.15::DOUBLE) AS span FROM n), g AS (SELECT *, unnest(range(0, n)) AS i FROM s)
  SELECT p_partkey, i::INTEGER AS tile, CASE WHEN n = 1 THEN 0 ELSE floor(i * ((len - span) / (n - 1)) + 0.5) END::INTEGER AS x0,
  CASE WHEN n = 1 THEN len ELSE least(len, floor(i * ((len - span) / (n - 1)) + 0.5) + floor(span + 0.5)) END::INTEGER AS x1 FROM g""")
def recogniser_tiles(spark, d):
    cut = geometry.recogniser_tiles(F.col("p_size") * 211, F.lit(500), F.lit(900))
    return t(spark, d, "part").select("p_partkey", F.posexplode(cut).alias("tile", "b")).select("p_partkey", "tile", "b.x0", "b.x1")


@query("""WITH p AS (SELECT p_partkey, p_size * 100 AS h, greatest(1, ceil(p_size * 100 / 2215.0))::INT AS rows FROM part), r AS (SELECT *, h::DOUBLE / rows AS tall, unnest(range(0, rows)) AS i FROM p),
  b AS (SELECT *, greatest(0, trunc(i * tall)::INT - trunc(tall * 0.14::DOUBLE)::INT) AS top, least(h, trunc((i + 1) * tall)::INT + trunc(tall * 0.14::DOUBLE)::INT) AS foot FROM r),
  n AS (SELECT *, foot - top AS len, CASE WHEN foot - top <= 2576 THEN 1 ELSE 2 END AS n FROM b), s AS (SELECT *, len / (n - (n - 1) * 0.14::DOUBLE) AS span FROM n), g AS (SELECT *, unnest(range(0, n)) AS k FROM s)
  SELECT p_partkey, 'grid row ' || (i + 1) || '/' || rows || CASE WHEN n = 1 THEN '' ELSE ' (tile ' || (k + 1) || '/2)' END AS label, (top + CASE WHEN n = 1 THEN 0 ELSE trunc(k * (len - span)) END)::INTEGER AS y0,
  (top + CASE WHEN n = 1 THEN len ELSE trunc(least(len, k * (len - span) + span)) END)::INTEGER AS y1, 1500 AS x1 FROM g""")
def grid_rows(spark, d):
    """A plain grid over photos without a band."""
    cut = geometry.grid_regions(F.lit(1500), F.col("p_size") * 100)
    return t(spark, d, "part").select("p_partkey", F.explode(cut).alias("b")).select("p_partkey", "b.label", "b.y0", "b.y1", "b.x1")


@query("""SELECT p_partkey, 'band' AS label, trunc(greatest(0.0, 0.1::DOUBLE - 0.015) * 1000)::INTEGER AS x0, trunc((0.2::DOUBLE - 0.015) * 800)::INTEGER AS y0, trunc(least(1.0, p_size / 50.0::DOUBLE + 0.015) * 1000)::INTEGER AS x1, trunc((0.5::DOUBLE + 0.015) * 800)::INTEGER AS y1, TRUE AS has_rail
  FROM part WHERE p_size % 3 > 0 AND p_size / 50.0::DOUBLE - 0.1 >= 0.01""")
def band_tiles(spark, d):
    """Reported bands as pixel regions; none for what holds no product or is too narrow."""
    s = F.col("p_size")
    band = F.struct((s % 3 > 0).alias("contains_wine"), F.lit(0.2).alias("bottles_y0"), F.lit(0.45).alias("bottles_y1"), F.lit(0.46).alias("tags_y0"), F.lit(0.5).alias("tags_y1"), F.lit(0.1).alias("x0"), (s / 50.0).alias("x1"))
    cut = geometry.band_regions(band, F.lit(1000), F.lit(800), F.lit(geometry.MAX_EDGE), F.lit("band"))
    return t(spark, d, "part").select("p_partkey", F.explode(cut).alias("b")).select("p_partkey", "b.label", "b.x0", "b.y0", "b.x1", "b.y1", "b.has_rail")


@query("""WITH b AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS x0, p_size / 100.0::DOUBLE + 0.001 * (p_size % 5) AS x1 FROM part)
  SELECT p_partkey, trunc(x0 * 640)::INTEGER AS px0, greatest(trunc(x1 * 640)::INTEGER, trunc(x0 * 640)::INTEGER + 1) AS px1, trunc(greatest(0.0, least(1.0, x0 - 0.04 * greatest(x1 - x0, 0.02))) * 640)::INTEGER AS cx0,
  trunc(greatest(0.0, least(1.0, x1 + 0.04 * greatest(x1 - x0, 0.02))) * 640)::INTEGER AS cx1, round(CASE WHEN x1 > x0 THEN greatest(0.0, least(1.0, (x0 + 0.001 - x0) / (x1 - x0))) ELSE 0 END, 6) AS inside FROM b""")
def crop_pixels(spark, d):
    """Pixel boxes of at least a pixel, padded review crops, and fractions in a crop's own frame."""
    x0 = F.col("p_size") / 100.0
    x1 = x0 + 0.001 * (F.col("p_size") % 5)
    box = F.struct(x0.alias("x0"), F.lit(0.1).alias("y0"), x1.alias("x1"), F.lit(0.2).alias("y1"))
    px, crop = geometry.pixel_region(box, F.lit(640), F.lit(480)), geometry.crop_box(box, F.lit(640), F.lit(480))
    return t(spark, d, "part").select("p_partkey", px["x0"].alias("px0"), px["x1"].alias("px1"), crop["x0"].alias("cx0"), crop["x1"].alias("cx1"), F.round(geometry.rescale(x0 + 0.001, x0, x1), 6).alias("inside"))


@query("""SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS item, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1) // 7)::INTEGER AS chunk FROM lineitem""")
def request_chunks(spark, d):
    """Requests of a supplier in chunks of seven: five fill the bytes less than seven do."""
    items = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.lit(10).alias("size"))
    return report.chunks(items, "l_suppkey", "item", "size", most_items=9, most_bytes=79)


# --- names and brands -------------------------------------------------------------------


@query(f"""SELECT doc_id, array_to_string({_sql_tokens('text')}, ' ') AS key, len({_sql_tokens('text')}) AS n FROM documents""")
def name_keys(spark, d):
    """Brand-bearing words of whole texts, and the key they make."""
    return t(spark, d, "documents").select("doc_id", names.name_key(F.col("text")).alias("key"), F.size(names.brand_tokens(F.col("text"))).cast("long").alias("n"))


_CODE = "'KX' || translate(p_partkey::VARCHAR, '0123456789', 'ABCDEFGHIJ')"


def _code():
    """A word that only one part has."""
    return F.concat(F.lit("KX"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "ABCDEFGHIJ"))


def _part_postings(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("row"), F.concat_ws(" ", _code(), "p_name").alias("text"), F.lit("").alias("label"))
    return brands.postings(brands.catalogue(rows, [F.col("text")]), "row")


@query("""SELECT p_partkey, p_partkey AS row, round(ln((SELECT count(*) FROM part)), 6) AS score, p_size % 3 AS attempt FROM part""")
def brand_cascade(spark, d):
    """The telling word stands in the name, in the producer, or on the tag alone."""
    k = F.col("p_size") % 3
    word = lambda n: F.when(k == n, _code()).otherwise("vin rosu")
    named = t(spark, d, "part").select("p_partkey", word(0).alias("name"), word(1).alias("producer"), F.concat(word(2), F.lit(" 750 ml")).alias("tag"))
    attempts = [[F.col("name")], [F.col("name"), F.col("producer")], [F.col("name"), F.col("producer"), F.col("tag")]]
    return brands.match_cascade(named, "p_partkey", attempts, _part_postings(spark, d)).select("p_partkey", "row", F.round("score", 6).alias("score"), "attempt")


_ENRICHED = f"""SELECT p_partkey * 2 + i AS row_no, CASE p_partkey % 5 WHEN 0 THEN 'Big' WHEN 3 THEN p_brand WHEN 4 THEN p_brand ELSE '' END AS brand_group, CASE p_partkey % 5 WHEN 0 THEN 'Old House' WHEN 3 THEN p_type WHEN 4 THEN p_type ELSE '' END AS brand_winery,
  CASE p_partkey % 5 WHEN 0 THEN 'Red' WHEN 3 THEN p_name WHEN 4 THEN p_name ELSE '' END AS brand_label, CASE p_partkey % 5 WHEN 0 THEN 'reviewed:high' WHEN 1 THEN 'reviewed:none' WHEN 2 THEN 'none' ELSE 'auto' END AS brand_match FROM part, (VALUES (0), (1)) v(i)"""


def _enriched(spark, d):
    """Two rows a part: reviewed, reviewed without a brand, nothing telling, in the index by name or by producer."""
    k = F.col("p_partkey") % 5
    p = t(spark, d, "part")
    rows = p.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
        (F.col("p_partkey") * 2 + F.col("i")).alias("row_no"), F.when(k.isin(2, 4), F.concat_ws(" ", F.lit("vin"), F.when(k == 4, F.concat(F.lit("Zet"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij"))), F.lit("sec"))).otherwise(_code()).alias("wine_name"),
        F.when(k == 4, _code()).alias("producer"), F.lit("").alias("raw_tag_text"), F.lit(None).cast("string").alias("raw_label_text"))
    reviewed = p.filter(k < 2).select(names.name_key(_code()).alias("key"), F.when(k == 0, "Big | Old House | Red").alias("brand"), F.lit("high").alias("confidence"))
    details = p.select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("group"), F.col("p_type").alias("winery"), F.col("p_name").alias("label"))
    columns = {"name": "wine_name", "producer": "producer", "tag": "raw_tag_text", "label": "raw_label_text"}
    return brands.enrich(rows, "row_no", reviewed, _part_postings(spark, d), details, columns)


@query(_ENRICHED)
def brand_enrichment(spark, d):
    return _enriched(spark, d).select("row_no", "brand_group", "brand_winery", "brand_label", "brand_match")


@query("""SELECT 2 * count(CASE WHEN p_partkey % 5 = 0 THEN 1 END) AS reviewed, 2 * count(CASE WHEN p_partkey % 5 > 2 THEN 1 END) AS auto, 2 * count(CASE WHEN p_partkey % 5 IN (1, 2) THEN 1 END) AS none FROM part""")
def brand_match_counts(spark, d):
    return brands.match_counts(_enriched(spark, d))


# --- scoring, reviews and work ---------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice / 100) + 0.5 AS price, o_orderkey % 20 = 0 AS token, o_orderkey % 30 = 0 AS volume, o_orderstatus <> 'F' AS priced FROM orders),
  tr AS (SELECT k, price, row_number() OVER (PARTITION BY price ORDER BY k) AS n FROM o), rw AS (SELECT k + 1 AS row_no, price, token, volume, row_number() OVER (PARTITION BY price ORDER BY token DESC, k) AS n FROM o WHERE priced)
  SELECT tr.k AS truth_no, row_no, token AS name_ok, volume AS volume_ok FROM tr LEFT JOIN rw ON tr.price = rw.price AND tr.n = rw.n""")
def verify_assignment(spark, d):
    """Fewer rows than truths at most prices: each truth in turn takes the first free row, those with its token first."""
    price = F.floor(F.col("o_totalprice") / 100) + 0.5
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    truth = o.select(k.alias("truth_no"), price.alias("price"), F.lit("Castel").alias("name_contains"), F.lit(750.0).alias("volume_ml"))
    rows = o.select((k + 1).alias("row_no"), F.when(F.col("o_orderstatus") != "F", price).alias("price"), F.when(k % 30 == 0, 750.4).otherwise(1500.0).alias("volume_ml"), F.when(k % 20 == 0, "VIN CAȘTEL 0.75").otherwise("x").alias("text"))
    return score.verify(truth, rows).select("truth_no", "row_no", "name_ok", "volume_ok")


@query("""SELECT o_orderkey + 1 AS row_no FROM orders WHERE o_orderstatus = 'F'""")
def verify_extras(spark, d):
    """Rows that no truth took: those without a price, as the others have a truth each."""
    price = F.floor(F.col("o_totalprice") / 100) + 0.5
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    truth = o.select(k.alias("truth_no"), price.alias("price"), F.lit("").alias("name_contains"), F.lit(None).cast("double").alias("volume_ml"))
    rows = o.select((k + 1).alias("row_no"), F.when(F.col("o_orderstatus") != "F", price).alias("price"), F.lit(750.0).alias("volume_ml"), F.lit("x").alias("text"))
    return score.extras(score.verify(truth, rows), rows).select("row_no")


@query("""SELECT count(*) AS n_rows, count(CASE WHEN l_linenumber < 7 THEN 1 END) AS priced, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS flagged, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS boxed,
  count(DISTINCT CASE WHEN l_linenumber = 6 THEN -1 ELSE l_orderkey END) AS photos FROM lineitem""")
def review_stats(spark, d):
    n = F.col("l_linenumber")
    rows = t(spark, d, "lineitem").select(F.when(n < 7, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("").alias("needs_review"), F.when(n == 2, "0,0,1,1").otherwise("").alias("bottle_bbox"), F.when(n > 2, "0,0,1,1").alias("tag_bbox"), F.when(n == 6, " ").otherwise(F.col("l_orderkey").cast("string")).alias("photo"))
    return report.review_counts(rows)


@query("""SELECT source AS photo, count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1""")
def pending_by_source(spark, d):
    jobs = t(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("photo"))
    found = t(spark, d, "labels").select(F.col("doc_id").alias("job_id"), (F.col("quality") == 1).alias("valid"))
    return workitems.pending_by(ingest.pending(jobs, found), "photo")


@query("""SELECT source AS photo, 'read' AS stage, 'no usable answer for job ' || doc_id || ' (' || lang || ')' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def missing_answers(spark, d):
    jobs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("source").alias("photo"), F.col("lang").alias("band_label"))
    found = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("job_id"), (F.col("quality") == 1).alias("valid"))
    return ingest.missing_errors(jobs, found)


@query("""SELECT p_partkey::VARCHAR AS custom_id, CASE WHEN p_size % 3 = 0 THEN p_name END AS raw, CASE p_size % 3 WHEN 1 THEN 'batch result: errored' WHEN 2 THEN 'batch result: expired' END AS error FROM part WHERE p_partkey % 2 = 0""")
def batch_answers(spark, d):
    """Results come for some of the items, and for ids that nobody asked for."""
    p, key = t(spark, d, "part"), F.col("p_partkey").cast("string")
    results = p.select(F.when(F.col("p_partkey") % 2 == 0, key).otherwise(F.concat(F.lit("other-"), key)).alias("custom_id"), _pick(F.col("p_size") % 3, "succeeded", "errored", "expired").alias("kind"), F.col("p_name").alias("raw"))
    return ingest.batch_results(p.select(key.alias("custom_id")), results)


@query("""SELECT p_partkey, concat_ws(chr(10), 'Find the shelves on this photo.', 'Photo: ' || p_name, CASE WHEN p_size % 2 = 0 THEN 'It was taken, we were told, at Shop; report the name you see all the same.' END, CASE WHEN p_size % 3 = 0 THEN 'Taken: 2026' END) AS layout,
  concat_ws(chr(10), 'Read all products in this part of a photo.', 'Part: r', 'Photo: ' || p_name, CASE WHEN p_size % 2 = 0 THEN 'Shop: Shop' END, CASE WHEN p_size % 5 = 0 THEN 'Unless a tag says otherwise prices are in RON.' END, CASE WHEN p_size % 3 = 0 THEN 'Taken: 2026' END,
    CASE WHEN p_size % 7 = 0 THEN 'Neighbouring parts overlap with this one: leave out what is cut off, unless both its name and its price can be read.' END,
    CASE WHEN p_size % 4 = 1 THEN 'The prices of these products are outside this part: give none, and do not take one from another shelf.' END) AS region,
  concat_ws(chr(10), 'Read all products on this shelf.', 'Shelf: ' || p_brand, 'Photo: ' || p_name, CASE WHEN p_size % 2 = 0 THEN 'Shop: Shop' END, CASE WHEN p_size % 3 = 0 THEN 'Taken: 2026' END, chr(10) || 'Text found on it' || chr(10) || chr(10) || p_type,
    CASE WHEN p_size % 4 > 1 THEN chr(10) || 'To be wary of' || chr(10) || chr(10) || '- one' || CASE WHEN p_size % 4 = 3 THEN chr(10) || '- two' ELSE '' END END) AS band FROM part""")
def prompts(spark, d):
    s, photo = F.col("p_size"), F.col("p_name")
    shop, taken, warned = F.when(s % 2 == 0, "Shop").otherwise(""), F.when(s % 3 == 0, "2026"), F.when(s % 4 == 2, F.array(F.lit("one"))).when(s % 4 == 3, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    rail = F.when(s % 4 == 1, False).when(s % 4 == 2, True)
    return t(spark, d, "part").select(
        "p_partkey", workitems.layout_prompt(photo, shop, taken).alias("layout"), workitems.region_prompt(photo, F.lit("r"), shop, F.when(s % 5 == 0, "RON"), taken, s % 7 == 0, rail).alias("region"),
        workitems.band_prompt(photo, F.col("p_brand"), shop, taken, F.col("p_type"), warned).alias("band"),
    )


# --- files, written and read again -------------------------------------------------------


@query("""SELECT 'W' || p_partkey AS row_id, CASE WHEN p_size % 4 > 0 THEN p_name || ', "' || p_brand || '"' || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'două' ELSE '' END END AS wine_name, CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS price,
  CASE WHEN p_size % 3 = 1 THEN 'W1' END AS duplicate_of FROM part WHERE p_size % 3 <> 1""")
def table_files(spark, d):
    """A written table again, typed, blanks NULL, duplicates left out."""
    s = F.col("p_size")
    name = F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"'), F.when(s % 3 == 0, "\ndouă").otherwise(""))
    rows = t(spark, d, "part").select(F.concat(F.lit("W"), F.col("p_partkey").cast("string")).alias("row_id"), F.when(s % 4 > 0, name).alias("wine_name"), F.when(s % 5 > 0, F.col("p_retailprice")).alias("price"), F.when(s % 3 == 1, "W1").alias("duplicate_of"))
    path = scratch(spark, "table")
    sinks.write_csv_table(rows, path, ("row_id", "wine_name", "price", "duplicate_of"))
    return ingest.primaries(ingest.table(spark, path)).select("row_id", "wine_name", "price", "duplicate_of")


@query("""SELECT p_partkey::VARCHAR AS job_id, p_name AS photo, p_size AS band_index, p_retailprice / 2 AS price, CASE WHEN p_size % 2 = 0 THEN 'w' END AS warning FROM part WHERE p_partkey % 3 > 0""")
def manifest_files(spark, d):
    """A manifest as JSON lines; entries without an id are left out."""
    rows = t(spark, d, "part").select(F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).alias("job_id"), F.col("p_name").alias("photo"), F.col("p_size").cast("int").alias("band_index"), F.array(F.col("p_retailprice"), F.col("p_retailprice") / 2).alias("ocr_prices"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("w"))).alias("warnings"))
    path = scratch(spark, "manifest")
    sinks.write_jsonl(rows, path)
    return ingest.manifest(spark, path).select("job_id", "photo", F.col("band_index").cast("long").alias("band_index"), F.get("ocr_prices", F.lit(1)).alias("price"), F.get("warnings", F.lit(0)).alias("warning"))


@query("""SELECT c_custkey::VARCHAR AS photo, CASE WHEN c_custkey % 4 = 0 THEN 'the recogniser returned no record' WHEN c_custkey % 4 = 1 THEN 'broken' END AS error, CASE WHEN c_custkey % 4 > 1 THEN i END AS line_id, CASE WHEN c_custkey % 4 > 1 THEN c_name || i END AS text,
  CASE WHEN c_custkey % 4 > 1 THEN 0.1 + i END AS x0 FROM customer, (VALUES (0), (1)) v(i) WHERE c_custkey % 4 > 1 OR i = 0""")
def page_files(spark, d):
    """Pages of text lines as JSON: missing, broken and read ones, with their lines."""
    k = F.col("c_custkey")
    line = lambda i: F.struct(F.concat(F.col("c_name"), F.lit(str(i))).alias("t"), F.lit(0.9).alias("c"), F.lit(12).alias("h"), F.array(*map(F.lit, (0.1 + i, 0.2, 0.3, 0.4))).alias("b"))
    found = t(spark, d, "customer").filter(k % 4 > 0).select(k.cast("string").alias("path"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.when(k % 4 == 1, "broken").alias("error"), F.when(k % 4 > 1, F.array(line(0), line(1))).alias("lines"))
    path = scratch(spark, "pages")
    sinks.write_jsonl(found, path)
    wanted = t(spark, d, "customer").select(k.alias("ordinal"), k.cast("string").alias("path"))
    pages = ingest.pages_for(wanted, ingest.pages(spark, path))
    read = ingest.lines(pages).select("photo", "line_id", "text", "x0")
    return pages.select(F.col("path").alias("photo"), "error").join(read, "photo", "left").select("photo", "error", "line_id", "text", "x0")


@query("""SELECT p_type AS category, p_brand AS group, p_name AS winery, 'L' || p_partkey AS label FROM part""")
def catalogue_files(spark, d):
    rows = t(spark, d, "part").select(F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("Category"), F.col("p_brand").alias("Group"), F.col("p_name").alias("Winery"), F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("Label"), F.lit("x").alias("Other"))
    path = scratch(spark, "catalogue")
    rows.write.option("sep", "\t").option("header", "true").csv(path)
    return ingest.catalogue(spark, path).select("category", "group", "winery", "label")


@query("""SELECT s_suppkey::VARCHAR AS photo, s_acctbal AS price, CASE WHEN s_suppkey % 2 = 0 THEN 750.0 END AS volume_ml, 'Castel, "' || s_suppkey || '"' AS name_contains FROM supplier WHERE s_suppkey % 3 > 0""")
def truth_files(spark, d):
    """Hand-checked rows, their columns in an order of their own; remarks, blank lines and rows without a price are passed over."""
    k = F.col("s_suppkey").cast("string")
    number = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal").cast("string")).otherwise("")
    row = F.concat_ws(",", number, k, F.when(F.col("s_suppkey") % 2 == 0, " 750 ").otherwise(""), F.concat(F.lit('"Castel, ""'), k, F.lit('"""')))
    body = t(spark, d, "supplier").select((F.col("s_suppkey") + 10).alias("at"), F.explode(F.array(row, F.lit("  # a remark, 1"), F.lit(""))).alias("value"))
    lines = spark.createDataFrame([(0, "# checked by hand"), (1, "price,photo,volume_ml,name_contains")], "at long, value string").unionByName(body)
    path = scratch(spark, "truth")
    lines.repartitionByRange(1, "at").sortWithinPartitions("at").select("value").write.text(path)  # a file somebody wrote
    return ingest.truth(spark, path).select("photo", "price", "volume_ml", "name_contains")
