"""Boxes, overlaps and tiles as Column expressions; boxes are structs x0, y0, x1, y1 in fractions of the photo."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes and budgets of crops and tiles.
MAX_EDGE, MAX_EDGE_STANDARD = 2576, 1568
TOKENS_HIGH, TOKENS_STANDARD, PIXELS_PER_TOKEN = 4784, 1600, 750
TILE_OVERLAP, BAND_PAD, LEAST_BAND = 0.14, 0.015, 0.01
FALLBACK_TILE_PX, FALLBACK_OVERLAP, FALLBACK_MAX_TILES = 2200, 0.12, 9
MOST_SPANS = 25
RECOGNISER_OVERLAP, RECOGNISER_SPANS = 0.15, 41


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def rescale(v: Column, low: Column, high: Column) -> Column:
    """A whole-photo fraction in a crop's own frame; 0 for an empty crop."""
    return F.when(high > low, clamp((v - low) / F.when(high > low, high - low))).otherwise(F.lit(0.0))


def centre(a: Column, b: Column) -> Column:
    return (a + b) / 2


def x_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared width over the narrower width, 0 if apart."""
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    narrow = F.least(a1 - a0, b1 - b0)
    return F.when((shared > 0) & (narrow > 0), shared / F.when(narrow > 0, narrow)).otherwise(F.lit(0.0))


def format_bbox(box: Column) -> Column:
    """Four decimals each, comma-joined; '' without a box."""
    return F.when(box.isNull(), "").otherwise(F.concat_ws(",", *[F.format_string("%.4f", box[c]) for c in ("x0", "y0", "x1", "y1")]))


def pixel_region(box: Column, width: Column, height: Column) -> Column:
    """Truncated pixel box of at least one pixel."""
    cut = lambda f, size: (f * size).cast("int")
    x0, y0 = cut(box["x0"], width), cut(box["y0"], height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.greatest(cut(box["x1"], width), x0 + 1).alias("x1"), F.greatest(cut(box["y1"], height), y0 + 1).alias("y1"))


def to_full(box: Column, region: Column, width: Column, height: Column) -> Column:
    """A box in fractions of a pixel region, in fractions of the photo."""
    x = lambda c: (region["x0"] + box[c] * (region["x1"] - region["x0"])) / width
    y = lambda c: (region["y0"] + box[c] * (region["y1"] - region["y0"])) / height
    return F.when(box.isNotNull(), F.struct(x("x0").alias("x0"), y("y0").alias("y0"), x("x1").alias("x1"), y("y1").alias("y1")))


def image_tokens(width: Column, height: Column, max_edge: Column) -> Column:
    """What an image costs a vision model after it is scaled to ``max_edge``."""
    scale = F.least(F.lit(1.0), max_edge / F.greatest(width, height))
    most = F.when(max_edge > MAX_EDGE_STANDARD, TOKENS_HIGH).otherwise(TOKENS_STANDARD)
    return F.floor(F.least(most.cast("double"), width * scale * (height * scale) / PIXELS_PER_TOKEN)).cast("int")


def recogniser_spans(length: Column, budget: Column, overlap: float = RECOGNISER_OVERLAP) -> Column:
    """array<struct<lo,hi>>: the tiles that text recognition sees along an axis; like ``spans``, but rounded half up and up to RECOGNISER_SPANS."""
    n = F.coalesce(F.get(F.filter(F.sequence(F.lit(2), F.lit(RECOGNISER_SPANS)), lambda k: length / (k - (k - 1) * overlap) <= budget), F.lit(0)), F.lit(RECOGNISER_SPANS))
    span = length / (n - (n - 1) * overlap)
    step = (length - span) / (n - 1)
    near = lambda v: F.floor(v + 0.5).cast("int")
    cut = lambda i: F.struct(near(i * step).alias("lo"), F.least(length.cast("int"), near(i * step) + near(span)).alias("hi"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), length.cast("int").alias("hi")))
    return F.when((budget <= 0) | (length <= budget), whole).otherwise(F.transform(F.sequence(F.lit(0), n - 1), cut))


def recogniser_tiles(width: Column, height: Column, budget: Column) -> Column:
    """array<struct<x0,y0,x1,y1>> of pixels, row by row."""
    cols, rows = recogniser_spans(width, budget), recogniser_spans(height, budget)
    tile = lambda r, c: F.struct(c["lo"].alias("x0"), r["lo"].alias("y0"), c["hi"].alias("x1"), r["hi"].alias("y1"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: tile(r, c))))


def spans(length: Column, budget: Column, overlap: float = TILE_OVERLAP) -> Column:
    """array<struct<lo,hi>>: the fewest overlapping spans of at most ``budget`` that cover ``length``."""
    fits = lambda n: length / (n - (n - 1) * overlap) <= budget
    n = F.coalesce(F.get(F.filter(F.sequence(F.lit(2), F.lit(MOST_SPANS)), fits), F.lit(0)), F.lit(MOST_SPANS))
    span = length / (n - (n - 1) * overlap)
    step = (length - span) / (n - 1)
    cut = lambda i: F.struct((i * step).cast("int").alias("lo"), F.least(length.cast("double"), i * step + span).cast("int").alias("hi"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), length.cast("int").alias("hi")))
    return F.when(length <= budget, whole).otherwise(F.transform(F.sequence(F.lit(0), n - 1), cut))


def tiles(x0: Column, y0: Column, x1: Column, y1: Column, max_edge: Column, label: Column, rail: Column | None = None) -> Column:
    """array<struct<label,x0,y0,x1,y1,tile,tiles,has_rail>>: a pixel box cut on both axes; rail: struct<y0,y1> or NULL."""
    cols, rows = spans(x1 - x0, max_edge), spans(y1 - y0, max_edge)
    total = F.size(cols) * F.size(rows)

    def tile(r: Column, c: Column) -> Column:
        top, foot = y0 + r["lo"], y0 + r["hi"]
        has = F.lit(None).cast("boolean") if rail is None else (top < rail["y1"]) & (foot > rail["y0"])
        return F.struct((x0 + c["lo"]).alias("x0"), top.alias("y0"), (x0 + c["hi"]).alias("x1"), foot.alias("y1"), has.alias("has_rail"))

    flat = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: tile(r, c))))
    name = lambda i: F.when(total == 1, label).otherwise(F.concat(label, F.lit(" (tile "), (i + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit(")")))
    full = F.transform(flat, lambda t, i: F.struct(name(i).alias("label"), t["x0"].alias("x0"), t["y0"].alias("y0"), t["x1"].alias("x1"), t["y1"].alias("y1"), i.alias("tile"), total.alias("tiles"), t["has_rail"].alias("has_rail")))
    return F.when((x1 > x0) & (y1 > y0), full).otherwise(F.slice(full, 1, 0))


def fallback_grid(width: Column, height: Column) -> Column:
    """struct<cols,rows>: tiles of at most FALLBACK_TILE_PX, the larger axis shrunk until FALLBACK_MAX_TILES suffice."""
    parts = lambda px: F.greatest(F.lit(1), F.ceil(px / FALLBACK_TILE_PX).cast("int"))
    start = F.struct(parts(F.greatest(width, F.lit(1))).alias("cols"), parts(F.greatest(height, F.lit(1.0))).alias("rows"))
    over = lambda g: (g["cols"] * g["rows"] > FALLBACK_MAX_TILES) & ((g["cols"] > 1) | (g["rows"] > 1))
    less = lambda g: F.struct(
        F.when(over(g) & (g["rows"] < g["cols"]), g["cols"] - 1).otherwise(g["cols"]).alias("cols"),
        F.when(over(g) & (g["rows"] >= g["cols"]), g["rows"] - 1).otherwise(g["rows"]).alias("rows"),
    )
    return F.aggregate(F.sequence(F.lit(1), start["cols"] + start["rows"]), start, lambda g, _: less(g))


def iou(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    shared = side("x0", "x1") * side("y0", "y1")
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def fraction_spans(low: Column, high: Column, n: Column, overlap: float = FALLBACK_OVERLAP) -> Column:
    """array<struct<lo,hi>>: n overlapping stretches of low..high."""
    length = high - low
    span = length / (n - (n - 1) * overlap)
    step = F.when(n > 1, (length - span) / F.when(n > 1, n - 1)).otherwise(F.lit(0.0))
    cut = lambda i: F.struct((low + i * step).alias("lo"), F.least(high, low + i * step + span).alias("hi"))
    return F.transform(F.sequence(F.lit(0), n - 1), cut)


def fallback_tiles(width: Column, height: Column, y0: Column, y1: Column) -> Column:
    """array<struct<x0,y0,x1,y1>>: a strip of the photo in overlapping tiles of a readable size, row by row."""
    grid = fallback_grid(width, height * (y1 - y0))
    rows, cols = fraction_spans(y0, y1, grid["rows"]), fraction_spans(F.lit(0.0), F.lit(1.0), grid["cols"])
    tile = lambda r, c: F.struct(c["lo"].alias("x0"), r["lo"].alias("y0"), c["hi"].alias("x1"), r["hi"].alias("y1"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: tile(r, c))))


def band_regions(band: Column, width: Column, height: Column, max_edge: Column, label: Column) -> Column:
    """Tiles of a reported band (contains_wine, bottles_y0, bottles_y1, tags_y0, tags_y1, x0, x1); none for what is no band."""
    top, foot = F.least(band["bottles_y0"], band["tags_y0"]), F.greatest(band["bottles_y1"], band["tags_y1"])
    px = lambda v, size: (clamp(v) * size).cast("int")
    rail = F.struct((band["tags_y0"] * height).cast("int").alias("y0"), (band["tags_y1"] * height).cast("int").alias("y1"))
    cut = tiles(px(band["x0"] - BAND_PAD, width), px(top - BAND_PAD, height), px(band["x1"] + BAND_PAD, width), px(foot + BAND_PAD, height), max_edge, label, rail)
    usable = F.coalesce(band["contains_wine"], F.lit(True)) & (foot - top >= LEAST_BAND) & (band["x1"] - band["x0"] >= LEAST_BAND)
    return F.when(usable, cut).otherwise(F.slice(cut, 1, 0))


def grid_regions(width: Column, height: Column, max_edge: int = MAX_EDGE, overlap: float = TILE_OVERLAP) -> Column:
    """Tiles of a plain grid of rows over the whole photo, for photos without reported bands."""
    rows = F.greatest(F.lit(1), F.ceil(height / int(max_edge * 0.86)).cast("int"))
    tall = height / rows
    extra = (tall * overlap).cast("int")

    def row(r: Column) -> Column:
        top = F.greatest(F.lit(0), (r * tall).cast("int") - extra)
        foot = F.least(height, ((r + 1) * tall).cast("int") + extra)
        name = F.concat(F.lit("grid row "), (r + 1).cast("string"), F.lit("/"), rows.cast("string"))
        return tiles(F.lit(0), top, width, foot, F.lit(max_edge), name)

    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), row))


def crop_box(box: Column, width: Column, height: Column, pad: float = 0.04, least: float = 0.02) -> Column:
    """Pixel box of a review crop: the box and a margin of its size."""
    dx, dy = pad * F.greatest(box["x1"] - box["x0"], F.lit(least)), pad * F.greatest(box["y1"] - box["y0"], F.lit(least))
    at = lambda v, size: (clamp(v) * size).cast("int")
    return F.struct(at(box["x0"] - dx, width).alias("x0"), at(box["y0"] - dy, height).alias("y0"), at(box["x1"] + dx, width).alias("x1"), at(box["y1"] + dy, height).alias("y1"))
