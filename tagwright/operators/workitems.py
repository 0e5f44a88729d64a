"""Work items: one per band, with what local text recognition read there and what to be wary of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.geometry import centre, rescale
from tagwright.functions.names import job_id

from .referee import expected_on_tag, reconcile_text, reconcile_with
from .shelves import BARE_PRICE, LEAST_CONFIDENCE, PRICE, assign_lines, band_label, bands, looks_flipped, once, tag_box

# How much of a tag is shown, and when a crop is thin or a rail repetitive.
SHOWN_LINES, SHOWN_PRICES, SHOWN_STRAYS = 6, 4, 12
THIN_BAND, REPEATS = 0.04, 3


def repeated_prices(prices: Column) -> Column:
    """How many distinct prices stand on a rail more than once."""
    return F.size(F.filter(F.array_distinct(prices), lambda p: F.size(F.filter(prices, lambda q: q == p)) > 1))


def band_warnings(fallback: Column, flipped: Column, height: Column, prices: Column) -> Column:
    """Ordered array of warnings."""
    return F.array_compact(F.array(
        F.when(fallback, "no price rail was detected here"),
        F.when(flipped, "some text on this photo may have been read upside down"),
        F.when(~fallback & (height < THIN_BAND), "this band is very thin"),
        F.when(repeated_prices(prices) >= REPEATS, "several prices on this rail repeat"),
    ))


def other_prices(slots: DataFrame, lines: DataFrame) -> DataFrame:
    """(band, slot, others): price-shaped lines inside each tag, but for the price itself, in page order."""
    box = tag_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    tags = slots.select("band", "slot", F.col("photo"), F.col("line_id").alias("own"), box.alias("tag"))
    text = F.btrim("text")
    own = lines.filter(text.rlike(PRICE) | text.rlike(BARE_PRICE)).select("photo", "line_id", text.alias("t"), centre(F.col("x0"), F.col("x1")).alias("lx"), centre(F.col("y0"), F.col("y1")).alias("ly"))
    met = tags.join(own, "photo").filter((F.col("line_id") != F.col("own")) & F.col("lx").between(F.col("tag.x0"), F.col("tag.x1")) & F.col("ly").between(F.col("tag.y0"), F.col("tag.y1")))
    return met.groupBy("band", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "t"))), lambda x: x["t"]).alias("others"))


def _quoted(texts: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(texts, 1, most), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), "; ")


def slot_digests(slots: DataFrame, placed: DataFrame, lines: DataFrame, whole: DataFrame) -> DataFrame:
    """(band, slot, value, check, digest): a price, its tag's verdict on it, and the texts around it."""
    ordered = lambda how: F.transform(F.array_sort(F.collect_list(F.when(F.col("how") == how, F.struct("y0", "x0", F.btrim("text").alias("t"))))), lambda x: x["t"])
    around = placed.filter("slot IS NOT NULL").groupBy("band", "slot").agg(ordered("tag").alias("tag_texts"), ordered("label").alias("label_texts"))
    s = slots.join(around, ["band", "slot"], "left").join(other_prices(slots, lines), ["band", "slot"], "left").join(whole.select("band", F.col("x0").alias("bx0"), F.col("x1").alias("bx1")), "band")
    # step by step: in one expression every verdict would read the tag again
    s = s.withColumn("_expected", expected_on_tag(F.array_join("tag_texts", " "))).withColumn("_check", reconcile_with(F.col("value"), F.col("_expected")))
    s = s.withColumn("check", reconcile_text(F.col("_check"), F.col("value")))
    x = rescale(centre(F.col("x0"), F.col("x1")), F.col("bx0"), F.col("bx1"))
    head = F.format_string("%d. price %.2f (read as '%s', confidence %.1f, x=%.3f)", F.col("slot"), F.col("value"), F.btrim("text"), F.col("conf"), x)
    part = lambda texts, name, most: F.when(F.size(texts) > 0, F.concat(F.lit(f"   {name}: "), _quoted(F.col(texts), most)))
    inferred = F.when(F.col("kind") == "bare", F.concat(head, F.lit(" - DECIMAL POINT INFERRED: check this one against the image."))).otherwise(head)
    rows = F.array_compact(F.array(inferred, F.concat(F.lit("   "), "check"), part("tag_texts", "text on the same tag", SHOWN_LINES), part("others", "other numbers printed on this tag", SHOWN_PRICES), part("label_texts", "bottle text above the tag", SHOWN_LINES)))
    return s.select("band", "slot", "value", "check", F.array_join(rows, "\n").alias("digest"))


def jobs(lines: DataFrame, photos: DataFrame, version: str, least_conf: float = LEAST_CONFIDENCE) -> DataFrame:
    """One row per band: job_id, photo, band_index, band_label, crop_box, ocr_prices, ocr_digest, warnings.

    photos: photo, photo_sha256, width, height. A photo without a rail has its unread strips as bands.
    """
    whole, slots, inside = bands(lines, least_conf, photos)
    placed = once(assign_lines(inside, slots.select("band", "slot", "x0", "y0", "x1", "y1")).join(inside, ["band", "line_id"]))
    each = slot_digests(slots, placed, lines, whole)
    read = each.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("slot", "value", "digest"))).alias("s"))
    strays = placed.filter("slot IS NULL").groupBy("band").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", F.btrim("text").alias("t")))), lambda x: x["t"]).alias("strays"))
    flipped = lines.groupBy("photo").agg(F.max(F.coalesce((F.col("conf") >= least_conf) & looks_flipped(F.col("text")), F.lit(False))).alias("flipped"))
    j = whole.join(read, "band", "left").join(strays, "band", "left").join(flipped, "photo").join(photos, "photo")
    n, fallback = F.coalesce(F.size("s"), F.lit(0)), F.col("rail").isNull()
    n = F.when(fallback, 0).otherwise(n)
    prices = F.coalesce(F.transform("s", lambda x: x["value"]), F.array().cast("array<double>"))
    opening = F.when(fallback, "No price rail was detected by local OCR in this image.").otherwise(F.concat(F.lit("Local OCR read "), n.cast("string"), F.lit(" price(s) along this shelf's tag rail, listed left to right.")))
    tail = F.when(F.size("strays") > 0, F.concat(F.lit("Other text in this crop, not tied to a price: "), _quoted(F.col("strays"), SHOWN_STRAYS)))
    digest = F.array_join(F.concat(F.array(opening), F.coalesce(F.transform("s", lambda x: x["digest"]), F.array().cast("array<string>")), F.array_compact(F.array(tail))), "\n")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return j.select(
        job_id(version, F.col("photo_sha256"), F.col("index"), box, n).alias("job_id"), "photo", "photo_sha256", F.array("width", "height").alias("photo_size"), F.col("index").alias("band_index"),
        band_label(F.col("index"), n, F.col("y0"), F.col("y1"), fallback).alias("band_label"), F.array(*box).alias("crop_box"), prices.alias("ocr_prices"), digest.alias("ocr_digest"),
        band_warnings(fallback, F.col("flipped"), F.col("y1") - F.col("y0"), prices).alias("warnings"),
    )


def prompt(fixed: str, *parts: Column) -> Column:
    """Instructions for a reader: fixed lines, then those parts that there are."""
    return F.array_join(F.array_compact(F.array(F.lit(fixed), *parts)), "\n")


def _line(text: str, value: Column) -> Column:
    """``text`` with the value at its {}; NULL, which is left out, without a value."""
    before, after = text.split("{}")
    shown = F.when(value != "", value)
    return F.concat(F.lit(before), shown, F.lit(after))


def layout_prompt(photo: Column, store: Column, taken_at: Column) -> Column:
    """Asks for a plan of a whole photo: which bands of shelves it shows."""
    return prompt("Find the shelves on this photo.", _line("Photo: {}", photo), _line("It was taken, we were told, at {}; report the name you see all the same.", store), _line("Taken: {}", taken_at))


def region_prompt(photo: Column, region: Column, store: Column, currency: Column, taken_at: Column, tiled: Column, has_rail: Column) -> Column:
    """Asks for the products of one region; tiles and regions without their rail of prices get a caution."""
    return prompt(
        "Read all products in this part of a photo.", _line("Part: {}", region), _line("Photo: {}", photo), _line("Shop: {}", store), _line("Unless a tag says otherwise prices are in {}.", currency), _line("Taken: {}", taken_at),
        F.when(tiled, "Neighbouring parts overlap with this one: leave out what is cut off, unless both its name and its price can be read."),
        F.when(~has_rail, "The prices of these products are outside this part: give none, and do not take one from another shelf."),
    )


def band_prompt(photo: Column, label: Column, store: Column, taken_at: Column, digest: Column, warnings: Column) -> Column:
    """Asks for the products of one band, beside what was read on it before; its warnings close the text."""
    notes = F.when(F.size(warnings) > 0, F.concat(F.lit("\nTo be wary of\n\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n")))
    return prompt("Read all products on this shelf.", _line("Shelf: {}", label), _line("Photo: {}", photo), _line("Shop: {}", store), _line("Taken: {}", taken_at), F.concat(F.lit("\nText found on it\n\n"), F.coalesce(digest, F.lit(""))), notes)


def pending_by(pending: DataFrame, column: str) -> DataFrame:
    return pending.groupBy(column).agg(F.count("*").alias("pending")).orderBy(F.col("pending").desc(), column)
