"""Summaries: folder index, work lists, status lines, briefs and the HTML review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.geometry import format_bbox, pixel_region, to_full
from tagwright.functions.money import (
    check_price, check_unit_price, detect_currency, discount_pct, normalize_vintage, normalize_volume, parse_price, price_per_litre, review_reasons, round_half_up, some,
)
from tagwright.functions.names import folder_of
from tagwright.operators.referee import referee, referee_reasons


REVIEW_COLUMNS = (
    "row_id", "wine_name", "producer", "wine_type", "vintage", "price", "currency", "volume_ml", "price_per_litre", "pairing_confidence",
    "price_check", "unit_price_check", "review_reasons", "raw_tag_text", "shelf", "bottle_bbox", "tag_bbox",
)


def median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): exact, from counts of distinct values and their running sums, which spill; no task holds all values of a key in memory."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_n").over(own.orderBy(value))).withColumn("_all", F.sum("_n").over(own))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(value)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def price_index(df: DataFrame, keys: list[str], photo: str, price: str, flag: Column, label: str) -> DataFrame:
    """Per key: photos (distinct), rows, priced, flagged, exact median of the prices, sorted distinct labels of priced rows."""
    counts = df.groupBy(*keys).agg(
        F.countDistinct(photo).alias("photos"), F.count("*").alias("n_rows"), F.count(price).alias("priced"), F.count(F.when(flag, 1)).alias("needs_review"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col(price).isNotNull(), some(F.col(label))))), "; ").alias("currency"),
    )
    medians = median_by(df, keys, price).select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return counts.join(medians, same, "left").select(*keys, "photos", "n_rows", "priced", "needs_review", round_half_up(F.col("median"), 2).alias("median_price"), "currency")


def folder_index(rows: DataFrame, unmatched: DataFrame) -> DataFrame:
    """The index of source folders, those with nothing but unmatched tags included."""
    own = rows.filter("duplicate_of IS NULL").withColumn("folder", folder_of(F.col("photo")))
    index = price_index(own, ["folder"], "photo", "price", F.col("needs_review") == "yes", "currency")
    stray = unmatched.select(folder_of(F.col("photo")).alias("folder")).distinct()
    joined = index.join(stray, "folder", "full")
    return joined.select("folder", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("photos", "n_rows", "priced", "needs_review")], "median_price", F.coalesce("currency", F.lit("")).alias("currency"))


def assemble(jobs: DataFrame, answers: DataFrame, model: str, extracted_at: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unmatched) of all jobs with a valid answer: one row per entry, with its ordinal (job_id, entry)."""
    met = jobs.join(answers.filter("valid"), "job_id")
    box = F.struct(*[F.get("crop_box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    pw, ph = F.get("photo_size", F.lit(0)), F.get("photo_size", F.lit(1))
    met = met.withColumn("_region", pixel_region(box, pw, ph))
    e = met.select("*", F.posexplode("wines").alias("entry", "w"))
    w = lambda c: F.col(f"w.{c}")
    volume = normalize_volume(w("volume_ml"), w("raw_tag_text"), w("raw_label_text"), w("wine_name"))
    e = e.withColumn("_volume", volume).withColumn("_currency", F.coalesce(some(w("currency")), detect_currency(w("price_text"), w("raw_tag_text"))))
    e = e.withColumn("_litre", price_per_litre(w("price"), F.col("_volume"))).withColumn("_reading", parse_price(w("price_text")))
    e = e.withColumn("_check", check_price(w("price"), w("price_text"), F.col("_reading")))
    e = e.withColumn("_unit", check_unit_price(F.col("_litre"), w("unit_price_text"))).withColumn("_ref", referee(w("price"), F.col("ocr_prices"), w("ocr_price_index")))
    own = review_reasons(w("pairing_confidence"), w("price"), F.col("_check"), F.col("_unit"), w("wine_name"), F.col("_currency"), F.col("_volume"), F.col("_litre"))
    e = e.withColumn("_reasons", F.concat(own, referee_reasons(F.col("_ref.verdict"), w("price"), F.col("_volume"), F.col("ocr_prices"))))
    same = ("producer", "wine_type", "sweetness", "price", "price_kind", "original_price", "region", "country", "abv_percent", "promo_text", "unit_price_text", "pairing_confidence", "pairing_note", "name_source", "price_text", "raw_tag_text", "raw_label_text")
    full = lambda c: format_bbox(to_full(w(c), F.col("_region"), pw, ph)).alias(c)
    rows = e.select(
        "job_id", "entry", "store", F.btrim(w("wine_name")).alias("wine_name"), *[w(c).alias(c) for c in same],
        normalize_vintage(w("vintage"), w("raw_label_text"), w("raw_tag_text")).alias("vintage"), F.col("_currency").alias("currency"), F.col("_volume").alias("volume_ml"),
        F.col("_litre").alias("price_per_litre"), discount_pct(w("price"), w("original_price")).alias("discount_pct"), F.array_join(w("grape_varieties"), "; ").alias("grape_varieties"),
        F.when(F.size("_reasons") > 0, "yes").alias("needs_review"), F.array_join("_reasons", "; ").alias("review_reasons"), F.col("_check").alias("price_check"), F.col("_unit").alias("unit_price_check"),
        F.col("_ref.claimed").alias("ocr_price"), F.col("_ref.verdict").alias("ocr_price_check"), "photo", "photo_taken_at", "store_source", F.col("band_label").alias("shelf"),
        full("bottle_bbox"), full("tag_bbox"), "photo_sha256", F.lit(model).alias("model"), F.lit(extracted_at).alias("extracted_at"),
    )
    t = met.select("*", F.posexplode("unreadable_tags").alias("entry", "t"))
    unmatched = t.select("store", "photo", F.col("band_label").alias("shelf"), *[F.col(f"t.{c}").alias(c) for c in ("raw_text", "price", "currency", "reason")], format_bbox(to_full(F.col("t.tag_bbox"), F.col("_region"), pw, ph)).alias("tag_bbox"))
    return rows, unmatched


def percent(part: Column, whole: Column) -> Column:
    return F.concat(F.when(whole > 0, F.bround(part * 100.0 / F.when(whole > 0, whole), 0).cast("int")).otherwise(0).cast("string"), F.lit("%"))


def status(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: jobs, answered, pending and the share answered."""
    done = jobs.join(answers.filter("valid").select("job_id", F.lit(1).alias("_d")), "job_id", "left")
    return done.agg(F.count("*").alias("jobs"), F.count("_d").alias("answered"), (F.count("*") - F.count("_d")).alias("pending"), percent(F.count("_d"), F.count("*")).alias("done"))


def work_list(pending: DataFrame, limit: int | None = None, compact: bool = False) -> DataFrame:
    """Photos with pending jobs, those with the fewest first: photo, bands, job ids in band order; or one short line each."""
    own = pending.groupBy("photo", "photo_sha256").agg(F.count("*").alias("bands"), F.transform(F.array_sort(F.collect_list(F.struct("band_index", "job_id"))), lambda x: x["job_id"]).alias("jobs")).orderBy("bands", "photo")
    own = own.limit(limit) if limit is not None else own
    name = F.regexp_extract("photo", r"([^/]*)$", 1)
    return own.select(F.concat(F.col("photo_sha256"), F.lit("|"), name.substr(1, 24)).alias("line")) if compact else own


def briefs(jobs: DataFrame, prompt: str) -> DataFrame:
    """One Markdown document per photo, its jobs in band order."""
    part = F.concat(F.lit("## "), "band_label", F.lit("\n\njob: "), "job_id", F.lit("\n\n"), F.coalesce("ocr_digest", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("band_index", part.alias("text")))), lambda x: x["text"])
    return jobs.groupBy("photo").agg(F.concat(F.lit("# "), F.first("photo"), F.lit(f"\n\n{prompt}\n\n"), F.array_join(ordered, "\n\n")).alias("brief"))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def review_html(rows: DataFrame) -> DataFrame:
    """(photo, section) in photo order: an HTML section with one line per row, flagged ones marked."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.col(c)), F.lit("</td>"))
    kind = F.when(F.col("needs_review") == "yes", "flag").otherwise("ok")
    shown = [c for c in REVIEW_COLUMNS if c in rows.columns]
    line = F.concat(F.lit('<tr class="'), kind, F.lit('">'), *[cell(c) for c in shown], F.lit("</tr>"))
    name = F.coalesce(some(F.btrim("photo")), F.lit("(unknown photo)"))
    got = rows.select(name.alias("photo"), F.struct("row_id", line.alias("h")).alias("r")).groupBy("photo").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    body = F.array_join(F.transform("rs", lambda x: x["h"]), "\n")
    count = F.concat(F.lit(" - "), F.size("rs").cast("string"), F.lit(" row(s)"))
    return got.select("photo", F.concat(F.lit("<section><h2>"), escape_html(F.col("photo")), count, F.lit("</h2><table>\n"), body, F.lit("\n</table></section>")).alias("section")).orderBy("photo")


def review_counts(rows: DataFrame) -> DataFrame:
    """One row: rows, those with a price, flagged ones, those with a box to crop, and photos."""
    n = lambda c: F.count(F.when(c, 1))
    boxed = some(F.col("bottle_bbox")).isNotNull() | some(F.col("tag_bbox")).isNotNull()
    photo = F.coalesce(some(F.btrim("photo")), F.lit("(unknown photo)"))
    return rows.agg(F.count("*").alias("n_rows"), n(F.col("price").isNotNull()).alias("priced"), n(F.col("needs_review") == "yes").alias("flagged"), n(boxed).alias("boxed"), F.countDistinct(photo).alias("photos"))


def most_common(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return df.filter(some(F.col(column)).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(limit)


def cost(usage: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sums of token counters and what they cost, weights being prices per million."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in weights]
    return usage.agg(*sums).withColumn("cost", sum((F.col(c) * F.lit(p) for c, p in weights.items()), F.lit(0.0)) / 1e6)


def chunks(items: DataFrame, group: str, order: str, size: str, most_items: int = 500, most_bytes: int = 180 << 20) -> DataFrame:
    """Sequential chunks of at most so many items and bytes, numbered within each group; a fold over the group's ordered sizes."""
    step = lambda s, x: F.struct(
        F.when(fresh(s, x), s["chunk"] + 1).otherwise(s["chunk"]).alias("chunk"), F.when(fresh(s, x), F.lit(1)).otherwise(s["n"] + 1).alias("n"),
        F.when(fresh(s, x), x["b"]).otherwise(s["b"] + x["b"]).alias("b"), F.concat(s["out"], F.array(F.when(fresh(s, x), s["chunk"] + 1).otherwise(s["chunk"]))).alias("out"),
    )
    fresh = lambda s, x: (s["n"] > 0) & ((s["n"] >= most_items) | (s["b"] + x["b"] > most_bytes))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("b"), F.array().cast("array<int>").alias("out"))
    own = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("b")))).alias("xs"))
    cut = own.withColumn("c", F.aggregate("xs", zero, step)["out"])
    return cut.select(group, F.explode(F.arrays_zip("xs", "c")).alias("z")).select(group, F.col("z.xs.o").alias(order), F.col("z.c").alias("chunk"))


def with_order(df: DataFrame, partition: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
