"""Readers: photos, text-line pages, manifests, answers, catalogues, verdicts, truth files and tables.

Bad input never stops a read and never disappears: it comes back as an error
row or stays pending. Every reader takes any path Spark can read.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.money import some

from . import schemas

# Suffixes of photos, and the closed lists of an answer's words.
PHOTO_SUFFIXES = ("jpg", "jpeg", "png", "webp", "heic", "heif", "tif", "tiff", "bmp")
ENUMS = {
    "wine_type": ("red", "white", "rose", "sparkling", "dessert", "fortified", "unknown"),
    "sweetness": ("dry", "semi_dry", "semi_sweet", "sweet", "unknown"),
    "price_kind": ("shelf", "promo", "member", "clearance", "unknown"),
    "name_source": ("price_tag", "bottle_label", "both", "inferred"),
    "pairing_confidence": ("high", "medium", "low"),
}


def photos(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime, content, sha256 of photos below root; hidden parts are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rest = F.regexp_replace("path", "^[^:]*:/*", "/")
    suffix = F.lower(F.regexp_extract(rest, r"\.([^./]+)$", 1))
    return found.filter(suffix.isin(*PHOTO_SUFFIXES) & ~rest.rlike(r"/\.[^/]")).withColumn("sha256", F.sha2("content", 256))


def signed_degrees(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.round(F.when(F.upper(reference).isin("S", "W"), -value).otherwise(value), 6)


def taken_at(*texts: Column) -> Column:
    """The first photo date that parses, as ISO text."""
    return F.coalesce(*[F.date_format(F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss") for t in texts])


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OCR_PAGE).json(path)


def pages_for(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Every wanted (ordinal, path) with its page, or with an error if there is none."""
    joined = wanted.join(found.withColumn("_here", F.lit(True)), "path", "left")
    return joined.withColumn("error", F.when(F.col("_here").isNull(), "the recogniser returned no record").otherwise(F.col("error"))).drop("_here")


def lines(page: DataFrame) -> DataFrame:
    """One row per text line: photo, line_id, text, conf, height_px, x0..y1."""
    each = page.select(F.col("path").alias("photo"), F.posexplode("lines").alias("line_id", "l"))
    box = [F.get("l.b", F.lit(i)).alias(c) for i, c in enumerate(schemas.BOX_FIELDS)]
    return each.select("photo", "line_id", F.col("l.t").alias("text"), F.col("l.c").alias("conf"), F.col("l.h").alias("height_px"), *box)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JOB).json(path).filter("job_id IS NOT NULL")


# --- answers -------------------------------------------------------------------


def unwrap(raw: Column) -> Column:
    """The answer inside a document that wraps it."""
    inner = F.coalesce(*[F.when(F.get_json_object(raw, f"$.{k}").startswith("{"), F.get_json_object(raw, f"$.{k}")) for k in schemas.WRAPPERS])
    return F.when(F.array_contains(F.json_object_keys(raw), "wines"), raw).otherwise(F.coalesce(inner, raw))


def _kind_ok(value: Column, kind: str) -> Column:
    """Whether a JSON scalar's text has the kind; numbers in quotes count, as do whole doubles for int."""
    number = value.try_cast("double")
    checks = {"double": number.isNotNull() | value.isin("true", "false"), "int": (number == F.floor(number)) | value.isin("true", "false")}
    return F.coalesce(checks[kind], F.lit(False)) if kind in checks else F.lit(True)


def _entry_ok(entry: Column, keys: Column, fields: dict[str, str]) -> Column:
    """entry: struct of texts; keys: the keys that its JSON object has."""
    ok = F.lit(True)
    for name, kind in fields.items():
        value = entry[name]
        rule = F.array_contains(keys, name)
        if not kind.endswith("?"):
            rule = rule & value.isNotNull()
        rule = rule & (value.isNull() | _kind_ok(value, kind.rstrip("?")))
        if name in ENUMS:
            rule = rule & value.isin(*ENUMS[name])
        ok = ok & rule
    return F.coalesce(ok, F.lit(False))


def _texts(fields: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{k}:string" for k in fields) + ">>"


def _typed(entry: Column, fields: dict[str, str]) -> Column:
    def cast(name: str, kind: str) -> Column:
        v = entry[name]
        kind = kind.rstrip("?")
        if kind in ("double", "int"):
            number = F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
            v = number.cast("int") if kind == "int" else number
        elif kind == "strings":
            v = F.from_json(v, "array<string>")
        elif kind == "box":
            v = F.from_json(v, "struct<x0:double,y0:double,x1:double,y1:double>")
        return v.alias(name)

    return F.struct(*[cast(k, kind) for k, kind in fields.items()])


def parse_answers(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(job_id, raw) to (job_id, valid, wines, unreadable_tags, non_wine_present, notes) and the columns to keep.

    Schemas of JSON readers turn what is missing into NULL, so keys, kinds and
    closed lists are checked by hand; one fault makes the whole answer invalid.
    """
    wine_texts, tag_texts = _texts(schemas.WINE_FIELDS), _texts(schemas.TAG_FIELDS)
    parsed = raw.withColumn("_a", unwrap(F.col("raw"))).withColumn("_keys", F.json_object_keys("_a"))
    for key, ddl in (("wines", wine_texts), ("unreadable_tags", tag_texts)):
        parsed = parsed.withColumn(f"_{key}_raw", F.from_json(F.get_json_object("_a", f"$.{key}"), "array<string>"))
        parsed = parsed.withColumn(f"_{key}", F.from_json(F.get_json_object("_a", f"$.{key}"), ddl))
    entry = lambda key, fields: F.forall(F.zip_with(f"_{key}", f"_{key}_raw", lambda e, r: _entry_ok(e, F.json_object_keys(r), fields)), lambda x: x)
    needed = F.forall(F.array(*[F.lit(k) for k in ("wines", "unreadable_tags", "non_wine_present", "notes")]), lambda k: F.array_contains("_keys", k))
    flag = F.get_json_object("_a", "$.non_wine_present")
    valid = F.coalesce(needed & F.col("_wines").isNotNull() & F.col("_unreadable_tags").isNotNull() & flag.isin("true", "false") & entry("wines", schemas.WINE_FIELDS) & entry("unreadable_tags", schemas.TAG_FIELDS), F.lit(False))
    return parsed.select(
        "job_id", valid.alias("valid"),
        F.when(valid, F.transform("_wines", lambda e: _typed(e, schemas.WINE_FIELDS))).alias("wines"),
        F.when(valid, F.transform("_unreadable_tags", lambda e: _typed(e, schemas.TAG_FIELDS))).alias("unreadable_tags"),
        F.when(valid, flag.cast("boolean")).alias("non_wine_present"), F.when(valid, F.get_json_object("_a", "$.notes")).alias("notes"), *keep,
    )


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers below a folder, one document per file, keyed by the file's name."""
    text = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("job_id"), F.col("value").alias("raw"))
    return parse_answers(text.filter("job_id <> ''"))


def pending(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Jobs without a valid answer."""
    return jobs.join(found.filter("valid"), "job_id", "left_anti")


def batch_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items (custom_id, ...) with their batch result (custom_id, kind, raw): what did not succeed has an error and no answer; unknown ids are left out."""
    good = F.col("kind") == "succeeded"
    got = results.select("custom_id", F.when(good, F.col("raw")).alias("raw"), F.when(~good, F.concat(F.lit("batch result: "), "kind")).alias("error"))
    return items.join(got, "custom_id")


def missing_errors(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """An error row (photo, stage, detail) for each job without a valid answer."""
    detail = F.concat(F.lit("no usable answer for job "), "job_id", F.lit(" ("), F.coalesce("band_label", F.lit("")), F.lit(")"))
    return pending(jobs, found).select("photo", F.lit("read").alias("stage"), detail.alias("detail"))


# --- tables ----------------------------------------------------------------------


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[(F.when(F.col(f"`{f.name}`") != "", F.col(f"`{f.name}`")) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Brand rows of a tab-separated file, trimmed, with a byte order mark or without."""
    found = spark.read.option("sep", "\t").option("header", "true").csv(path)
    clean = {c: c.lstrip("﻿").strip() for c in found.columns}
    known = [(c, schemas.CATALOGUE[n]) for c, n in clean.items() if n in schemas.CATALOGUE]
    return found.select(*[F.btrim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(n) for c, n in known])


def verdicts(batches: DataFrame, picks: DataFrame) -> DataFrame:
    """(key, brand, confidence) from batch items (file, key, candidates) and picks (file, ordinal, key, choice, confidence).

    choice counts from 1; anything else is no brand. The last file, then the last pick, decides.
    """
    both = picks.join(batches, ["file", "key"])
    good = F.col("choice").between(1, F.size("candidates"))
    brand = F.when(good, F.get("candidates", F.col("choice") - 1))
    row = both.select("key", "file", "ordinal", brand.alias("brand"), F.coalesce(some(F.col("confidence")), F.when(good, "medium").otherwise("low")).alias("confidence"))
    return row.groupBy("key").agg(F.max_by(F.struct("brand", "confidence"), F.struct("file", "ordinal")).alias("v")).select("key", "v.*")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Hand-checked rows in file order; lines that begin with #, after blanks, are remarks; rows need a price."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.monotonically_increasing_id().alias("truth_no"))
    rows = text.filter(~F.ltrim("value").startswith("#") & (F.btrim("value") != ""))
    # the header names the columns; each file's first row is one, and its columns may stand in any order
    head = rows.agg(F.min_by("value", "truth_no").alias("h")).first()["h"]
    if head is None:
        return spark.createDataFrame([], "truth_no long, photo string, rail string, position string, currency string, name_contains string, notes string, price double, volume_ml double")
    given = [c.strip() for c in next(csv.reader([head]))]
    fields = ", ".join(f"`{c}` STRING" for c in given)
    row = rows.filter(F.col("value") != head).select("truth_no", F.from_csv("value", F.lit(fields), {"escape": '"'}).alias("r")).select("truth_no", "r.*")
    row = row.withColumns({c: F.lit(None).cast("string") for c in ("photo", "rail", "position", "currency", "name_contains", "notes", "price", "volume_ml") if c not in given})
    number = lambda c: F.btrim(c).try_cast("double")
    trimmed = [F.btrim(F.coalesce(c, F.lit(""))).alias(c) for c in ("photo", "rail", "position", "currency", "name_contains", "notes")]
    return row.select("truth_no", *trimmed, number("price").alias("price"), number("volume_ml").alias("volume_ml")).filter("price IS NOT NULL")


def table(spark: SparkSession, path: str, numeric=schemas.NUMERIC_COLUMNS) -> DataFrame:
    """A written table again: typed, blanks NULL, its byte order mark taken off."""
    found = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    found = found.toDF(*[c.lstrip("﻿") for c in found.columns])
    found = _blank_to_null(found)
    return found.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in found.columns])


def primaries(rows: DataFrame) -> DataFrame:
    return rows.filter("duplicate_of IS NULL OR trim(duplicate_of) = ''")


def store_aliases(text: str) -> dict[str, str]:
    """Folded alias to name, from YAML of {name: [aliases]} or {alias: name}, under ``stores`` or not."""
    import re

    import yaml

    fold = lambda s: re.sub(r"[\s_\-]+", " ", str(s).strip().lower())
    found = yaml.safe_load(text) or {}
    entries = found.get("stores", found)
    out: dict[str, str] = {}
    for key, value in entries.items() if isinstance(entries, dict) else ():
        names = [key, *value] if isinstance(value, list) else [key, value] if isinstance(value, str) else []
        out.update((fold(n), key if isinstance(value, list) else value) for n in names)
    return out
