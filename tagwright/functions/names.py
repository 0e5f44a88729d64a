"""Names, keys and folders as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import some

# Letters with marks and what they fold to in keys and in brand tokens.
KEY_MARKED, KEY_PLAIN = "ăâîșțĂÂÎȘȚáéíóúüöäàèìòù", "aaistAAISTaeiouuoaaeiou"
BRAND_MARKED, BRAND_PLAIN = "ăâîșțĂÂÎȘȚáéíóúüöäàèìòùçñ", "aaistAAISTaeiouuoaaeioucn"
# Words of a tag that name no brand.
STOP_WORDS = (
    "VIN", "VINUL", "VINURI", "WINE", "ALB", "ALBA", "ROSU", "ROSIE", "ROZE", "ROSE", "NEGRU", "WHITE", "RED", "SEC", "SECO", "DEMISEC", "DULCE",
    "DEMIDULCE", "DRY", "SWEET", "DS", "DD", "SGR", "NRB", "CC", "PL", "ST", "STICLA", "BOTTLE", "BIB", "L", "ML", "CL", "LT", "LITRU", "LITRI",
    "LITRE", "LITER", "LITERS", "LEI", "BUC", "PRET", "PRETUL", "PET", "DAMIGEANA", "DAMIGEAN", "SAU", "DE", "LA", "SI", "CU", "DIN", "PE", "AL", "A",
    "R", "S", "N", "VOL", "ALC", "GARANTIE", "AMBALAJ", "TVA", "CABERNET", "SAUVIGNON", "BLANC", "MERLOT", "CHARDONNAY", "RIESLING", "PINOT", "NOIR",
    "GRIGIO", "GRIS", "SYRAH", "SHIRAZ", "MUSCAT", "OTTONEL", "FETEASCA", "REGALA", "NEAGRA", "TAMAIOASA", "ROMANEASCA", "BUSUIOACA", "BOHOTIN",
    "ALIGOTE", "TRAMINER", "SPUMANT", "CUPAJ", "BLEND", "ROSATO", "BIANCO", "ROSSO", "VARIETAL", "SORT", "DOC", "DOCG", "CMD", "CMI", "CIB", "DOP",
    "IGP", "IGT", "AOC", "AOP", "VS", "VSO", "VSOC", "PGI", "PDO", "RESERVE", "REZERVA", "RISERVA", "SUPERIOR", "SUPERIORE", "CLASSICO", "GRAND",
    "CRU", "SELECTION", "SELECTIE", "COLLECTION", "COLECTIA", "EDITION", "EDITIE", "PREMIUM", "LABEL", "LINE", "ARTICLE", "ILIZIBIL", "ILIZIBILA",
    "ILLEGIBLE", "UNREADABLE", "PARTLY", "CREST", "OVAL", "CREM", "TEXT", "BAG", "BOX", "IN", "OUT", "ANI", "YEARS", "UNICA", "MATURAT", "BARIC",
    "BARICURI", "BARRIQUE", "OAK", "STEJAR", "IMAGE", "PHOTO", "CROP", "TAG", "VISIBLE", "PARTIAL", "BLURRED", "BLUR", "PROMO", "REDUCERE", "OFERTA",
)
# Folder names that name no shop.
GENERIC_FOLDERS = (
    "photos", "photo", "pics", "pictures", "images", "img", "samples", "sample", "data", "input", "inputs", "wine", "wines", "shelf", "shelves",
    "new", "unsorted", "misc", "tmp", "temp", "downloads", "camera", "dcim", "batch", "trip", "visit", "store", "stores", "out", "raw",
)


def _folding() -> tuple[str, str]:
    """Every single letter that compatibility decomposition turns into one of A-Z, a-z or 0-9 and marks."""
    pairs = dict(zip(BRAND_MARKED, BRAND_PLAIN, strict=True))
    for code in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs.setdefault(chr(code), base)
    return "".join(pairs), "".join(pairs.values())


_FOLD_FROM, _FOLD_TO = _folding()


def fold_key_name(name: Column) -> Column:
    """Lower case, marks folded, anything but letters, digits and _ to single spaces."""
    plain = F.translate(F.lower(name), KEY_MARKED, KEY_PLAIN)
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def dedupe_key(store: Column, name: Column, vintage: Column, volume_ml: Column) -> Column:
    """The identity of a product seen twice; its price is left out on purpose."""
    volume = F.when(volume_ml != 0, F.bround(volume_ml, 0).cast("bigint").cast("string"))
    parts = (F.btrim(F.lower(store)), fold_key_name(name), F.btrim(vintage), volume)
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def brand_tokens(text: Column) -> Column:
    """Array of brand-bearing words, in order, repeats kept."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)", " ")
    flat = F.upper(F.regexp_replace(F.translate(bare, _FOLD_FROM, _FOLD_TO), r"\p{M}+", ""))
    words = F.regexp_extract_all(flat, F.lit("[A-Z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+[A-Z]*$") & ~F.array_contains(stop, w))


def name_key(name: Column) -> Column:
    return F.array_join(brand_tokens(name), " ")


def fold_truth(text: Column) -> Column:
    """Upper case without marks; runs of other signs become one space each."""
    return F.regexp_replace(F.upper(F.translate(F.coalesce(text, F.lit("")), KEY_MARKED, KEY_PLAIN)), "[^A-Z0-9 ]+", " ")


def fold_folder(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(text)), r"[\s_\-]+", " ")


def prettify(folder: Column) -> Column:
    """Words in lower case get a capital; others stay as they are."""
    words = F.filter(F.split(F.btrim(F.regexp_replace(folder, r"[\s_\-]+", " ")), " "), lambda w: w != "")
    capital = lambda w: F.when((w == F.lower(w)) & (w != F.upper(w)), F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(2, 1 << 30)))).otherwise(w)
    return F.array_join(F.transform(words, capital), " ")


def resolve_store(folders: Column, override: Column, aliases: Column, read_on_photo: Column) -> Column:
    """struct(store, source): given, by the deepest folder with an alias, by the deepest telling folder, by the photo, or unknown.

    folders: array of folder names below the root, outermost first. aliases: map of folded alias to name.
    """
    deepest = F.reverse(folders)
    by_alias = F.get(F.filter(F.transform(deepest, lambda p: aliases[fold_folder(p)]), lambda x: x.isNotNull()), F.lit(0))
    telling = lambda p: (fold_folder(p) != "") & ~fold_folder(p).isin(*GENERIC_FOLDERS) & ~fold_folder(p).rlike(r"^[\d\W_]+$")
    by_folder = prettify(F.get(F.filter(deepest, telling), F.lit(0)))
    photo = some(read_on_photo)
    on_photo = F.coalesce(aliases[fold_folder(photo)], prettify(photo))
    row = lambda store, source: F.when(store.isNotNull(), F.struct(store.alias("store"), F.lit(source).alias("source")))
    return F.coalesce(
        row(some(override), "cli"), row(some(by_alias), "folder-map"), row(by_folder, "folder"), row(on_photo, "photo"), row(F.lit("Unknown"), "none")
    )


def folder_of(photo: Column) -> Column:
    """The folder of a relative path, '.' for the root."""
    return F.coalesce(some(F.regexp_extract(photo, r"^(.*?)/+[^/]*/*$", 1)), F.lit("."))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)[^\w\-]+", "-"), F.lit("-"))


def job_id(version: str, sha: Column, index: Column, box: list[Column], n_slots: Column) -> Column:
    """Stable id of a work item: 16 hex digits over what it is made of."""
    corners = F.concat_ws(",", *[F.format_string("%.4f", c) for c in box])
    return F.sha2(F.concat_ws("|", F.lit(version), sha, index.cast("string"), corners, n_slots.cast("string")), 256).substr(1, 16)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("||", *[p.cast("string") for p in parts]), 256).substr(1, 40)
