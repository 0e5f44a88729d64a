"""Second opinions on a price: the rail it stands on, its multiples, and its tag's own arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.functions.money import PRICE_TOLERANCE, parse_price

# Ratios and tolerances of the sibling checks.
MULTIBUY_RATIOS = (2.0, 3.0, 1 / 3, 0.5)
MULTIBUY_LEAST, MULTIBUY_SHARE = 0.01, 0.01
COMMON_LITRES = (0.75, 1.5, 2.0, 3.0, 5.0)
PER_LITRE_LEAST, PER_LITRE_SHARE = 0.02, 0.005
DROPPED_DIGIT_PRICE, DROPPED_DIGIT_VOLUME = 10.0, 1000.0
RECONCILE_SHARE = 0.02
# How tags print a price per litre and a volume.
UNIT_PRICE = (
    r"(?i)(?:1\s*(?:l|lt|ltr|litr[ux]?)|lei\s*/\s*l(?:tr)?|pre[tț]\s*/\s*l|/\s*l\b)[^\d]{0,8}(\d{1,4}[.,]\d{2})"
    r"|(\d{1,4}[.,]\d{2})\s*(?:lei\s*)?/\s*l(?:tr|itru)?\b"
)
TAG_VOLUME = r"(?i)(\d+(?:[.,]\d+)?)\s*[-\s]?(l|lt|litri|litru|ml|cl)\b"
LITRES_BY_UNIT = {"l": 1.0, "lt": 1.0, "litri": 1.0, "litru": 1.0, "ml": 0.001, "cl": 0.01}


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def referee(price: Column, rail: Column, index: Column) -> Column:
    """struct(verdict, claimed): a price and the 1-based place it claims on its rail, against the rail's prices."""
    size = F.size(F.coalesce(rail, F.array().cast("array<double>")))
    claimed = F.when(index.between(1, size), F.get(rail, index - 1))
    on_rail = F.coalesce(F.exists(rail, lambda p: F.abs(p - price) < PRICE_TOLERANCE), F.lit(False))
    verdict = (
        F.when(price.isNull(), "no_price")
        .when(size == 0, "no_ocr_price")
        .when(claimed.isNotNull() & (F.abs(claimed - price) < PRICE_TOLERANCE), "ok")
        .when(claimed.isNotNull() & on_rail, "index_mismatch")
        .when(claimed.isNotNull(), "disagrees")
        .when(on_rail, "ok_unindexed")
        .otherwise("not_on_rail")
    )
    return F.struct(verdict.alias("verdict"), F.when(price.isNotNull(), claimed).alias("claimed"))


def _others(price: Column, rail: Column, related) -> Column:
    """Rail prices that differ from ``price`` and are related to it, in rail order; none without a positive price."""
    usable = lambda p: (p > 0) & (F.abs(p - price) >= PRICE_TOLERANCE)
    kept = F.filter(rail, lambda p: usable(p) & related(p))
    return F.when((price > 0) & rail.isNotNull(), kept).otherwise(F.array().cast("array<double>"))


def multibuy_siblings(price: Column, rail: Column) -> Column:
    near = lambda p, r: F.abs(p - price * r) <= F.greatest(F.lit(MULTIBUY_LEAST), MULTIBUY_SHARE * price * r)
    return _others(price, rail, lambda p: _any(near(p, r) for r in MULTIBUY_RATIOS))


def per_litre_siblings(price: Column, rail: Column) -> Column:
    near = lambda a, b, litres: F.abs(b - a / litres) <= F.greatest(F.lit(PER_LITRE_LEAST), PER_LITRE_SHARE * b)
    return _others(price, rail, lambda p: _any(near(a, b, v) for v in COMMON_LITRES for a, b in ((price, p), (p, price))))


def dropped_digit(price: Column, volume_ml: Column) -> Column:
    large = F.coalesce(volume_ml > DROPPED_DIGIT_VOLUME, F.lit(False))
    return F.coalesce((price > 0) & (price < DROPPED_DIGIT_PRICE), F.lit(False)) & ~large


def _shown(values: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct(values)), 1, most), lambda v: F.format_string("%.2f", v)), ", ")


def referee_reasons(verdict: Column, price: Column, volume_ml: Column, rail: Column) -> Column:
    """Ordered array of what the checks have against a row."""
    litre, tier = per_litre_siblings(price, rail), multibuy_siblings(price, rail)
    reasons = (
        F.when(verdict.isin("disagrees", "not_on_rail", "index_mismatch"), F.concat(F.lit("against the rail: "), verdict)),
        F.when(dropped_digit(price, volume_ml), F.concat(price.cast("string"), F.lit(" is little for this volume: a digit may be missing"))),
        F.when(F.size(litre) > 0, F.concat(F.lit("the rail has a price per litre as well: "), _shown(litre, 2))),
        F.when(F.size(tier) > 0, F.concat(F.lit("the rail has prices of several pieces as well: "), _shown(tier, 3))),
    )
    return F.array_compact(F.array(*reasons))


def litres_on_tag(text: Column) -> Column:
    """The first volume of 0.1 to 20 litres on a tag, its per-litre clause left out."""
    rest = F.regexp_replace(text, UNIT_PRICE, " ")
    numbers, units = (F.regexp_extract_all(rest, F.lit(TAG_VOLUME), F.lit(g)) for g in (1, 2))
    table = F.create_map(*[F.lit(x) for pair in LITRES_BY_UNIT.items() for x in pair])
    litres = F.zip_with(numbers, units, lambda n, u: F.replace(n, F.lit(","), F.lit(".")).try_cast("double") * table[F.lower(u)])
    return F.get(F.filter(litres, lambda v: v.between(0.1, 20)), F.lit(0))


def expected_on_tag(tag_text: Column) -> Column:
    """Unit price times volume, as a tag prints them; NULL if it does not say."""
    first = F.regexp_extract(tag_text, UNIT_PRICE, 1)
    unit = parse_price(F.when(first != "", first).otherwise(F.regexp_extract(tag_text, UNIT_PRICE, 2)))
    return F.when(unit > 0, unit) * litres_on_tag(tag_text)


def reconcile_with(price: Column, expected: Column) -> Column:
    """struct(verdict, expected, trimmed) of a price against what its tag lets expect, NULL without that; for expected as a column.

    verdict: confirmed, leading_digit (it agrees without its first digit) or disagrees.
    """
    off = lambda v: F.abs(v - expected) / expected <= RECONCILE_SHARE
    digits = F.replace(F.format_string("%.2f", price), F.lit("."), F.lit(""))
    trimmed = F.when(F.length(digits) > 3, digits.substr(2, 20).try_cast("double") / 100.0)
    helps = (trimmed > 0) & off(trimmed)
    verdict = F.when(off(price), "confirmed").when(helps, "leading_digit").otherwise("disagrees")
    return F.when(expected > 0, F.struct(verdict.alias("verdict"), expected.alias("expected"), F.when(helps & ~off(price), trimmed).alias("trimmed")))


def reconcile(price: Column, tag_text: Column) -> Column:
    """``reconcile_with`` in one expression."""
    return reconcile_with(price, expected_on_tag(tag_text))


def reconcile_text(check: Column, price: Column) -> Column:
    """The verdict in words."""
    two = lambda c: F.format_string("%.2f", c)
    product = F.concat(F.lit("price per litre times volume is "), two(check["expected"]))
    return (
        F.when(check["verdict"] == "confirmed", F.concat(product, F.lit(": confirmed")))
        .when(check["verdict"] == "leading_digit", F.concat(product, F.lit(", not "), two(price), F.lit("; without its first digit it is "), two(check["trimmed"])))
        .when(check["verdict"] == "disagrees", F.concat(product, F.lit(", not "), two(price)))
    )
