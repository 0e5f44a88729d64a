"""Brand resolution: an inverted index of catalogue tokens weighted by rarity.

Names meet the catalogue by an equi-join on tokens, never by a cross join. Every
distinct name is matched once and joined back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.names import brand_tokens, name_key

# What makes an anchor, a match and a prefix.
ANCHOR_IDF, ANCHOR_LENGTH = 3.0, 3
LEAST_SCORE, LEAST_MARGIN, TIE = 4.0, 1.0, 1e-9
PREFIX_SHORT, PREFIX_LONG, PREFIX_WEIGHT = 4, 8, 0.6
TOP, SHOWN = 14, 4


def catalogue(rows: DataFrame, texts: list[Column], tokens=brand_tokens) -> DataFrame:
    """rows with their key tokens (a set); rows without any are left out, as they can match nothing."""
    return rows.withColumn("key_tokens", F.array_distinct(F.flatten(F.array(*map(tokens, texts))))).filter(F.size("key_tokens") > 0)


def token_idf(index: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(rows / df)."""
    df = index.select(F.explode("key_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rows = index.agg(F.count("*").cast("double")).scalar()  # a subquery of the plan: no job while it is made
    return df.select("token", "df", F.log(rows / F.col("df")).alias("idf"))


def postings(index: DataFrame, row_id: str) -> DataFrame:
    """(token, idf, row, key_size, label)."""
    each = index.select(F.col(row_id).alias("row"), F.size("key_tokens").alias("key_size"), "label", F.explode("key_tokens").alias("token"))
    return each.join(token_idf(index).select("token", "idf"), "token")


def match(names: DataFrame, key: str, tokens: str, post: DataFrame, least_score=LEAST_SCORE, anchor_idf=ANCHOR_IDF, margin=LEAST_MARGIN) -> DataFrame:
    """(key, row, score, matched) per name that shares an anchor with the catalogue.

    The best row is the highest sum of anchor IDFs; equal scores go to fewer key
    tokens, then label, then row. A win by less than the margin does not match,
    a true tie does.
    """
    anchors = names.select(key, F.explode(F.array_distinct(tokens)).alias("token")).filter(F.length("token") >= ANCHOR_LENGTH)
    scores = anchors.join(post.filter(F.col("idf") >= anchor_idf), "token").groupBy(key, "row", "key_size", "label").agg(F.sum("idf").alias("score"))
    own = Window.partitionBy(key)
    top = scores.withColumn("best", F.max("score").over(own)).withColumn("tied", F.col("score") >= F.col("best") - TIE)
    runner = F.max(F.when(~F.col("tied"), F.col("score"))).over(own)
    ranked = (
        top.withColumn("ties", F.sum(F.col("tied").cast("int")).over(own))
        .withColumn("runner", F.coalesce(runner, F.lit(0.0)))
        .filter("tied")
        .withColumn("place", F.row_number().over(own.orderBy("key_size", "label", "row")))
        .filter("place = 1")
    )
    good = (F.col("best") >= least_score) & ((F.col("ties") > 1) | (F.col("best") - F.col("runner") >= margin))
    return ranked.select(key, "row", F.col("best").alias("score"), good.alias("matched"))


def match_cascade(names: DataFrame, key: str, attempts: list[list[Column]], post: DataFrame, **limits) -> DataFrame:
    """(key, row, score, attempt): the first attempt - a list of texts - that matches; all attempts share one join."""
    tries = F.array(*[F.struct(F.lit(i).alias("attempt"), F.array_distinct(F.flatten(F.array(*map(brand_tokens, texts)))).alias("tokens")) for i, texts in enumerate(attempts)])
    each = names.select(key, F.explode(tries).alias("t")).select(F.struct(F.col(key).alias("k"), F.col("t.attempt").alias("attempt")).alias("_try"), F.col("t.tokens").alias("tokens"))
    found = match(each, "_try", "tokens", post, **limits).filter("matched")
    return found.groupBy(F.col("_try.k").alias(key)).agg(F.min_by(F.struct("row", "score", F.col("_try.attempt").alias("attempt")), F.col("_try.attempt")).alias("m")).select(key, "m.*")


def candidates(names: DataFrame, key: str, tokens: str, post: DataFrame, brand: list[str], details: DataFrame, limit: int = TOP) -> DataFrame:
    """The best ``limit`` distinct brands per name: exact tokens count whole, words they are a prefix of PREFIX_WEIGHT.

    shared holds the SHOWN rarest tokens that the name has itself, without those grown from a prefix.
    """
    own = names.select(key, F.explode(F.array_distinct(tokens)).alias("word")).filter(F.length("word") >= ANCHOR_LENGTH)
    known = post.select("token").distinct()
    heads = known.select("token", F.explode(F.expr(f"transform(sequence({PREFIX_SHORT}, greatest(least(length(token), {PREFIX_LONG}), {PREFIX_SHORT})), n -> substring(token, 1, n))")).alias("head")).filter(F.length("token") >= PREFIX_SHORT)
    asked = own.filter(F.length("word") >= PREFIX_SHORT).withColumn("head", F.col("word").substr(1, PREFIX_LONG))
    grown = asked.join(heads, "head").filter(F.col("token").startswith(F.col("word")) & (F.col("token") != F.col("word"))).select(key, "token", F.lit(PREFIX_WEIGHT).alias("w"))
    both = own.select(key, F.col("word").alias("token"), F.lit(1.0).alias("w")).unionByName(grown).groupBy(key, "token").agg(F.max("w").alias("w"))
    exact = F.collect_list(F.when(F.col("w") == 1.0, F.struct((-F.col("idf")).alias("common"), "token")))
    scored = both.join(post, "token").groupBy(key, "row").agg(F.sum(F.col("idf") * F.col("w")).alias("score"), F.slice(F.array_sort(exact), 1, SHOWN)["token"].alias("shared"))
    named = scored.join(details, "row")
    once = Window.partitionBy(key, *brand).orderBy(F.col("score").desc(), "row")
    ranked = Window.partitionBy(key).orderBy(F.col("score").desc(), "row")
    firsts = named.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return firsts.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= limit)


def enrich(rows: DataFrame, ordinal: str, verdicts: DataFrame, post: DataFrame, details: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds brand_group, brand_winery, brand_label and brand_match.

    A reviewed verdict (key, brand 'group | winery | label' or NULL, confidence)
    wins; otherwise the index decides on the first row that carries a key. columns
    names the name, producer, tag and label texts of rows.
    """
    keyed = rows.withColumn("_key", name_key(F.col(columns["name"])))
    texts = F.struct(*[F.col(c).alias(k) for k, c in columns.items()])
    firsts = keyed.groupBy("_key").agg(F.min_by(texts, F.col(ordinal)).alias("t"))
    open_keys = firsts.join(verdicts.select(F.col("key").alias("_key")), "_key", "left_anti")
    t = lambda k: F.col(f"t.{k}")
    auto = match_cascade(open_keys, "_key", [[t("name")], [t("name"), t("producer")], [t("name"), t("producer"), t("tag"), t("label")]], post)
    auto = auto.join(details, "row").select("_key", F.array("group", "winery", "label").alias("parts"), F.lit("auto").alias("how"))
    split = F.transform(F.split("brand", r"\|"), lambda p: F.btrim(p))
    reviewed = verdicts.select(F.col("key").alias("_key"), split.alias("parts"), F.when(F.col("brand").isNull(), "reviewed:none").otherwise(F.concat(F.lit("reviewed:"), "confidence")).alias("how"))
    part = lambda i: F.coalesce(F.get("parts", F.lit(i)), F.lit(""))
    return (
        keyed.join(reviewed.unionByName(auto), "_key", "left")
        .withColumn("brand_group", part(0)).withColumn("brand_winery", part(1)).withColumn("brand_label", part(2))
        .withColumn("brand_match", F.coalesce("how", F.lit("none")))
        .drop("_key", "parts", "how")
    )


def match_counts(enriched: DataFrame) -> DataFrame:
    """One row: rows whose brand comes from a review, from the index, or from neither."""
    none = (F.col("brand_match") == "none") | F.col("brand_match").startswith("reviewed:none")
    reviewed = ~none & F.col("brand_match").startswith("reviewed")
    n = lambda c: F.count(F.when(c, 1))
    return enriched.agg(n(reviewed).alias("reviewed"), n(~none & ~reviewed).alias("auto"), n(none).alias("none"))
