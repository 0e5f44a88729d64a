"""Link-don't-delete de-duplication: the most informative row of a key leads, the others point at it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = {"high": 2, "medium": 1, "low": 0}


def informativeness(price: Column, confidence: Column, volume: Column, vintage: Column, tag: Column, name: Column) -> list[Column]:
    """Sort keys, the most telling first."""
    rank = F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(0))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return [price.isNotNull().desc(), rank.desc(), volume.isNotNull().desc(), vintage.isNotNull().desc(), size(tag).desc(), size(name).desc()]


def _runs(rows: DataFrame) -> DataFrame:
    """(_p, _key, _m0, _no, _before) for the run of each key in each partition of rows in global order (_p, _m: partition and place).

    _no numbers the keys from 1, _before is how many rows of the key stand in the partitions before. Only
    runs are counted, so no task sees all rows of a key, or all keys.
    """
    runs = rows.groupBy("_p", "_key").agg(F.min("_m").alias("_m0"), F.count("*").alias("_c"))
    earlier = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    runs = runs.withColumn("_new", (F.col("_before") == 0).cast("long"))
    counts = runs.groupBy("_p").agg(F.sum("_new").alias("_c"))  # a row per partition
    ahead = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.sum("_new").over(Window.partitionBy("_p").orderBy("_m0").rowsBetween(Window.unboundedPreceding, 0))
    offsets = F.broadcast(counts.select("_p", ahead.alias("_ahead")))
    # a run that goes on from an earlier partition is the first of its own, and the last key numbered there
    return runs.withColumn("_here", here).join(offsets, "_p").select("_p", "_key", "_m0", "_before", (F.col("_here") + F.col("_ahead")).alias("_no"))


def deduplicate(df: DataFrame, key: Column, order: list[Column], ordinal: Column, price: str, prefix: str = "W") -> DataFrame:
    """Adds row_id, duplicate_of and price_conflict (sorted distinct prices of the key, on its first row, if over one).

    order ranks the rows of a key; ordinal, unique, settles ties. Rows are dealt out by ranges of (key, order,
    ordinal), evaluated once, so that a hot key is spread over several tasks; ranks and numbers follow from the counts of the runs before.
    """
    keyed = df.withColumn("_key", key).withColumn("_ord", ordinal)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("_key").asc(), *order, F.col("_ord").asc()]
    dealt = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = dealt.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")).persist(StorageLevel.DISK_ONLY)
    prices = rows.groupBy("_key").agg(F.array_sort(F.collect_set(price)).alias("_prices")).filter(F.size("_prices") > 1)
    runs = _runs(rows).join(prices, "_key", "left")
    first = F.concat(F.lit(prefix), F.when(F.col("_no") < 10**5, F.lpad(F.col("_no").cast("string"), 5, "0")).otherwise(F.col("_no").cast("string")))
    rank = F.col("_m") - F.col("_m0") + F.col("_before")
    return (
        rows.join(runs, ["_p", "_key"])
        .withColumn("row_id", F.when(rank == 0, first).otherwise(F.concat(first, F.lit("d"), rank.cast("string"))))
        .withColumn("duplicate_of", F.when(rank > 0, first))
        .withColumn("price_conflict", F.when(rank == 0, F.col("_prices")))
        .drop("_key", "_ord", "_p", "_m", "_m0", "_before", "_no", "_prices")
    )


def conflict_reason(prices: Column) -> Column:
    return F.concat(F.lit("price disagrees across sightings (["), F.array_join(F.transform(prices, lambda p: p.cast("string")), ", "), F.lit("])"))
