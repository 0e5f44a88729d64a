"""Operator 10 - benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A document leaks an item if one of its windows, as many words long as the item (or the whole
of a shorter text), has a weighted shingle similarity of ``THRESHOLD`` or more with it. Shingles are five
lower-cased words; a shingle weighs its count times its characters; similarity
is the weighted Jaccard of the two shingle bags. All windows inside the text are
judged, those at its edges included.

1. *Windows.* A similar window consists of shingles of items for the most part: their weight reaches THRESHOLD
   times that of the lightest item of this length. Shingles of texts are looked up in the set of
   all items' shingles, and only windows that reach this bound, which is exact,
   get a fingerprint. Which item a window is like is not known yet.
2. *Fingerprints.* The 192-bit SimHash of a window's weighted shingles, summed
   bit by bit in one aggregation. Equal windows are fingerprinted once.
3. *Multi-index.* Each of the three longs of a fingerprint is cut into five blocks of 12 or 13 bits.
   Two fingerprints that differ in no more than ``RADIUS`` bits differ in at most ``NEAR`` bits in one of the 15 blocks at least, by
   the pigeonhole principle. The items, the small side, are entered under all values that are so near
   theirs (79 or 92 a block); an equi-join on (length, block, value) then finds every pair within the radius. Each
   pair is taken at its first such block only.
4. *Verification.* The exact similarity of the candidates' shingle bags.

The radius loses what SimHash itself loses: at a similarity of 0.8 two fingerprints differ
in 29 bits on average with a standard deviation of 5, so about 1 pair in 1,000 at the very threshold lies beyond
44 bits, and none to speak of from 0.85 on. README has the measured share, and that of unrelated pairs which blocks and radius let through.

Built-in expressions and joins only. The benchmark side of both joins is
broadcast only while its counted rows stay within ``BROADCAST_ROWS`` and ``BROADCAST_ITEMS``;
otherwise both sides are shuffled, and adaptive execution splits hot shingles. Texts
without a window to look at are left out before texts are shuffled, by a test on at most ID_BUCKETS broadcast rows.

Defined cases: items with fewer than five words have no shingle and are never
found; NULL texts contain nothing; a text shorter than the item is one window; rows are known by doc_id and text, so
repeated rows give one result; a NULL doc_id is reported as NULL; equal items are all
reported; of equally similar windows the first is; very long texts are searched whole; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table, words_of

SHINGLE = 5
THRESHOLD = 0.8
#: Longs of a fingerprint, and the bits of the blocks of each.
LONGS = 3
BLOCKS = (13, 13, 13, 13, 12)
#: Bits in which an item may differ from an entry of its block.
NEAR = 2
#: Every pair within so many bits is found: with one bit more, each block could differ in NEAR + 1 bits.
RADIUS = LONGS * len(BLOCKS) * (NEAR + 1) - 1
#: Counted shingles of items up to which they are broadcast, and counted items up to which their block entries are (1,341 rows each).
BROADCAST_ROWS, BROADCAST_ITEMS = 500_000, 30
ID_BUCKETS = 1 << 20


def _shingles(words: str) -> Column:
    """Array of the shingles of an array of words, as strings, in order."""
    ahead = ", ".join(f"get({words}, i + {k})" for k in range(SHINGLE))
    return F.expr(f"CASE WHEN size({words}) >= {SHINGLE} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> concat_ws(' ', {ahead})) ELSE cast(array() AS ARRAY<STRING>) END")


def _shingle_hashes(words: str) -> Column:
    ahead = ", ".join(f"get({words}, i + {k})" for k in range(SHINGLE))
    return F.expr(f"CASE WHEN size({words}) >= {SHINGLE} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({ahead})) ELSE cast(array() AS ARRAY<BIGINT>) END")


def fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``windows`` (keys, ws: words) with fp, the SimHash of their weighted shingles as an array of LONGS longs, keys being unique."""
    each = windows.select(*keys, F.explode(_shingles("ws")).alias("s"))
    hashes = F.array(*[F.struct(F.lit(k).alias("_k"), F.xxhash64(F.lit(k), "s").alias("h")) for k in range(LONGS)])
    each = each.select(*keys, F.length("s").alias("w"), F.explode(hashes).alias("x")).select(*keys, "w", "x._k", "x.h")
    bit = lambda i: F.sum(F.when(F.shiftright("h", i).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w")))
    sums = each.groupBy(*keys, "_k").agg(*[bit(i).alias(f"b{i}") for i in range(64)])
    total = F.lit(0).cast("long")
    for i in range(64):
        total = total.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    longs = sums.select(*keys, "_k", total.alias("v"))
    parts = [F.max(F.when(F.col("_k") == k, F.col("v"))) for k in range(LONGS)]
    return longs.groupBy(*keys).agg(F.array(*parts).alias("fp"))


def _blocks() -> list[tuple[int, int, int]]:
    """(long, first bit, bits) of every block."""
    return [(k, sum(BLOCKS[:i]), BLOCKS[i]) for k in range(LONGS) for i in range(len(BLOCKS))]


def _block(fp: str, at: tuple[int, int, int]) -> str:
    return f"(shiftrightunsigned({fp}[{at[0]}], {at[1]}) & {(1 << at[2]) - 1}L)"


def _by_blocks(df: DataFrame, fp: str) -> DataFrame:
    rows = ", ".join(f"named_struct('block', {i}, 'value', {_block(fp, at)}, 'bits', {at[2]})" for i, at in enumerate(_blocks()))
    return df.withColumn("_b", F.explode(F.expr(f"array({rows})"))).select(*df.columns, "_b.block", "_b.value", "_b.bits")


def block_entries(items: DataFrame) -> DataFrame:
    """items(item_fp, ...) under every (block, value) that differs from theirs in at most NEAR bits."""
    flips = [f for f in range(1 << max(BLOCKS)) if f.bit_count() <= NEAR]
    near = F.expr(f"transform(filter(array({', '.join(f'{f}L' for f in flips)}), f -> f < shiftleft(1L, bits)), f -> value ^ f)")
    rows = _by_blocks(items, "item_fp")
    return rows.withColumn("_v", F.explode(near)).select(*items.columns, "block", F.col("_v").alias("value"))


def within_radius(windows: DataFrame, items: DataFrame, small: bool = True) -> DataFrame:
    """Pairs of windows(fp, len, ...) and items(item_fp, len, ...) of equal length within RADIUS, each once."""
    entries = block_entries(items)
    pairs = _by_blocks(windows, "fp").drop("bits").join(F.broadcast(entries) if small else entries, ["len", "block", "value"])
    differ = " + ".join(f"bit_count(fp[{k}] ^ item_fp[{k}])" for k in range(LONGS))
    first = ", ".join(f"CASE WHEN bit_count({_block('fp', at)} ^ {_block('item_fp', at)}) <= {NEAR} THEN {i} END" for i, at in enumerate(_blocks()))
    return pairs.filter(F.expr(f"{differ} <= {RADIUS}") & (F.expr(f"coalesce({first})") == F.col("block"))).drop("block", "value")


def _similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two shingle arrays; linear for equal ones."""
    count = lambda arr: f"size(filter({arr}, y -> y = x))"
    fold = lambda op: f"aggregate(array_distinct(concat({a}, {b})), 0L, (acc, x) -> acc + length(x) * {op}({count(a)}, {count(b)}))"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1.0D ELSE cast({fold('least')} AS DOUBLE) / {fold('greatest')} END")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, iw (words), len, ik (key) and weight of the items that have a shingle."""
    return (
        benchmark.select("item_id", words_of(F.lower("text")).alias("iw"))
        .filter(F.size("iw") >= SHINGLE)
        .select("item_id", "iw", F.size("iw").alias("len"), F.xxhash64("item_id", "iw").alias("ik"), _shingles("iw").alias("_s"))
        .select("item_id", "iw", "len", "ik", F.expr("aggregate(_s, 0L, (acc, x) -> acc + length(x))").alias("weight"))
    )


def windows_to_judge(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, bool]:
    """(doc_id, tk, len, starts) of all windows that can be similar to an item, and whether the items' shingles are few."""
    shingles = items.select("len", F.explode(F.arrays_zip(_shingle_hashes("iw").alias("h"), _shingles("iw").alias("s"))).alias("x"))
    places = shingles.select("len", F.col("x.h").alias("h"), F.length("x.s").alias("w")).groupBy("len", "h").agg(F.max("w").alias("w"))
    small = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    places = F.broadcast(places) if small else places
    least = F.broadcast(items.groupBy("len").agg((F.min("weight") * F.lit(threshold)).alias("least")))  # a row per length of an item
    spread = docs.select("doc_id", F.xxhash64("text").alias("tk"), words_of(F.lower("text")).alias("_w")).select(
        "doc_id", "tk", F.size("_w").alias("n"), F.posexplode(_shingle_hashes("_w")).alias("p", "h")
    )
    # a row per text and length, if all its shingles of items reach the weight together; at most the places of one text in it
    held = (
        spread.join(places, "h").groupBy("doc_id", "tk", "n", "len")
        .agg(F.sum("w").alias("held"), F.collect_set(F.struct("p", "w")).alias("at"))
        .join(least, "len").filter("held >= least - 1e-6")
    )
    last = "greatest(0, n - len)"
    every = f"sequence(greatest(0, least(x.p - least(n, len) + {SHINGLE}, {last})), least(x.p, {last}))"
    starts = (
        held.select("doc_id", "tk", "n", "len", "least", F.explode("at").alias("x"))
        .select("doc_id", "tk", "len", "least", "x.w", F.explode(F.expr(every)).alias("start"))
        .groupBy("doc_id", "tk", "len", "start").agg(F.sum("w").alias("held"), F.first("least").alias("least"))
        .filter("held >= least - 1e-6")
    )
    return starts.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "len")).alias("at")), small


def _leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tk (hash of the text), item_id, start, n_words, similarity of every window that leaks an item."""
    items = _items(benchmark)
    found, small = windows_to_judge(docs, items, threshold)
    found = keep(found)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    bucket = F.pmod(F.col("tk"), F.lit(ID_BUCKETS)).alias("_b")
    coarse = keyed.withColumn("_b", bucket).join(F.broadcast(found.select(bucket).distinct()), "_b", "left_semi")
    hit = coarse.join(found, coarse["doc_id"].eqNullSafe(found["doc_id"]) & (coarse["tk"] == found["tk"])).select(coarse["doc_id"], coarse["tk"], "text", "at")
    cut = "transform(at, a -> named_struct('start', a.start, 'len', a.len, 'ws', slice(_w, a.start + 1, a.len)))"
    windows = (
        hit.select("doc_id", "tk", words_of(F.lower("text")).alias("_w"), "at")
        .select("doc_id", "tk", F.explode(F.expr(cut)).alias("a"))
        .select("doc_id", "tk", "a.start", "a.len", "a.ws", F.xxhash64("a.ws").alias("wk"), F.xxhash64(F.lit(1), "a.ws").alias("wk2"))
    )
    windows = keep(windows)
    # equal windows of different documents are fingerprinted and verified once
    texts = windows.select("len", "wk", "wk2", "ws").dropDuplicates(["len", "wk", "wk2"])
    prints = fingerprints(texts, ["len", "wk", "wk2"])
    item_prints = fingerprints(items.select("ik", "len", F.col("iw").alias("ws")).dropDuplicates(["ik"]), ["ik", "len"]).withColumnRenamed("fp", "item_fp")
    few = items.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    near = within_radius(prints, item_prints, few).select("len", "wk", "wk2", "ik")
    sides = near.join(texts, ["len", "wk", "wk2"]).join(items.select("ik", "item_id", "iw"), "ik")
    verified = (
        sides.withColumn("sa", _shingles("ws")).withColumn("sb", _shingles("iw")).withColumn("_part", F.spark_partition_id())
        .withColumn("similarity", _similarity("sa", "sb"))
        .filter((F.col("similarity") >= threshold) & (F.col("_part") >= 0))  # not pushed down into the lambdas
        .select("len", "wk", "wk2", "item_id", "similarity")
    )
    return windows.select("doc_id", "tk", "start", "len", "wk", "wk2", F.size("ws").alias("n_words")).join(verified, ["len", "wk", "wk2"]).select("doc_id", "tk", "item_id", "start", "n_words", "similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: per document and item the best window, the first of equals."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("m")
    return (
        _leaking(docs, benchmark, threshold)
        .groupBy("doc_id", "item_id").agg(best)
        .select("doc_id", "item_id", (-F.col("m.back")).alias("start_word"), F.col("m.n_words").alias("n_words"), F.col("m.similarity").alias("similarity"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that leak no item; rows are judged by doc_id and text, those without a doc_id as well."""
    bad = _leaking(docs, benchmark, **settings).select(F.col("doc_id").alias("_bad"), F.col("tk").alias("_bad_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All windows of an item's length that share a shingle with it (the others have a similarity of 0), one by one.
ORACLE_SQL = r"""
WITH it AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS iw FROM benchmark),
i AS (SELECT item_id, iw, len(iw) AS n FROM it WHERE len(iw) >= 5),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS dw FROM documents WHERE text IS NOT NULL),
ish AS (SELECT item_id, n, q, array_to_string(iw[q + 1:q + 5], ' ') AS s FROM (SELECT *, unnest(range(0, n - 4)) AS q FROM i)),
dsh AS (SELECT doc_id, md5(array_to_string(dw, ' ')) AS dk, len(dw) AS dn, p, array_to_string(dw[p + 1:p + 5], ' ') AS s
        FROM (SELECT *, unnest(range(0, len(dw) - 4)) AS p FROM d)),
h AS (SELECT DISTINCT doc_id, dk, dn, item_id, n, p FROM dsh JOIN ish USING (s)),
w AS (SELECT DISTINCT doc_id, dk, item_id, least(n, dn) AS m, unnest(range(greatest(0, least(p - least(n, dn) + 5, dn - n)), least(p, greatest(0, dn - n)) + 1)) AS st FROM h),
a AS (SELECT w.doc_id, w.dk, w.item_id, w.m, w.st, dsh.s, count(*) AS c FROM w JOIN dsh
        ON w.doc_id IS NOT DISTINCT FROM dsh.doc_id AND w.dk = dsh.dk AND dsh.p BETWEEN w.st AND w.st + w.m - 5 GROUP BY ALL),
b AS (SELECT w.doc_id, w.dk, w.item_id, w.m, w.st, ish.s, count(*) AS c FROM w JOIN ish USING (item_id) GROUP BY ALL),
sim AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.st, b.st) AS st, coalesce(a.m, b.m) AS m,
               sum(length(coalesce(a.s, b.s)) * least(coalesce(a.c, 0), coalesce(b.c, 0)))::DOUBLE
               / sum(length(coalesce(a.s, b.s)) * greatest(coalesce(a.c, 0), coalesce(b.c, 0))) AS similarity
        FROM a FULL JOIN b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.dk = b.dk AND a.item_id = b.item_id AND a.st = b.st AND a.s = b.s
        GROUP BY coalesce(a.doc_id, b.doc_id), coalesce(a.dk, b.dk), coalesce(a.item_id, b.item_id), coalesce(a.st, b.st), coalesce(a.m, b.m)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st) AS r FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, st::INTEGER AS start_word, m::INTEGER AS n_words, similarity FROM k WHERE r = 1"""
