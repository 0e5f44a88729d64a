"""Operator 1 - near-duplicates by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles (one shingle of all its
words if it has fewer). A shingle weighs 1 + ln(its count), times the mean IDF of its words:

    idf(word) = 1 + ln((1 + N) / (1 + df)) / ln(1 + N)

the usual smoothed IDF, scaled to [1, 2] so that it does not depend on the size of the corpus. df is
counted over all documents in ``DF_BUCKETS`` buckets of word hashes, so
the table that travels to the workers has a fixed size. A bucket's df is that
of its words together: frequent words rule theirs, and among rare words the
logarithm hardly tells them apart, however large the vocabulary.

1. *Signatures*: ``BANDS * ROWS`` weighted samples per document. A shingle's
   random draws belong to its own hash: r, beta and c come from three rows, picked by 39 bits of the hash, of tables
   made from the seed. A sample is the least ln a, whose bits identify shingle and level.
2. *Exact classes*: documents with the same words (128-bit hash) form one class,
   represented by its least doc_id; only representatives go on.
3. *Star*: in each band bucket every member is paired with its centre. A pair
   whose total weights differ too much for 0.8 is dropped (exact), and so is one
   that agrees in less than ``LOOSE`` of its samples (a pair of similarity 0.8 does
   with a probability of about 1e-5). The others are verified by exact weighted
   Jaccard similarity of the whole texts, and connected components are formed.
4. *Rest*: members of one bucket that are still in different components are
   paired as well and verified, so no link between different texts that share a
   bucket is lost. Only the members outside a bucket's largest component look for partners, and bounds that
   each member can be held against by itself go before the join, so that
   copies of a template are never paired with each other, whatever stray text shares their bucket.

At 24 bands of 6 rows a pair of similarity 0.8 shares a bucket with probability
0.9993, one of 0.85 with 0.99999, one of 0.3 with 0.017. Components come from
label propagation with pointer jumping over written tables; nothing per
document reaches the driver.

Defined cases: documents without words (NULL, empty, white space) and those with
a NULL doc_id are in no group - their class is their own doc_id; repeated
rows and equal texts share a class; one doc_id with several texts is one node;
an empty table gives no rows; very long texts are sampled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import materialize, slim_batches, table, tidy

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
DF_BUCKETS = 1 << 18
#: Buckets of doc_ids, the bound of a broadcast (8 bytes a row).
ID_BUCKETS = 1 << 20
#: Share of equal samples below which a pair is not looked at; over 4 standard deviations under 0.8.
LOOSE = 0.66
DRAWS = 1 << 13
SEED = 20240229
#: Text parsed at once: shingles take some forty bytes for each byte of it.
PART_BYTES = 1 << 20
#: Enough samples of sa and sb agree.
ALIKE = f"size(filter(zip_with(sa, sb, (x, y) -> x = y), z -> z)) >= {LOOSE} * size(sa)"
#: Parts that the rows of one label are dealt out to.
SALTS = 32
_tables: dict = {}


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF by word bucket; the driver gets one row per non-empty bucket, DF_BUCKETS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DF_BUCKETS, np.int64)
        n = 0
        for b in batches:
            for _, _, buf, offsets in textvec.parts(b.column("text"), PART_BYTES):
                words = textvec.words_of_part(buf, offsets)
                doc = np.repeat(np.arange(len(words.n_words)), words.n_words)
                own = np.unique(doc.astype(np.uint64) << np.uint64(18) | words.hash & np.uint64(DF_BUCKETS - 1))
                df += np.bincount((own & np.uint64(DF_BUCKETS - 1)).astype(np.int64), minlength=DF_BUCKETS)
                n += int((words.n_words > 0).sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], n))], names=["bucket", "df"])

    counts = docs.select("text").mapInArrow(tidy(run), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    found = counts.toArrow().to_pydict()
    df = np.zeros(DF_BUCKETS + 1, np.int64)
    df[np.array(found["bucket"], np.int64)] = found["df"]  # bucket -1, the last, holds N
    n = df[-1]
    return (1 + (np.log((1 + n) / (1 + df[:-1])) / max(np.log(1.0 + n), 1.0)).clip(0, 1)).astype(np.float32)


def _draws(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r, beta and ln c for improved consistent weighted sampling; a shingle has a row of its own in each."""
    if samples not in _tables:
        rng = np.random.default_rng(SEED)
        r = rng.gamma(2, 1, (DRAWS, samples)).astype(np.float32)
        c = np.log(rng.gamma(2, 1, (DRAWS, samples))).astype(np.float32)
        _tables[samples] = r, rng.random((DRAWS, samples), np.float32), c
    return _tables[samples]


def shingles(words: textvec.Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document bounds, hashes ascending in each document, weights) of the weighted shingle sets."""
    starts, doc = words.windows(SHINGLE)
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < SHINGLE))
    ends = np.concatenate([starts + SHINGLE, words.first[short] + words.n_words[short]])
    starts, doc = np.concatenate([starts, words.first[short]]), np.concatenate([doc, short])
    h = words.range_hash(starts, ends)
    total = np.concatenate([[0.0], np.cumsum(idf[(words.hash & np.uint64(DF_BUCKETS - 1)).astype(np.int64)], dtype=np.float64)])
    # rounded, as the mean is a difference of running sums
    mean = np.round((total[ends] - total[starts]) / (ends - starts), 5)
    order = np.lexsort((h, doc))
    h, doc, mean = h[order], doc[order], mean[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    return np.searchsorted(doc[at], np.arange(len(words.n_words) + 1)), h[at], mean[at] * (1 + np.log(count))


def sample(h: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """The ln a of every sample, as bits."""
    r, beta, c = _draws(samples)
    best = np.full(samples, np.inf, np.float32)
    row_r, row_beta, row_c = ((h >> np.uint64(k) & np.uint64(DRAWS - 1)).astype(np.int64) for k in (20, 33, 46))
    ln = np.log(weight).astype(np.float32)[:, None]
    for i in range(0, len(h), 512):  # stays in the cache of a core
        ri, bi = r[row_r[i : i + 512]], beta[row_beta[i : i + 512]]
        t = ln[i : i + 512] / ri
        t += bi
        np.floor(t, out=t)
        t -= bi
        t += 1
        t *= ri
        np.minimum(best, (c[row_c[i : i + 512]] - t).min(axis=0), out=best)
    return best.view(np.uint32)


def signatures(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h1, h2 (the words' hash) and band keys, for documents with words and a doc_id."""
    kept = docs.sparkSession.sparkContext.broadcast(idf)  # DF_BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in textvec.parts(b.column("text"), PART_BYTES):
                words = textvec.words_of_part(buf, offsets, double=True)
                bounds, h, weight = shingles(words, kept.value)
                full = np.flatnonzero(words.n_words > 0)
                if not len(full):
                    continue
                sig = np.stack([sample(h[bounds[d] : bounds[d + 1]], weight[bounds[d] : bounds[d + 1]], bands * rows) for d in full])
                keys = np.full((len(full), bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for i in range(rows):
                    keys = textvec.mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(-1, bands, rows)[:, :, i])
                at, to = words.first[:-1][full], words.first[1:][full]
                lists = _lists(textvec.signed(keys.reshape(-1)), bands)
                short = _lists(((sig ^ sig >> 16) & 0xFFFF).astype(np.uint16).view(np.int16).reshape(-1), bands * rows)
                mass = np.array([weight[bounds[d] : bounds[d + 1]].sum() for d in full])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo).take(pa.array(full)), *(pa.array(textvec.signed(words.range_hash(at, to, w))) for w in (0, 1)), lists, short, pa.array(mass)],
                    names=["doc_id", "h1", "h2", "bands", "samples", "mass"],
                )

    schema = "doc_id long, h1 long, h2 long, bands array<long>, samples array<smallint>, mass double"
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(tidy(run), schema)


def _lists(flat: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of which enough samples agree."""
    one = classes.select(F.col("rep").alias("a"), F.col("samples").alias("sa"))
    two = classes.select(F.col("rep").alias("b"), F.col("samples").alias("sb"))
    return pairs.join(one, "a").join(two, "b").filter(ALIKE).select("a", "b")


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    same = h2[at] == h1
    both = np.minimum(w1[same], w2[at[same]]).sum()
    return float(both / (w1.sum() + w2.sum() - both))


def measure(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = 0.0) -> DataFrame:
    """a, b, similarity of the whole texts, inner (weight they share) and excess, for pairs of at least so similar texts.

    excess: hashes of the shingles of b that weigh more in b than in a. texts has one row per doc_id.
    """
    kept = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            similar, inner, excess = np.zeros(len(b)), np.zeros(len(b)), []
            # a document that stands in many pairs of the batch is parsed once
            sides = [b.column(c).dictionary_encode() if c in "ab" else b.column(c) for c in ("a", "b", "text_a", "text_b")]
            sets: dict = {}
            for ids, text in ((sides[0], sides[2]), (sides[1], sides[3])):
                values = ids.dictionary.to_pylist()
                codes = ids.indices.to_numpy()
                _, first = np.unique(codes, return_index=True)
                new = [i for i in first.tolist() if values[codes[i]] not in sets]
                if new:
                    own = text.take(pa.array(new))
                    for lo, hi, buf, offsets in textvec.parts(own, PART_BYTES):
                        bounds, h, w = shingles(textvec.words_of_part(buf, offsets), kept.value)
                        for i in range(lo, hi):
                            sets[values[codes[new[i]]]] = h[bounds[i - lo] : bounds[i - lo + 1]], w[bounds[i - lo] : bounds[i - lo + 1]]
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)):
                (hx, wx), (hy, wy) = sets[x], sets[y]
                at = np.minimum(np.searchsorted(hx, hy), len(hx) - 1)
                base = np.where(hx[at] == hy, wx[at], 0.0)
                inner[i] = np.minimum(base, wy).sum()
                similar[i] = inner[i] / (wx.sum() + wy.sum() - inner[i])
                excess.append(textvec.signed(hy[wy > base + 1e-9]) if similar[i] >= least else ())
            good = pa.array(np.flatnonzero(similar >= least))
            columns = [b.column("a"), b.column("b"), pa.array(similar), pa.array(inner), pa.array(excess, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.take(good) for c in columns], names=["a", "b", "similarity", "inner", "excess"])

    # a second: the pairs of one centre lie together, and its text is parsed once for many of them
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long, similarity double, inner double, excess array<long>")


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough."""
    return measure(pairs, texts, idf, threshold).select("a", "b", "similarity")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b)."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), name)
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        better = materialize(labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("next")), f"{name}-next")
        # pointer jumping: the label's own label, asked for once per label; a giant component shares one, so its rows are salted
        asked = better.select("next").distinct()
        own = better.select(F.col("node").alias("j"), F.col("next").alias("far")).filter("far < j")
        jump = asked.join(own, F.col("next") == F.col("j")).select("next", "far", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        moved = better.select("node", "label", "next", salt("node")).join(jump, ["next", "salt"], "left")
        moved = materialize(moved.select("node", F.least("next", "far").alias("label"), F.col("label").alias("was")), name)
        labels = moved.select("node", "label")
        if moved.filter("label <> was").isEmpty():
            return labels


def _rest(buckets: DataFrame, spokes: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that can still be similar.

    A pair has a member outside the largest component of its bucket, and only such members look for partners.

    Copies of one template are all near its centre and differ from it by edits
    of their own. What two of them share is what they share within the centre, at most
    the lesser of their weights shared with it, and what they share beyond it. A
    pair without common excess shingles therefore has to have that lesser
    weight at threshold / (1 + threshold) of both weights, hence the lighter of the two at twice that share of its own
    weight, and the heavier, which weighs at most 1 / threshold as much, at threshold times its own. These bounds are exact
    and looked at row by row, before the join. Pairs with a
    common excess shingle are found by an equi-join on it.
    """
    part = threshold / (1 + threshold)
    named = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_keys = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("most.label").alias("big"))
    own = spokes.select(F.col("a").alias("head"), F.col("b").alias("rep"), "inner")
    apart = named.join(open_keys, "key").join(nodes, "rep").join(own, ["head", "rep"], "left")
    apart = materialize(apart.withColumn("inner", F.when(F.col("head") == F.col("rep"), F.col("mass")).otherwise(F.col("inner"))), "apart")

    def meet(left: DataFrame, right: DataFrame, on: list[str], light_first: bool | None, extra: str = "true") -> DataFrame:
        """Pairs of different labels whose weights agree; light_first says which side is the lighter, None either."""
        names = [c for c in left.columns if c not in on]
        x = left.select(*on, *[F.col(c).alias(c + "1") for c in names])
        y = right.select(*on, *[F.col(c).alias(c + "2") for c in names])
        lighter = "" if light_first is None else f"AND (mass1, rep1) {'<' if light_first else '>'} (mass2, rep2)"
        fits = f"label1 <> label2 AND least(mass1, mass2) >= {threshold - 1e-6} * greatest(mass1, mass2) {lighter} AND {extra}"
        return x.join(y, on).filter(fits).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b"))

    alike = ALIKE.replace("sa", "samples1").replace("sb", "samples2")
    rows = apart.select("key", "rep", "label", "big", "mass", "samples", "inner")
    minor, known = rows.filter("label <> big"), rows.filter("inner IS NOT NULL")
    light, heavy = known.filter(f"inner >= {2 * part} * mass - 1e-6"), known.filter(f"inner >= {threshold} * mass - 1e-6")
    enough = f"{alike} AND least(inner1, inner2) >= {part} * (mass1 + mass2) - 1e-6"
    inside = [
        meet(light.filter("label <> big"), heavy, ["key"], True, enough),
        meet(heavy.filter("label <> big"), light, ["key"], False, enough),
        # members that were not measured against the centre have no bound
        meet(rows.filter("inner IS NULL"), minor, ["key"], None, alike),
        meet(rows.filter("inner IS NULL AND label <> big"), rows, ["key"], None, alike),
    ]
    # common excess: members of an open centre by shingle
    members = apart.filter("inner IS NOT NULL AND head <> rep").select("head", "rep", "label", "mass").distinct()
    spread = members.join(spokes.select(F.col("a").alias("head"), F.col("b").alias("rep"), F.explode("excess").alias("h")), ["head", "rep"])
    sizes = spread.groupBy("head", "h", "label").agg(F.count("*").alias("n"))
    met = sizes.groupBy("head", "h").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("k")).filter("k > 1").select("head", "h", F.col("most.label").alias("big"))
    spread = materialize(spread.join(met, ["head", "h"]), "excess")
    beyond = meet(spread.filter("label <> big"), spread, ["head", "h"], None).distinct()
    found = likely(beyond, nodes)
    for pairs in inside:
        found = found.unionByName(pairs)
    return found.distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its group), exact_of (the least with the same words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = document_frequencies(docs)
    sig = materialize(signatures(docs, idf, bands, rows), "signatures")
    heaviest = F.first(F.struct("bands", "samples", "mass")).alias("s")  # equal for equal words
    classes = materialize(sig.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), heaviest).select("h1", "h2", "rep", "s.*"), "classes")
    nodes = classes.dropDuplicates(["rep"]).select("rep", "samples")
    members = classes.select("rep", "mass", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("key", "n")
    shared = materialize(members.join(sizes, "key"), "shared")  # only buckets with two classes or more
    # the centre of a bucket is the member with the most company: what its copies were made from keeps the bands they share
    degrees = shared.groupBy("rep").agg(F.sum("n").alias("degree"))
    known = shared.join(degrees, "rep")
    heads = known.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"), "mass")).alias("h"))
    buckets = materialize(shared.join(heads.select("key", (-F.col("h.r")).alias("head"), F.col("h.mass").alias("head_mass")), "key"), "buckets")

    # similarity is at most the ratio of the total weights
    near = lambda x, y: F.least(x, y) >= (threshold - 1e-6) * F.greatest(x, y)
    star = buckets.filter(F.col("head") != F.col("rep")).filter(near(F.col("mass"), F.col("head_mass")))
    star = materialize(likely(star.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), nodes), "star")

    def texts_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
        # texts that are not asked for stay where they are: a coarse test on at most ID_BUCKETS broadcast rows goes before the join
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).alias("_b")
        coarse = docs.withColumn("_b", bucket).join(F.broadcast(needed.select(bucket).distinct()), "_b", "left_semi").drop("_b")
        return materialize(coarse.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    spokes = materialize(measure(star, texts_of(star), idf), "spokes")
    linked = spokes.filter(F.col("similarity") >= threshold).select("a", "b")
    labels = components(linked)
    seen = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(_rest(buckets, spokes, labels, nodes, threshold).join(seen, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = materialize(verify(rest, texts_of(rest), idf, threshold).select("a", "b"), "links")
        if not more.isEmpty():
            labels = components(linked.unionByName(more))
    exact = sig.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = exact.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("exact_of"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("exact_of", "doc_id").alias("exact_of"))


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id. Rows without a doc_id stay.

    Different texts of one doc_id are documents of their own, which all the steps see under numbers in the order of doc_ids.
    """
    pair = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_tk"))
    if not pair.groupBy("doc_id").agg(F.min("_tk").alias("a"), F.max("_tk").alias("b")).filter("a < b").isEmpty():
        # the number of a row rises with the sorted partition and the place in it
        numbers = materialize(pair.distinct().orderBy("doc_id", "_tk").withColumn("_node", F.monotonically_increasing_id()), "numbers")
        rows = docs.withColumn("_tk", F.xxhash64("text")).join(numbers, ["doc_id", "_tk"])
        rows = materialize(rows.select(F.col("_node").alias("doc_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "text"), "numbered")
        return representatives(rows, **settings).select("_row.*").unionByName(docs.filter("doc_id IS NULL"))
    groups = near_duplicates(docs, **settings)
    kept = materialize(groups.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # texts are streamed past the ids of their partition, neither sorted nor aggregated
    once = docs.join(kept.filter("n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    again = kept.filter("n > 1").select("doc_id")
    if not again.isEmpty():  # repeated rows of one text
        ordered = [F.col(c) for c in docs.columns if c != "doc_id"]
        rows = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*ordered)).alias("_r"))
        once = once.unionByName(rows.select("doc_id", "_r.*").select(*docs.columns))
    return once.unionByName(docs.filter("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
