"""Operator 8 - duplicated passages by relative Lempel-Ziv parsing.

A passage is ``SPAN`` consecutive words. Every document is parsed, greedily and
from left to right, into factors copied from documents of smaller doc_id and the
literal words between them. A factor of SPAN words or more is a duplicate span.

*Reference blocks.* The reference is the collection itself, cut into blocks that
fall alike in every copy of a passage: of the ``SEED``-word seeds inside each window
of SPAN words the one with the least hash is its anchor, and consecutive windows with
one anchor form a block - the words from its first window's start to its
last window's end. Blocks overlap by SPAN - 1 words, so each window lies in exactly
one. The index holds each distinct block once, by anchor and content hash, with its
first place (the least doc_id that has it); it is dealt out by hash, and every block of
every document is looked up in it, so each document meets all blocks of the reference.

*Block boundaries.* Where copies begin, end or were edited, blocks differ though some of
their windows agree; such blocks share their anchor. Distinct blocks of anchors with two or more
are therefore indexed window by window as well, once per distinct block, never per pair
of documents. What this finds at the first place of a block holds at every later place of it.

*Parse.* What the look-ups give are matches: so many words here equal those there. Matches
of one document that continue each other at the same place of the same
reference are one match (``join_matches``). The parse (``greedy``) then takes at each place the match
that reaches farthest as the next factor, or passes over literal words to the next match.

*Factor boundaries.* A factor starts where the one before it ended, which may be in the
middle of a match. Each factor is therefore followed back over its left boundary, and it is the
whole match that has to be SPAN words long. As every repeated window lies in a match,
the words so covered are exactly those of all repeated windows.

The result is exact but for hashes: two blocks or windows of one anchor that differ are taken for equal with
a probability of 2**-64. "Farthest" is among first places: a match that is longer only in a later document than the first is
told as two factors, which cover the same words. Hot passages are combined before each
shuffle (one row per task and block), and the look-up of blocks is a join
whose large partitions adaptive execution may split.

Defined cases: NULL and short texts lose nothing; equal doc_ids never
remove from each other, and documents with a NULL doc_id neither remove nor
lose words; repeated rows are all returned; an empty table works; very long texts are
parsed whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import materialize, slim_batches, table, tidy

SPAN = 50
SEED = 12

_BLOCKS = "doc_id long, text_key long, start int, n_windows int, anchor long, content long"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` consecutive values is, the first of equals."""
    least, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(least) - step
        later = least[step:] < least[:n]
        least, at, have = np.where(later, least[step:], least[:n]), np.where(later, at[step:], at[:n]), have + step
    return at


def blocks_of(words: textvec.Words, span: int, seed: int):
    """(document, first window, windows, anchor hash, content hash) of all blocks; words counted within the document."""
    seeds, _ = words.windows(seed)
    starts, doc = words.windows(span)
    if not len(starts):
        return None
    seed_hash = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    seed_hash[seeds] = words.range_hash(seeds, seeds + seed)
    best = _sliding_argmin(seed_hash, span - seed + 1)[starts]
    base = words.first[:-1][doc]
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    lo, hi = starts[at], starts[at] + count - 1 + span
    return doc[at], lo - base[at], count, seed_hash[best[at]], words.range_hash(lo, hi)


def _with_key(docs: DataFrame) -> DataFrame:
    """Rows are known by (doc_id, hash of the text), as doc_ids may repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def blocks(keyed: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("text_key")
            for lo, hi, buf, offsets in textvec.parts(b.column("text")):
                found = blocks_of(textvec.words_of_part(buf, offsets), span, seed)
                if found is None:
                    continue
                doc, start, count, anchor, content = found
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(take), keys.slice(lo, hi - lo).take(take), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                     pa.array(textvec.signed(anchor)), pa.array(textvec.signed(content))],
                    names=["doc_id", "text_key", "start", "n_windows", "anchor", "content"],
                )

    return keyed.filter("doc_id IS NOT NULL").select("doc_id", "text", "text_key").mapInArrow(tidy(run), _BLOCKS)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row bounds and flat columns of a list of structs; NULL lists are empty."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    fields = {f.name: v.to_numpy(zero_copy_only=False) for f, v in zip(values.type, values.flatten(), strict=True)}
    return np.append(0, np.cumsum(size)), fields


def _each(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, number) for all numbers first[i] .. first[i] + count[i] - 1."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _window_hashes(asked: DataFrame, span: int) -> DataFrame:
    """A row for each window of the asked blocks: base is the block's start, at the window's place in it, many whether the block stands elsewhere too."""
    out = "doc_id long, text_key long, base int, at int, many boolean, anchor long, window long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, asked = _flat(b.column("asked"))
            for lo, hi, buf, offsets in textvec.parts(b.column("text")):
                words = textvec.words_of_part(buf, offsets)
                row = np.repeat(np.arange(lo, hi), np.diff(bounds[lo : hi + 1]))
                own = {k: v[bounds[lo] : bounds[hi]] for k, v in asked.items()}
                which, at = _each(np.zeros(len(row), np.int64), own["n_windows"])
                lows = words.first[row - lo][which] + own["start"][which] + at
                take = pa.array(row[which])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(own["start"][which]), pa.array(at.astype(np.int32)),
                     pa.array(own["many"][which].astype(bool)), pa.array(own["anchor"][which]), pa.array(textvec.signed(words.range_hash(lows, lows + span)))],
                    names=["doc_id", "text_key", "base", "at", "many", "anchor", "window"],
                )

    return asked.mapInArrow(tidy(run), out)


def _runs(mask: str, start: str, span: int, ref_doc: str, ref_start: str) -> F.Column:
    """Matches for the runs of set bits in ``mask``: bit i stands for the window at start + i, equal to that at ref_start + i."""
    begins = f"filter(sequence(0, {span}), i -> {mask} >> i & 1 = 1 AND (i = 0 OR {mask} >> (i - 1) & 1 = 0))"
    until = f"aggregate(sequence(0, {span}), 0, (n, j) -> CASE WHEN n = j AND {mask} >> (i + j) & 1 = 1 THEN n + 1 ELSE n END)"
    one = f"named_struct('start', cast({start} + i AS INT), 'n_words', cast({until} + {span - 1} AS INT), 'ref_doc', {ref_doc}, 'ref_start', cast({ref_start} + i AS INT))"
    return F.expr(f"transform({begins}, i -> {one})")


def matches(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with text_key, matches): doc_id, text_key and start, n_words, ref_doc, ref_start.

    The n_words words from start on are those of a document of smaller doc_id, ref_doc, from ref_start on.
    """
    if span - seed + 1 > 62:
        raise ValueError("windows of a block are bits of a long")
    keyed = _with_key(docs)
    own = materialize(blocks(keyed, span, seed), "blocks")
    place = F.struct("doc_id", "text_key", "start")
    index = materialize(
        own.groupBy("anchor", "content").agg(F.min(place).alias("p"), F.first("n_windows").alias("n_windows"), F.count("*").alias("n")),
        "block-index",
    )
    mixed = index.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor")
    asked = (
        index.join(mixed, "anchor", "left_semi")
        .select(F.col("p.doc_id").alias("doc_id"), F.col("p.text_key").alias("text_key"), F.struct(F.col("p.start").alias("start"), "n_windows", (F.col("n") > 1).alias("many"), "anchor").alias("s"))
        .groupBy("doc_id", "text_key").agg(F.collect_list("s").alias("asked"))
    )  # at most the blocks of one document in a row
    texts = keyed.filter("doc_id IS NOT NULL")
    windows = materialize(_window_hashes(texts.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "asked"), span), "windows")
    first = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", (F.col("base") + F.col("at")).alias("start"))).alias("f"), F.max("doc_id").alias("last")).filter("f.doc_id < last")
    # written, so that the join below has an exchange on both sides and its hot windows can be split
    first = materialize(first.select("anchor", "window", F.col("f.doc_id").alias("ref_doc"), F.col("f.start").alias("ref_at")), "first-windows")
    # windows that continue each other in the same reference become bits of one row
    edges = (
        windows.join(first, ["anchor", "window"]).filter("ref_doc < doc_id")
        .groupBy("doc_id", "text_key", "base", "many", "ref_doc", (F.col("ref_at") - F.col("at")).alias("ref_start"))
        .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    )
    edges = materialize(edges, "edges")
    # what was found at the first place of a block, at most the windows of one block in a row
    resolved = edges.filter("many").groupBy("doc_id", "text_key", "base").agg(F.collect_list(F.struct("mask", "ref_doc", "ref_start")).alias("inside"))
    shared = index.filter("n > 1").select("anchor", "content", F.col("p.doc_id").alias("first_doc"), F.col("p.text_key").alias("first_key"), F.col("p.start").alias("first_start"))
    known = shared.join(
        resolved.select(F.col("doc_id").alias("first_doc"), F.col("text_key").alias("first_key"), F.col("base").alias("first_start"), "inside"),
        ["first_doc", "first_key", "first_start"],
        "left",
    )
    # a place in a larger document is a copy of the whole block, a later one in the first document is like the first place
    every = F.expr("named_struct('mask', shiftleft(1L, n_windows) - 1, 'ref_doc', first_doc, 'ref_start', first_start)")
    later = (F.col("first_key") != F.col("text_key")) | (F.col("first_start") != F.col("start"))
    copied = F.col("first_doc") < F.col("doc_id")
    places = (
        own.join(known, ["anchor", "content"])
        .filter(copied | ((F.col("first_doc") == F.col("doc_id")) & later & F.col("inside").isNotNull()))
        .select("doc_id", "text_key", "start", F.explode(F.when(copied, F.array(every)).otherwise(F.col("inside"))).alias("f"))
        .select("doc_id", "text_key", "start", "f.mask", "f.ref_doc", "f.ref_start")
    )
    found = places.unionByName(edges.select("doc_id", "text_key", F.col("base").alias("start"), "mask", "ref_doc", "ref_start"))
    return keyed, found.select("doc_id", "text_key", F.explode(_runs("mask", "start", span, "ref_doc", "ref_start")).alias("m"))


def join_matches(row: np.ndarray, start: np.ndarray, end: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray):
    """(row, start, end, ref_doc, ref_start) of matches after those that continue each other in one reference are joined; by row, start, ref_doc."""
    shift = ref_start - start
    order = np.lexsort((start, shift, ref_doc, row))
    row, start, end, ref_doc, shift = (x[order].astype(np.int64) for x in (row, start, end, ref_doc, shift))
    if not len(row):
        return row, start, end, ref_doc, shift
    other = np.ones(len(row), bool)
    other[1:] = (row[1:] != row[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (shift[1:] != shift[:-1])
    group = np.cumsum(other) - 1
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(group * far + end) - group * far  # farthest end so far in the group
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    row, start, end, ref_doc, shift = row[at], start[at], reach[last], ref_doc[at], shift[at]
    order = np.lexsort((ref_doc, start, row))
    return tuple(x[order] for x in (row, start, end, ref_doc, start + shift))


def greedy(start: list[int], end: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, match) of the factors of one document, left to right: at each place the match that reaches farthest, the first of equals. Matches by start."""
    out, at, k, best = [], 0, 0, -1
    while True:
        while k < len(start) and start[k] <= at:
            if best < 0 or end[k] > end[best]:
                best = k
            k += 1
        if best >= 0 and end[best] > at:
            out.append((at, end[best], best))
            at = end[best]
        elif k < len(start):
            at = start[k]  # literal words
        else:
            return out


def parse(lists: pa.ListArray, span: int):
    """(row, start, end, back, ref_doc, ref_start) of the long factors of documents, given their lists of matches.

    back is the start of the factor's match, at or before that of the factor.
    """
    bounds, m = _flat(lists)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    row, start, end, ref_doc, ref_start = join_matches(row, m["start"], m["start"] + m["n_words"], m["ref_doc"], m["ref_start"])
    cut = np.searchsorted(row, np.arange(len(bounds)))
    out = []
    for d in np.unique(row).tolist():
        lo, hi = cut[d], cut[d + 1]
        out += [(d, a, b, lo + k) for a, b, k in greedy(start[lo:hi].tolist(), end[lo:hi].tolist())]
    d, a, b, k = np.array(out, np.int64).reshape(-1, 4).T
    long = b - start[k] >= span  # followed back over its left boundary, the factor is a whole passage at least
    d, a, b, k = d[long], a[long], b[long], k[long]
    return d, a, b, start[k], ref_doc[k], ref_start[k] + a - start[k]


def _with_matches(docs: DataFrame, span: int, seed: int) -> DataFrame:
    """doc_id, text and matches (NULL if there are none) of every row."""
    keyed, found = matches(docs, span, seed)
    lists = found.groupBy("doc_id", "text_key").agg(F.collect_list("m").alias("matches"))  # a few per block of one document
    return keyed.join(lists, ["doc_id", "text_key"], "left").select("doc_id", "text", "matches")


def factors(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """The long factors of every document: doc_id, start, n_words, back (words to the left that its match holds as well), ref_doc, ref_start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, a, e, back, ref_doc, ref_start = parse(b.column("matches"), span)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(d)), *(pa.array(x) for x in (a, e - a, a - back, ref_doc, ref_start))],
                names=["doc_id", "start", "n_words", "back", "ref_doc", "ref_start"],
            )

    rows = _with_matches(docs, span, seed).filter("matches IS NOT NULL").select("doc_id", "matches")
    return rows.mapInArrow(tidy(run), "doc_id long, start long, n_words long, back long, ref_doc long, ref_start long")


def _gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """buf[start:end] of all ranges, each with a space behind it, and where each begins."""
    size = ends - starts + 1
    begin = np.append(0, np.cumsum(size))
    out = np.full(begin[-1], 32, np.uint8)
    which, at = _each(starts, ends - starts)
    out[at - starts[which] + begin[which]] = buf[at]
    return out.tobytes(), begin


def remove(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (binary UTF-8: the words outside long factors, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, _, end, back, _, _ = parse(b.column("matches"), span)
            for lo, hi, buf, offsets in textvec.parts(b.column("text")):
                starts, ends = textvec.word_bounds(buf, offsets[:-1])
                first = np.searchsorted(starts, offsets)
                i, j = np.searchsorted(d, (lo, hi))
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, first[d[i:j] - lo] + back[i:j], 1)
                np.add.at(cover, first[d[i:j] - lo] + end[i:j], -1)
                left = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                text, begin = _gather(buf, starts[left], ends[left])
                own = np.searchsorted(left, first)  # kept words before each document
                kept = [text[begin[x] : max(begin[x], begin[y] - 1)] for x, y in zip(own[:-1], own[1:], strict=True)]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array((n - np.diff(own)).astype(np.int64)), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return _with_matches(docs, span, seed).mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_text binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim_batches(spark)
    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], span: int = SPAN) -> dict[int, tuple[int, int, str]]:
    """The contract, by a table of all windows (for tests; doc_ids distinct)."""
    first: dict[tuple, int] = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d, ws in split.items():
        for i in range(len(ws) - span + 1):
            k = tuple(ws[i : i + span])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, ws in split.items():
        gone = set()
        for i in range(len(ws) - span + 1):
            if first[tuple(ws[i : i + span])] < d:
                gone.update(range(i, i + span))
        left = [w for i, w in enumerate(ws) if i not in gone]
        out[d] = (len(ws), len(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
w AS (SELECT rid, doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS s FROM d)),
f AS (SELECT h, min(doc_id) AS m FROM w GROUP BY h),
g AS (SELECT DISTINCT rid, unnest(range(s, s + 50)) AS i FROM w JOIN f USING (h) WHERE m < doc_id),
k AS (SELECT p.rid, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS kept
      FROM p LEFT JOIN g ON p.rid = g.rid AND p.i = g.i GROUP BY p.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""
