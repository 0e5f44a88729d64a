"""The operators over pairs of documents, against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagwright.llm import decontaminate, minhash_dedup, substring_dedup, textvec

from .test_text_operators import docs, encode  # noqa: F401 - a fixture


def words(rng, n, size=4000):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def edited(rng, ws, share):
    return [w if rng.random() > share else f"e{rng.randint(0, 10**6)}" for w in ws]


def corpus():
    rng = random.Random(7)
    passage = words(rng, 70)
    texts = []
    for _ in range(40):
        base = words(rng, rng.randint(60, 200))
        texts.append(base)
        if rng.random() < 0.5:
            texts += [base, edited(rng, base, 0.01), edited(rng, base, 0.03), edited(rng, base, 0.06)]
        if rng.random() < 0.4:
            texts.append(words(rng, 30) + passage + words(rng, 30))
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, "a b"), (1003, "a b"), (1004, "a  b"), (1005, "rep " * 300), (1006, "rep " * 290)]


def test_near_duplicates(spark):
    rows = corpus()
    idf = minhash_dedup.document_frequencies(docs(spark, rows))
    sets = {}
    for lo, hi, buf, offsets in textvec.parts(pa.array([t for _, t in rows])):
        bounds, h, w = minhash_dedup.shingles(textvec.words_of_part(buf, offsets), idf)
        for i in range(lo, hi):
            sets[rows[i][0]] = h[bounds[i - lo] : bounds[i - lo + 1]], w[bounds[i - lo] : bounds[i - lo + 1]]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in rows if len(sets[i][0])]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if minhash_dedup.weighted_jaccard(*sets[a], *sets[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: root(i) for i, _ in rows}
    assert len(set(got.values())) < len(rows) - 20


def test_near_duplicate_edges(spark):
    rows = [(1, "same words here for all of us"), (1, "same words here for all of us"), (None, "same words here for all of us"), (2, "same words here  for all of us"), (3, None)]
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (None, None)]
    kept = minhash_dedup.representatives(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "None"]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_a_template_group_loses_no_link(spark):
    """Copies around a template at or below the threshold, with edits that some of them share."""
    rng = random.Random(11)
    base = words(rng, 120)
    rows = [(0, " ".join(base))]
    for g in range(12):
        start = edited(rng, base, 0.05)
        rows += [(len(rows) + k, " ".join(edited(rng, start, 0.01))) for k in range(3)]
    test_rows = rows
    idf = minhash_dedup.document_frequencies(docs(spark, test_rows))
    sets = []
    for lo, hi, buf, offsets in textvec.parts(pa.array([t for _, t in test_rows])):
        bounds, h, w = minhash_dedup.shingles(textvec.words_of_part(buf, offsets), idf)
        sets += [(h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
    links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if minhash_dedup.weighted_jaccard(*sets[a], *sets[b]) >= 0.8}
    label = {r["node"]: r["label"] for r in minhash_dedup.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs(spark, test_rows)).collect()}
    assert got == {i: label.get(i, i) for i, _ in test_rows}


def test_unrelated_long_texts_are_no_candidates():
    """Draws belong to shingles: texts of 20,000 words that share nothing agree in no band."""
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.getrandbits(40)}" for _ in range(20_000)) for _ in range(30)]
    idf = np.ones(minhash_dedup.DF_BUCKETS, np.float32)
    n = minhash_dedup.BANDS * minhash_dedup.ROWS
    sig = []
    for lo, hi, buf, offsets in textvec.parts(pa.array(texts), minhash_dedup.PART_BYTES):
        bounds, h, w = minhash_dedup.shingles(textvec.words_of_part(buf, offsets), idf)
        sig += [minhash_dedup.sample(h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]], n) for i in range(hi - lo)]
    same = [(sig[a] == sig[b]) for a in range(30) for b in range(a)]
    assert max(x.mean() for x in same) < 0.03
    assert sum(x.reshape(minhash_dedup.BANDS, -1).all(1).any() for x in same) < 5


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    w = rng.uniform(1, 4, 900)
    n = 3000
    for share in (0.5, 0.8, 0.95):
        own = rng.random(900) < share
        other = np.where(own, h, rng.integers(0, 1 << 63, 900, dtype=np.uint64))
        both = w[own].sum()
        agree = (minhash_dedup.sample(h, w, n) == minhash_dedup.sample(other, w, n)).mean()
        assert abs(agree - both / (2 * w.sum() - both)) < 0.03


def test_a_stray_text_in_a_hot_bucket(spark):
    """One stray member does not make the copies of a bucket meet each other: 30,000 of them would be 450 million pairs."""
    n = 30_000
    samples = "transform(sequence(0, 143), i -> cast(id % 7 AS SMALLINT))"
    nodes = spark.range(n + 1).select(F.col("id").alias("rep"), F.expr(samples).alias("samples"))
    buckets = spark.range(n + 1).selectExpr("id AS rep", "100.0D AS mass", "7L AS key", "count(*) over () AS n", "0L AS head", "100.0D AS head_mass").drop("n")
    labels = spark.range(n).selectExpr("id AS node", "0L AS label")
    spokes = spark.range(1, n).selectExpr("0L AS a", "id AS b", "0.9D AS similarity", "95.0D AS inner", "array(id) AS excess")
    got = minhash_dedup._rest(buckets, spokes, labels, nodes, 0.8).collect()
    assert {(r["a"], r["b"]) for r in got} == {(i, n) for i in range(n) if i % 7 == n % 7}


def test_components_of_a_star(spark):
    edges = spark.range(1, 5000).selectExpr("5000 - id AS a", "id AS b").union(spark.range(1, 5000).selectExpr("7000L AS a", "id AS b"))
    got = minhash_dedup.components(edges).groupBy("label").count().collect()
    assert [(r["label"], r["count"]) for r in got] == [(1, 5000)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (103, 100)]
    got = {r["node"]: r["label"] for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in range(100, 104)} == {100}


def test_substring_dedup(spark):
    rng = random.Random(13)
    passage, other = words(rng, 80), words(rng, 55)
    rows = corpus() + [(2000 + i, " ".join(words(rng, rng.randint(0, 60)) + (passage[rng.randint(0, 30) :]) + words(rng, 5) + other[: rng.randint(45, 55)])) for i in range(30)]
    rows += [(3000, "x y " * 200), (3001, "x y " * 100), (3002, "é " * 80), (3003, "é " * 80)]
    want = substring_dedup.brute_force(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["s"]) for r in substring_dedup.remove(docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s")).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_substring_dedup_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (5, text + " tail"), (7, text)]
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove(docs(spark, rows)).collect())
    assert got == {(5, 0): 3, (None, 0): 1, (7, 60): 1}
    assert substring_dedup.remove(docs(spark, [])).count() == 0


def test_substring_dedup_repeats_inside_a_document(spark):
    rng = random.Random(14)
    line, passage, other = words(rng, 20), words(rng, 55), words(rng, 90)
    rows = [(1, line * 3), (2, line * 50), (3, words(rng, 9) + passage + words(rng, 9)), (4, sum((passage + words(rng, 3) for _ in range(6)), []))]
    rows += [(5, other), (6, (words(rng, 60) + other[10:] + line * 2) * 3), (7, line * 4 + other[5:85] + line * 9)]
    rows = [(d, " ".join(ws)) for d, ws in rows]
    want = substring_dedup.brute_force(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["s"]) for r in substring_dedup.remove(docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s")).collect()}
    assert got == want and want[2][:2] == (1000, 1000) and want[4][1] == 330


def test_substring_dedup_rows_of_one_doc_id(spark):
    rng = random.Random(15)
    passage, tail = words(rng, 70), words(rng, 60)
    held = " ".join(words(rng, 9) + passage + words(rng, 9))
    rows = [(1, held), (2, " ".join(passage + tail)), (2, " ".join(words(rng, 5) + passage + tail)), (2, " ".join(tail + passage + tail))]
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove(docs(spark, rows)).collect())
    assert got == {(1, 88, 0): 1, (2, 130, 70): 1, (2, 135, 70): 1, (2, 190, 70): 1}


def test_substring_factors(spark):
    """Left to right, copied from a smaller document, as long as the reference allows, and followed back over the boundary."""
    rng = random.Random(16)
    first, second, third = words(rng, 120), words(rng, 90), words(rng, 200)
    texts = {1: words(rng, 7) + first + words(rng, 5), 2: words(rng, 4) + second, 3: third}
    # a copy that goes over from one reference into another, words of its own, and a copy out of the middle
    texts[4] = first[30:] + second[:60] + ["own"] * 3 + third[50:130]
    texts[5] = first[:60] + first[40:100]  # the second factor starts inside its match
    texts[6] = words(rng, 300)
    rows = [(d, " ".join(ws)) for d, ws in texts.items()]
    found = sorted(tuple(r) for r in substring_dedup.factors(docs(spark, rows)).collect())
    assert {r[0] for r in found} == {4, 5}
    at = {}
    for d, start, n, back, ref, ref_start in found:
        assert ref < d and start >= at.get(d, 0) and n + back >= 50
        ws, there = texts[d], texts[ref]
        assert ws[start - back : start + n] == there[ref_start - back : ref_start + n]
        end, ref_end = start + n, ref_start + n  # the longest match: the next words differ
        assert end == len(ws) or ref_end == len(there) or ws[end] != there[ref_end]
        at[d] = end
    assert [(r[1], r[2], r[4]) for r in found if r[0] == 4] == [(0, 90, 1), (90, 60, 2), (153, 80, 3)]
    want = substring_dedup.brute_force(rows)
    assert sum(n for d, _, n, *_ in found if d == 4) == want[4][1]


def test_substring_parse_helpers():
    one = substring_dedup.join_matches(*(np.array(x) for x in ([0, 0, 0, 1], [10, 0, 40, 0], [60, 50, 90, 50], [3, 3, 4, 3], [110, 100, 0, 7])))
    assert [x.tolist() for x in one] == [[0, 0, 1], [0, 40, 0], [60, 90, 50], [3, 4, 3], [100, 0, 7]]
    assert substring_dedup.greedy([0, 5, 8, 80], [50, 60, 58, 130]) == [(0, 50, 0), (50, 60, 1), (80, 130, 3)]
    assert substring_dedup.greedy([], []) == []
    values = np.random.default_rng(1).integers(0, 9, 300).astype(np.uint64)
    at = substring_dedup._sliding_argmin(values, 39)
    assert at.tolist() == [i + int(np.argmin(values[i : i + 39])) for i in range(300 - 38)]


def test_substring_dedup_very_long_text(spark):
    rng = random.Random(18)
    long = words(rng, 150_000, 10**6)
    rows = [(1, " ".join(long)), (2, " ".join(long[70_000:70_080])), (3, " ".join(["new"] + long[:149_000]))]
    want = substring_dedup.brute_force(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["s"]) for r in substring_dedup.remove(docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s")).collect()}
    assert got == want and want[3][1] == 149_000


def items(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, len int")


def similarity(a, b):
    grams = lambda ws: collections.Counter(" ".join(ws[i : i + 5]) for i in range(len(ws) - 4))
    x, y = grams(a), grams(b)
    return sum(len(g) * min(x[g], y[g]) for g in x | y) / max(sum(len(g) * max(x[g], y[g]) for g in x | y), 1)


def test_decontamination(spark):
    rng = random.Random(17)
    bench = [words(rng, rng.randint(14, 50), 300) for _ in range(15)] + [["one", "two"], words(rng, 6, 300)]
    rows = []
    for i in range(60):
        ws = words(rng, rng.randint(0, 120), 300)
        if i % 3:
            at = rng.randint(0, len(ws))
            ws[at:at] = edited(rng, rng.choice(bench), rng.choice([0, 0, 0.03, 0.08]))
        rows.append((i, " ".join(ws).upper() if i % 7 == 0 else " ".join(ws)))
    rows += [(100, None), (101, "")]
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], round(r["similarity"], 9)) for r in decontaminate.leaks(docs(spark, rows), items(spark, map(" ".join, bench))).collect()}
    want = {}
    for i, t in rows:
        ws = (t or "").lower().split()
        for j, item in enumerate(bench):
            found = [(similarity(ws[s : s + len(item)], item), -s) for s in range(max(len(ws) - len(item), 0) + 1)]
            if found and max(found)[0] >= 0.8:
                want[i, j] = (-max(found)[1], round(max(found)[0], 9))
    assert got == want and len(want) > 20
    kept = decontaminate.clean(docs(spark, rows), items(spark, map(" ".join, bench)))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_decontamination_edges(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (None, text), (2, "unrelated")]
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, rows), items(spark, [text, text, None, ""])).collect()), key=str)
    assert got == [(1, 0), (1, 1), (None, 0), (None, 1)]
    assert decontaminate.leaks(docs(spark, []), items(spark, [text])).count() == 0
    assert decontaminate.leaks(docs(spark, rows), items(spark, [])).count() == 0


def test_decontamination_at_the_edges_of_a_text(spark):
    rng = random.Random(18)
    item, rest = words(rng, 39), words(rng, 50)
    cut = [rest + item[:-1], rest + item[:-2], item[1:] + rest, item[2:] + rest, item[:-1], item[1:-1], rest + item[:20], item[:8]]
    got = {r["doc_id"]: (r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in decontaminate.leaks(docs(spark, [(i, " ".join(ws)) for i, ws in enumerate(cut)]), items(spark, [" ".join(item)])).collect()}
    want = {}
    for i, ws in enumerate(cut):  # every window as long as the item, the first of the best
        best, back = max((similarity(ws[s : s + 39], item), -s) for s in range(max(len(ws) - 39, 0) + 1))
        if best >= 0.8:
            want[i] = (-back, min(39, len(ws)), round(best, 9))
    assert got == want and set(want) == {0, 1, 2, 3, 4, 5}


def test_clean_rows_of_shared_doc_ids_stay(spark):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(None, item), (None, "clean without an id"), (None, None), (1, item), (1, "clean under a repeated id"), (2, "clean")]
    kept = decontaminate.clean(docs(spark, rows), items(spark, [item]))
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter(r for r in rows if r[1] != item)


def test_representatives_keep_texts_that_share_a_doc_id(spark):
    rng = random.Random(21)
    a, b, c, e = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, c), (5, c), (9, c), (9, e), (None, a)]
    kept = minhash_dedup.representatives(docs(spark, rows))
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(1, a), (5, b), (5, c), (9, e), (None, a)])


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(19)
    bits = 64 * decontaminate.LONGS
    prints = [rng.getrandbits(bits) for _ in range(40)]
    near = [p ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(30, 56))) for p in prints] + [rng.getrandbits(bits) for _ in range(40)]
    longs = lambda x: [((x >> 64 * k) & (1 << 64) - 1) - ((x >> 64 * k + 63 & 1) << 64) for k in range(decontaminate.LONGS)]
    left = spark.createDataFrame([(i, longs(p), 9) for i, p in enumerate(near)], "id int, fp array<long>, len int")
    right = spark.createDataFrame([(i, longs(p), 9) for i, p in enumerate(prints)], "item int, item_fp array<long>, len int")
    want = {(i, j) for i, a in enumerate(near) for j, b in enumerate(prints) if (a ^ b).bit_count() <= decontaminate.RADIUS}
    assert decontaminate.RADIUS == 44 and 10 < len(want) < 40
    for small in (True, False):
        got = collections.Counter((r["id"], r["item"]) for r in decontaminate.within_radius(left, right, small).collect())
        assert set(got) == want and set(got.values()) <= {1}


def test_fingerprints(spark):
    texts = [["a", "b", "c", "d", "e", "f"], ["x"] * 40, ["a", "b", "c", "d", "e"]]
    got = {r["k"]: r["fp"] for r in decontaminate.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, ws array<string>"), ["k"]).collect()}
    assert set(got) == {0, 1, 2} and all(len(fp) == decontaminate.LONGS for fp in got.values())
    one = spark.sql("SELECT xxhash64(0, 'a b c d e') AS x, xxhash64(1, 'a b c d e') AS y, xxhash64(2, 'a b c d e') AS z").first()
    assert got[2] == list(one)  # a single shingle gives its own bits


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(23)
    bench = words(rng, 30)
    rows = [(i, " ".join(words(rng, 80))) for i in range(20)]
    rows += [(20, rows[0][1]), (21, "short"), (22, " ".join(words(rng, 30) + bench + words(rng, 30))), (23, " ".join(words(rng, 80)) + " token = abcdef123456")]
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(bench))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = made, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == made.columns
            seen.append({r["doc_id"]: r["text"] for r in at.collect()})
    everything = {i for i, _ in rows}
    assert [set(s) for s in seen] == [everything - {21}, everything - {20, 21}, everything - {20, 21, 22}, everything - {20, 21, 22}]
    assert seen[3][23].endswith("[SECRET]") and seen[2][23].endswith("token = abcdef123456")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == everything - {20, 21, 22}


def plain_quality(text):
    """The strict policy, rule by rule."""
    ws = (text or "").split()
    grams = collections.Counter(zip(ws, ws[1:], ws[2:]))
    inside = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    chars = sum(map(len, ws))
    failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws) or 2 * sum(c in "#*$%&|<>" for c in text or "") > 3 * len(ws)
    return not (failed or chars < 2 * len(ws) or chars > 30 * len(ws) or 10 * (len(lines) - len(set(lines))) > 4 * len(lines))


def plain_near_dedup(rows):
    """Keeps the least doc_id of each component of pairs with a weighted Jaccard similarity of 0.8 or more."""
    df = collections.Counter(w for _, t in rows for w in set(t.split()))
    idf = {w: 1 + math.log((1 + len(rows)) / (1 + n)) / math.log(1 + len(rows)) for w, n in df.items()}
    bags = {}
    for d, t in rows:
        ws = t.split()
        grams = collections.Counter(tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1)))
        bags[d] = {g: (1 + math.log(c)) * sum(idf[w] for w in g) / len(g) for g, c in grams.items()}
    first = {d: d for d, _ in rows}

    def root(x):
        return x if first[x] == x else root(first[x])

    for a, b in itertools.combinations(sorted(bags), 2):
        x, y = bags[a], bags[b]
        both = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
        if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
            first[max(root(a), root(b))] = min(root(a), root(b))
    return [(d, t) for d, t in rows if root(d) == d]


def plain_leaks(text, item):
    ws, own = text.lower().split(), item.lower().split()
    return len(own) >= 5 and any(similarity(ws[s : s + len(own)], own) >= 0.8 for s in range(max(len(ws) - len(own), 0) + 1))


def test_pipeline_against_plain_python(spark, tmp_path, encode):  # noqa: F811
    import corpus_pipeline

    rng = random.Random(41)
    bench = [words(rng, rng.randint(12, 40), 10**5) for _ in range(6)]
    texts = []
    for _ in range(45):
        base = words(rng, rng.randint(55, 160), 10**5)
        texts.append(base)
        if rng.random() < 0.4:
            texts += [list(base), edited(rng, base, 0.01), edited(rng, base, 0.2)]
        if rng.random() < 0.3:
            texts.append(words(rng, 40, 10**5) + edited(rng, rng.choice(bench), 0.01) + words(rng, 40, 10**5))
        if rng.random() < 0.2:
            texts.append(words(rng, 60, 10**5) + ["password:", f"hunter{rng.randint(10**5, 10**6)}", "AKIA" + "ABCD1234" * 2])
    texts += [["same", "three", "words"] * 30, ["x"] * 70, ["ab#$%&*<>|"] * 3 + words(rng, 60, 10**5), words(rng, 3), words(rng, 30_000, 10**5)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, "line one two\n" * 40)]
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [[(d, t) for d, t in rows if plain_quality(t)]]
    want.append(plain_near_dedup(want[-1]))
    want.append([(d, t) for d, t in want[-1] if not any(plain_leaks(t, " ".join(b)) for b in bench)])
    hidden = lambda t: re.sub(r"AKIA[A-Z0-9]{16,}", "[SECRET]", re.sub(r"password: hunter\d+", "[SECRET]", t))
    want.append([(d, hidden(t)) for d, t in want[-1]])
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2]) > 20 and want[2] != want[3]
    at = made
    for (name, stage), expected in zip(corpus_pipeline.STAGES, [*want, None], strict=True):
        at = stage(spark, at, str(tmp_path))
        if expected is not None:
            assert sorted((r["doc_id"], r["text"]) for r in at.collect()) == sorted(expected), name
    pieces = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in at.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {d for d, _ in want[3]}
    for d, t in want[3]:
        ids, to = [*encode(t), 2], 0
        for start, length, crc in sorted(pieces[d]):
            assert start == to and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
            to += length
        assert to == len(ids)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024


def test_pipeline_stages_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, label long, word string"  # clashing names among them
    spark.createDataFrame([(0, "one two three four five six"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(120_000))
    good = " ".join(f"v{i}" for i in range(80))
    odd = [(None, good, None, None, None, None, None), (1, good, "en", "s", 1, 2, "x"), (1, good, "en", "s", 1, 2, "x"), (2, long, "en", None, 1, 2, "x"), (3, None, "en", "s", 1, 2, "x"), (4, good + " more", "en", "s", 1, 2, "x")]
    for rows, left in (([], []), (odd, [1, 2, None])):
        at = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == spark.createDataFrame([], schema).columns, name
        assert sorted((r["doc_id"] for r in at.collect()), key=str) == left
        packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
        assert {r["doc_id"] for r in packed.collect()} == set(left)


def test_kept_results_released_elsewhere_are_let_go(spark):
    from tagwright.llm import common

    common.drop_tables(spark)
    assert common.keep(spark.range(3)).count() == 3
    spark.catalog.clearCache()
    assert common.keep(spark.range(4)).count() == 4 and common.keep(spark.range(5)).count() == 5
    assert [x.count() for x in common._kept] == [4, 5]
    common.drop_tables(spark)
