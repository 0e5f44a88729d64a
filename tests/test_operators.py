import math

from pyspark.sql import functions as F

from tagwright.functions import names
from tagwright.functions.names import brand_tokens
from tagwright.operators import brands, dedupe, referee, report, score, shelves
from tagwright.plans import catalog, pages

C = F.col


def _table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_referee(values):
    rail = [58.99, 54.59, 54.7]
    rows = [(None, rail, 1), (54.59, [], 1), (54.59, rail, 2), (54.59, rail, 1), (60.0, rail, 1), (54.7, rail, None), (60.0, rail, 9)]
    got = values([referee.referee(C("p"), C("r"), C("i"))], rows, "p double, r array<double>, i int")
    assert [g[0]["verdict"] for g in got] == ["no_price", "no_ocr_price", "ok", "index_mismatch", "disagrees", "ok_unindexed", "not_on_rail"]


def test_siblings(values):
    rows = [(20.0, [20.0, 40.0, 33.0, 10.0, 26.67]), (None, [1.0]), (37.99, [25.49])]
    got = values([referee.multibuy_siblings(C("p"), C("r")), referee.per_litre_siblings(C("p"), C("r"))], rows, "p double, r array<double>")
    assert got == [([40.0, 10.0], [40.0, 10.0, 26.67]), ([], []), ([], [])]
    assert values([referee.dropped_digit(C("p"), C("v"))], [(4.76, 750.0), (4.76, 3000.0), (12.0, 750.0), (None, None), (4.0, None)], "p double, v double") == [(True,), (False,), (False,), (False,), (True,)]


def test_reconcile(values):
    rows = [(39.99, "VIN 0.75L 1 L = 53,32 Lei"), (939.99, "VIN 0.75L 1 L = 53,32 Lei"), (50.0, "VIN 0.75L 1 L = 53,32 Lei"), (50.0, "VIN 0.75L"), (50.0, "1 L = 53,32 Lei"), (41.79, "LEI/LTR: 55,72 750 ml")]
    got = [g[0] and g[0]["verdict"] for g in values([referee.reconcile(C("p"), C("t"))], rows, "p double, t string")]
    assert got == ["confirmed", "leading_digit", "disagrees", None, None, "confirmed"]


def test_dedupe_links_everything(spark):
    rows = [(1, "a", 10.0, "x"), (2, "a", 12.0, "xx"), (3, "b", None, "x"), (4, "a", 10.0, "xx"), (5, "b", 5.0, "")]
    df = spark.createDataFrame(rows, "n int, k string, price double, tag string")
    order = dedupe.informativeness(C("price"), F.lit("high"), F.lit(1), F.lit(1), C("tag"), C("k"))
    got = {r["n"]: r for r in dedupe.deduplicate(df, C("k"), order, C("n"), "price").collect()}
    assert {n: (r["row_id"], r["duplicate_of"]) for n, r in got.items()} == {2: ("W00001", None), 4: ("W00001d1", "W00001"), 1: ("W00001d2", "W00001"), 5: ("W00002", None), 3: ("W00002d1", "W00002")}
    assert got[2]["price_conflict"] == [10.0, 12.0] and got[5]["price_conflict"] is None


def _index(spark):
    rows = [(i, f"Crama Vulturul{chr(65 + i // 10)}{chr(65 + i % 10)}", "w", "Crama") for i in range(60)] + [(60, "Castel Huniade", "Recas", ""), (61, "Eticheta Galbena", "Cotnari", "")]
    cat = spark.createDataFrame(rows, "row int, label string, winery string, group string")
    return cat, brands.postings(brands.catalogue(cat, [C("label"), C("winery")]), "row")


def test_brand_match(spark):
    _, post = _index(spark)
    texts = spark.createDataFrame([(1, "CASTEL HUNIADE sec"), (2, "Crama"), (3, "Vulturulaa"), (4, None)], "id int, t string").withColumn("tokens", brand_tokens(C("t")))
    got = {r["id"]: (r["row"], r["matched"]) for r in brands.match(texts, "id", "tokens", post).collect()}
    assert got == {1: (60, True), 3: (0, True)}


def test_brand_candidates_expand_prefixes(spark):
    cat, post = _index(spark)
    asked = spark.createDataFrame([(1, ["ETICH", "GALB"])], "id int, tokens array<string>")
    got = brands.candidates(asked, "id", "tokens", post, ["label"], cat.select("row", "label")).collect()
    assert [r["label"] for r in got] == ["Eticheta Galbena"]


def test_enrich_prefers_verdicts(spark):
    cat, post = _index(spark)
    rows = spark.createDataFrame([(1, "Castel Huniade"), (2, "Ceptura"), (3, "Crama X"), (4, "Eticheta Galbena")], "n int, name string").withColumns({"producer": F.lit(None).cast("string"), "tag": F.lit(None).cast("string"), "label_text": F.lit(None).cast("string")})
    verdicts = spark.createDataFrame([("CEPTURA", "G | W | L", "high"), ("ETICHETA GALBENA", None, "low")], "key string, brand string, confidence string")
    columns = {"name": "name", "producer": "producer", "tag": "tag", "label": "label_text"}
    got = {r["n"]: (r["brand_group"], r["brand_label"], r["brand_match"]) for r in brands.enrich(rows, "n", verdicts, post, cat.select("row", "group", "winery", "label"), columns).collect()}
    assert got == {1: ("", "Castel Huniade", "auto"), 2: ("G", "L", "reviewed:high"), 3: ("", "", "none"), 4: ("", "", "reviewed:none")}


def test_verify_is_one_to_one(spark):
    truth = spark.createDataFrame([(0, 27.99, "Huniade", 750.0), (1, 27.99, "", None), (2, 99.0, "x", None)], "truth_no long, price double, name_contains string, volume_ml double")
    rows = spark.createDataFrame([(10, 27.99, 750.0, "other"), (11, 27.99, 750.2, "Castel huníade"), (12, float("nan"), None, ""), (13, 5.0, None, "")], "row_no long, price double, volume_ml double, text string")
    got = score.verify(truth, rows)
    assert {r["truth_no"]: (r["row_no"], r["name_ok"], r["volume_ok"]) for r in got.collect()} == {0: (11, True, True), 1: (10, None, None), 2: (None, None, None)}
    assert tuple(score.report(got).first()) == (3, 2, 1, 1, 1)
    assert sorted(r["row_no"] for r in score.extras(got, rows).collect()) == [12, 13]


def _page(spark, lines):
    rows = [("p", i, t, 1.0, x, y, x + w, y + h) for i, (t, x, y, w, h) in enumerate(lines)]
    return spark.createDataFrame(rows, "photo string, line_id int, text string, conf double, x0 double, y0 double, x1 double, y1 double")


def test_tokens_and_decoys(spark):
    lines = [("54,59", 0.1, 0.5, 0.04, 0.01), ("8819", 0.2, 0.5, 0.04, 0.01), ("2021", 0.3, 0.1, 0.04, 0.002), ("0.75L", 0.4, 0.5, 0.04, 0.01), ("Garantie 0,50", 0.5, 0.5, 0.04, 0.01), ("13,49 El", 0.6, 0.5, 0.04, 0.01), ("7777", 0.7, 0.5, 0.04, 0.01)]
    got = sorted((r["text"], r["value"], r["kind"]) for r in shelves.printed_tokens(_page(spark, lines)).collect())
    assert got == [("13,49 El", 13.49, "separated"), ("54,59", 54.59, "separated"), ("8819", 88.19, "bare")]


def test_split_prices_are_claimed_once(spark):
    lines = [("15", 0.1, 0.5, 0.04, 0.02), (",99", 0.142, 0.5, 0.02, 0.01), ("170", 0.125, 0.5, 0.02, 0.02)]
    got = [(r["text"], r["value"]) for r in shelves.split_prices(_page(spark, lines)).collect()]
    assert got == [("15,99", 15.99)]


def test_bands(spark):
    rail = [(f"{20 + i},99", 0.1 + 0.09 * i, 0.5 + 0.002 * i, 0.04, 0.01) for i in range(5)]
    upper = [(f"{30 + i},99", 0.1 + 0.09 * i, 0.2, 0.04, 0.01) for i in range(5)]
    text = [("CASTEL", 0.1, 0.48, 0.05, 0.01), ("bottle", 0.19, 0.3, 0.03, 0.01), ("floor", 0.5, 0.9, 0.1, 0.01)]
    whole, slots, inside = shelves.bands(_page(spark, rail + upper + text))
    got = [(r["index"], r["rail"], round(r["y0"], 3)) for r in whole.orderBy("index").collect()]
    assert got[0][1] == 0 and got[1][1] == 1 and got[1][2] == 0.21 and got[-1][1] is None
    how = {r["line_id"]: (r["slot"], r["how"]) for r in shelves.assign_lines(inside.filter("band.index = 1"), slots.filter("band.index = 1").select("band", "slot", "x0", "y0", "x1", "y1")).collect()}
    assert how[10] == (1, "tag") and how[11] == (2, "label")


def test_suppress_overlaps(spark):
    lines = [("abc", 0.1, 0.1, 0.1, 0.1), ("abcd", 0.1, 0.1, 0.1, 0.1), ("x", 0.5, 0.5, 0.1, 0.1)]
    assert [r["text"] for r in shelves.suppress_overlaps(_page(spark, lines)).collect()] == ["abcd", "x"]


def test_flipped(values):
    assert values([shelves.looks_flipped(C("t"))], [("66'ES",), ("54,59",), ("hello",)], "t string") == [(True,), (False,), (False,)]


def test_coverage_without_spans(spark):
    spans = spark.createDataFrame([("a", 0.2, 0.5), ("a", 0.4, 0.6), ("a", 0.65, 0.7)], "g string, lo double, hi double")
    got = sorted((r["g"], r["gap_lo"], r["gap_hi"]) for r in shelves.coverage_gaps(spans, "g", "lo", "hi", groups=spark.createDataFrame([("a",), ("b",)], "g string")).collect())
    assert got == [("a", 0.0, 0.2), ("a", 0.7, 1.0), ("b", 0.0, 1.0)]


def test_chunks(spark):
    items = spark.createDataFrame([("g", i, 40) for i in range(7)], "g string, i int, b int")
    got = {r["i"]: r["chunk"] for r in report.chunks(items, "g", "i", "b", 3, 100).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 1, 2, 2, 3]


def test_verify_greedy_takes_all_orders(spark, tmp_path):
    prices = [10.0, 10.0, 10.0, 20.0, 30.0, 30.0, 40.0]
    orders = [(k, prices[k % 7]) for k in range(1, 121)]
    _table(spark, tmp_path, "orders", orders, "o_orderkey long, o_totalprice double")
    used, outcomes = set(), []
    for k, price in orders:
        free = sorted((o % 20 != 0, o) for o, p in orders if p == price and o not in used)
        used.add(free[0][1])
        outcomes.append(free[0][1])
    want = (len(orders), len(outcomes), len(outcomes), sum(o % 20 == 0 for o in outcomes), sum(o % 30 == 0 for o in outcomes))
    assert tuple(catalog.verify_greedy(spark, str(tmp_path)).first()) == want and want[0] == 120


def test_brand_candidates_read_whole_texts(spark, tmp_path):
    bench = ["castel huniade murfat roua seva", "vulturul negos murfat", "cotnari grasa dulau", "eticheta galbena cotnari"]
    texts = ["filler " * 60 + "huniade", "word cot " * 30 + "murfat castel huniade roua seva", "grasa cotn", None, "nothing here"]
    _table(spark, tmp_path, "benchmark", list(enumerate(bench)), "item_id long, text string")
    _table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    split = lambda text: {w.upper() for w in (text or "").split() if len(w) >= 3} - set(names.STOP_WORDS)
    keys = [split(b) for b in bench]
    idf = {w: math.log(len(keys) / sum(w in k for k in keys)) for k in keys for w in k}
    want = {}
    for i, text in enumerate(texts):
        own = split(text)
        weight = {w: 1.0 if w in own else 0.6 for w in idf if w in own or any(len(o) >= 4 and w.startswith(o) for o in own)}
        found = sorted((-round(sum(idf[w] * weight[w] for w in k if w in weight), 6), j) for j, k in enumerate(keys) if k & set(weight))
        for place, (score_, j) in enumerate(found[:3], 1):
            want[i, place] = (j, -score_, sorted(own & keys[j], key=lambda w: (-idf[w], w))[:4])
    got = {(r["doc_id"], r["place"]): (r["row"], r["score"], r["shared"].split()) for r in catalog.brand_candidates(spark, str(tmp_path)).collect()}
    assert got == want and {i for i, _ in want} == {0, 1, 2} and len(want[1, 1][2]) == 4


def test_dedupe_documents_reads_whole_texts(spark, tmp_path):
    opening = "Licensed under the terms below. "
    texts = [opening + "One.", opening + "Two.", opening.upper() + "one", opening + "x " * 300 + "end", opening + "x " * 300 + "END!", opening + "x " * 301]
    _table(spark, tmp_path, "documents", [(i, t, "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    got = catalog.dedupe_documents(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got if r["duplicate_of"]} == {2, 3} and len({r["key"] for r in got}) == 4


def test_shelf_bands_pages_hold_all_orders(spark, tmp_path):
    _table(spark, tmp_path, "orders", [(k, 7, 100.0 + k) for k in range(63)] + [(100 + k, 8, 50.0 + k) for k in range(9)], "o_orderkey long, o_custkey long, o_totalprice double")
    got = [(r["photo"], r["n_slots"]) for r in pages.shelf_bands(spark, str(tmp_path)).collect() if r["rail"] is not None]
    assert sorted(got) == sorted([("7", 9)] * 3 + [("7-1", 9)] * 3 + [("7-2", 9)] + [("8", 9)])


def test_dedupe_of_a_hot_key(spark):
    """A key with most of the rows goes over several partitions; ranks and numbers are as if it did not."""
    import random

    from tagwright.operators import dedupe

    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randint(0, 60)}", rng.choice([1.5, 2.5, 3.5])) for i in range(3000)]
    made = spark.createDataFrame(rows, "n long, key string, price double").repartition(7)
    got = {r["n"]: (r["row_id"], r["duplicate_of"], r["price_conflict"]) for r in dedupe.deduplicate(made, F.col("key"), [F.col("price").desc()], F.col("n"), "price").collect()}
    want, keys = {}, sorted({k for _, k, _ in rows})
    for no, key in enumerate(keys, 1):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))
        prices = sorted({r[2] for r in own})
        for rank, (n, *_) in enumerate(own):
            first = f"W{no:05d}"
            want[n] = (first if rank == 0 else f"{first}d{rank}", None if rank == 0 else first, prices if rank == 0 and len(prices) > 1 else None)
    assert got == want


def test_price_runs_do_not_part_competitors(spark, monkeypatch):
    import random

    from tagwright.operators import score

    monkeypatch.setattr(score, "BLOCK", 8)
    monkeypatch.setattr(score, "RUNS", 1)
    rng = random.Random(5)
    prices = sorted({round(rng.randint(0, 400) / 100, 2) for _ in range(150)})
    got = {r["price"]: r["_g"] for r in score.price_runs(spark.createDataFrame([(p,) for p in prices], "price double")).collect()}
    for a, b in zip(prices, prices[1:]):
        assert (got[a] == got[b]) == (round(b * 100) - round(a * 100) <= 1)


def test_verify_of_one_price_makes_no_pairs(spark, tmp_path):
    """Many orders of one price: as many pairs as truths times rows would be 900 million."""
    n = 30000
    orders = spark.range(1, n + 1).select(F.col("id").alias("o_orderkey"), F.lit(1234.5).alias("o_totalprice"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    with_token = [k for k in range(1, n + 1, 2) if k % 20 == 0]
    free = with_token + [k for k in range(1, n + 1, 2) if k % 20]
    got = {r["truth_no"]: r["row_no"] for r in pages.verify_assignment(spark, str(tmp_path)).collect()}
    assert got == {k: free[k - 1] + 1 if k <= len(free) else None for k in range(1, n + 1)}
    assert {r["row_no"] for r in pages.verify_extras(spark, str(tmp_path)).collect()} == {k + 1 for k in range(2, n + 1, 2)}


def test_verify_like_the_plain_loop(spark):
    """Prices that are no whole cents, tokens, texts and prices that are missing, truths in groups."""
    import random

    rng = random.Random(11)
    price = lambda: rng.choice([None, float("nan"), -0.0, 1e300, *[round(rng.randint(0, 60) / 1000 + 5, 3) for _ in range(9)]])
    truth = [(i, price(), rng.choice(["", None, "ca", "b", "-"]), rng.choice([None, 750.0, 0.5]), rng.randint(0, 1)) for i in range(150)]
    rows = [(1000 + i, price(), rng.choice([None, 750.4, 1.0]), rng.choice(["Castel", "bă", "x", None, ""])) for i in range(150)]
    norm = lambda text: "".join(c if c.isalnum() else " " for c in (text or "").upper().replace("Ă", "A"))

    def plain(truths):
        used, out = set(), {}
        for no, p, token, volume, _ in truths:
            fits = [r for r in rows if None not in (p, r[1]) and r[0] not in used and abs(r[1] - p) <= 0.005 + 1e-12]
            fits.sort(key=lambda r: not (token and norm(token) in norm(r[3])))
            out[no] = (None, None, None)
            if fits:
                used.add(fits[0][0])
                out[no] = (fits[0][0], norm(token) in norm(fits[0][3]) if token else None, None if volume is None else abs((fits[0][2] or 0) - volume) < 1)
        return out

    t = spark.createDataFrame(truth, "truth_no long, price double, name_contains string, volume_ml double, part int")
    r = spark.createDataFrame(rows, "row_no long, price double, volume_ml double, text string")
    found = lambda df: {x["truth_no"]: (x["row_no"], x["name_ok"], x["volume_ok"]) for x in df.collect()}
    assert found(score.verify(t, r)) == plain(truth)
    assert found(score.verify(t, r, "part")) == plain([x for x in truth if x[4] == 0]) | plain([x for x in truth if x[4] == 1])


def _plain_above(boxes):
    """SQL's answer, box by box: not a number is more than any number."""
    up = lambda v: (v != v, 0.0 if v != v else v)
    out = {}
    for g, i, x0, x1, cy in boxes:
        found = []
        for h, j, y0, y1, dy in boxes:
            if g == h and i != j and None not in (x0, x1, cy, y0, y1, dy) and up(dy) < up(cy):
                shared, span = min(x1, y1, key=up) - max(x0, y0, key=up), x1 - x0
                if up(span) > up(0.0) and up(shared) >= up(0.15 * span):
                    found.append((up(dy), -j))
        out[g, i] = -max(found)[1] if found else None
    return out


def test_nearest_above_like_the_plain_loop(spark):
    import random

    rng, nan = random.Random(9), float("nan")
    boxes = []
    for i in range(900):
        x0, width = rng.choice([rng.random(), round(rng.random(), 1)]), rng.choice([0.2, 0.2, 0.01, 0.7, rng.random(), 0.0, -0.1, 1e-7])
        boxes.append((rng.choice("aaab"), i, rng.choice([x0] * 60 + [None, nan]), x0 + width, rng.choice([round(rng.random(), 2)] * 60 + [None, nan])))
    made = spark.createDataFrame(boxes, "g string, id long, x0 double, x1 double, cy double").withColumn("y1", C("id") + 0.5)
    got = shelves.nearest_above(made, "g", "id").collect()
    assert {(r["g"], r["id"]): r["above_id"] for r in got} == _plain_above(boxes) and len(got) == 900
    assert all(r["above_y1"] == (None if r["above_id"] is None else r["above_id"] + 0.5) for r in got)


def test_nearest_above_of_a_large_group(spark):
    """Forty thousand boxes in columns of one group, the box above being 4,000 places away: no join of all with all."""
    n, columns = 40_000, 4000
    made = spark.range(n).select("id", F.lit(1).alias("g"), (C("id") * 7 % columns).cast("double").alias("x0"), (C("id") / n).alias("cy"))
    made = made.withColumns({"x1": C("x0") + 0.9, "y1": C("cy")})
    got = shelves.nearest_above(made, "g", "id")
    assert {r["id"]: r["above_id"] for r in got.collect()} == {i: i - columns if i >= columns else None for i in range(n)}
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("id#" in x for x in joins) and not any("<" in x or "NOT" in x for x in joins)


def test_verify_of_whole_cents_runs_no_python(spark, tmp_path, monkeypatch):
    """Prices that agree with themselves only, of truths with one token each, are matched by rank; a Python worker would not start."""
    orders = spark.range(1, 4001).select(F.col("id").alias("o_orderkey"), (F.col("id") % 37 * 100 + 20.0).alias("o_totalprice"), F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(spark.sparkContext, "pythonExec", "/no/python")
    got = {r["truth_no"]: (r["row_no"], r["name_ok"], r["volume_ok"]) for r in pages.verify_assignment(spark, str(tmp_path)).collect()}
    want = {}
    for rest in range(37):
        own = [k for k in range(1, 4001) if k % 37 == rest]
        free = sorted((k % 20 != 0, k) for k in own if k % 3)
        for i, k in enumerate(own):
            want[k] = (free[i][1] + 1, not free[i][0], free[i][1] % 30 == 0) if i < len(free) else (None, None, None)
    assert got == want
    assert {r["row_no"] for r in pages.verify_extras(spark, str(tmp_path)).collect()} == {k + 1 for k in range(3, 4001, 3)}


def test_verify_by_rank_and_in_order(spark, monkeypatch):
    """Prices alone and prices that agree, one token at a price or several, prices that share a block's end, none and infinite ones."""
    import random

    monkeypatch.setattr(score, "BLOCK", 64)
    rng = random.Random(3)
    prices = [0.064, 0.07, 0.128, 1.28, 1.275, 9.99, 10.0, 10.005, 20.0, 20.0051, -0.0, -3.2, 4e11, 1e300, 2e300, float("inf"), None]
    asked = {p: rng.choice(["", "ca", "b", None]) for p in prices[::2]}
    token = lambda p: asked[p] if p in asked else rng.choice(["", "ca", "b"])
    truth = [(i, p := rng.choice(prices), token(p), rng.choice([None, 750.0, float("nan")]), rng.choice([0, 1, None])) for i in range(300)]
    rows = [(1000 + i, rng.choice(prices), rng.choice([None, 750.4, 1.0]), rng.choice(["Castel", "bă", "x", None])) for i in range(260)]
    norm = lambda text: (text or "").upper().replace("Ă", "A")

    def plain(truths):
        used, out = set(), {}
        for no, p, token, volume, _ in truths:
            fits = [r for r in rows if None not in (p, r[1]) and r[0] not in used and abs(r[1] - p) <= 0.005 + 1e-12]
            fits.sort(key=lambda r: not (token and norm(token) in norm(r[3])))
            out[no] = (None, None, None)
            if fits:
                used.add(fits[0][0])
                out[no] = (fits[0][0], norm(token) in norm(fits[0][3]) if token else None, None if volume is None else abs((fits[0][2] or 0) - volume) < 1)
        return out

    t = spark.createDataFrame(truth, "truth_no int, price double, name_contains string, volume_ml double, part int")
    r = spark.createDataFrame(rows, "row_no long, price double, volume_ml double, text string")
    found = lambda df: {x["truth_no"]: (x["row_no"], x["name_ok"], x["volume_ok"]) for x in df.collect()}
    assert score.verify(t, r).schema["truth_no"].dataType == t.schema["truth_no"].dataType
    assert found(score.verify(t, r)) == plain(truth)
    want = {}
    for part in (0, 1, None):
        want |= plain([x for x in truth if x[4] == part])
    assert found(score.verify(t, r, "part")) == want


def test_recogniser_tiles(values):
    from tagwright.functions import geometry

    cut = lambda length, budget: geometry.recogniser_spans(F.lit(length), F.lit(budget))
    one, two, most, off = values([cut(900, 900), cut(1000, 600), F.size(cut(10**6, 100)), cut(900, 0)], [(1,)], "n int")[0]
    assert [tuple(x) for x in one] == [(0, 900)] == [tuple(x) for x in off] and most == 41
    assert [tuple(x) for x in two] == [(0, 541), (459, 1000)]
