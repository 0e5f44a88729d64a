from pyspark.sql import functions as F

from tagwright.functions import geometry, names

C = F.col


def one(values, column, rows, schema):
    return [g[0] for g in values([column], rows, schema)]


def test_dedupe_key(values):
    rows = [(" Mega ", "Fetească Neagră, Sec!", "2019", 750.0), ("mega", "FETEASCA  NEAGRA sec", "2019 ", 750.4), ("a", "x", None, None)]
    got = one(values, names.dedupe_key(C("s"), C("n"), C("v"), C("l")), rows, "s string, n string, v string, l double")
    assert got == ["mega|feteasca neagra sec|2019|750", "mega|feteasca neagra sec|2019|750", "a|x||"]


def test_brand_tokens(values):
    rows = [("Vin Roșu Castel Huniade (oval crest) 750 ml 12X",), ("ŞTEFAN Ţiganca",), (None,), ("(only gloss)",)]
    assert one(values, F.array_join(names.brand_tokens(C("t")), " "), rows, "t string") == ["CASTEL HUNIADE", "STEFAN TIGANCA", "", ""]


def test_folders(values):
    assert one(values, names.prettify(C("t")), [("mega_image",), ("ATAC",), ("  la  doi-pasi ",)], "t string") == ["Mega Image", "ATAC", "La Doi Pasi"]
    assert one(values, names.folder_of(C("t")), [("a/b/c.jpg",), ("c.jpg",), (None,)], "t string") == ["a/b", ".", "."]
    assert one(values, names.slug(C("t")), [("Mega Image, Cluj!",)], "t string") == ["mega-image-cluj"]
    rows = [(["photos", "Mega Image", "2026-06"], None, None), (["pics", "corner_shop"], None, None), (["pics"], None, "auchan"), (["pics"], "X", "auchan"), (["pics"], None, None), ([], None, "")]
    aliases = F.create_map(F.lit("mega image"), F.lit("MEGA"))
    got = one(values, names.resolve_store(C("f"), C("o"), aliases, C("r")), rows, "f array<string>, o string, r string")
    assert [tuple(g) for g in got] == [("MEGA", "folder-map"), ("Corner Shop", "folder"), ("Auchan", "photo"), ("X", "cli"), ("Unknown", "none"), ("Unknown", "none")]


def test_ids_are_stable(values):
    got = one(values, names.job_id("v", C("s"), C("i"), [F.lit(0.1)] * 4, C("i")), [("a", 1), ("a", 1), ("a", 2)], "s string, i int")
    assert got[0] == got[1] != got[2] and len(got[0]) == 16


def test_boxes(values):
    assert one(values, geometry.x_overlap(C("a"), C("b"), C("c"), C("d")), [(0.0, 1.0, 0.5, 1.5), (0.0, 1.0, 2.0, 3.0)], "a double, b double, c double, d double") == [0.5, 0.0]
    assert one(values, geometry.rescale(C("a"), C("b"), C("c")), [(0.5, 0.0, 1.0), (2.0, 0.0, 1.0), (0.5, 1.0, 1.0)], "a double, b double, c double") == [0.5, 1.0, 0.0]


def test_spans_cover_and_fit(values):
    for length in (100, 2576, 2577, 6000, 16348):
        got = [tuple(x) for x in one(values, geometry.spans(C("l"), F.lit(2576)), [(length,)], "l int")[0]]
        assert got[0][0] == 0 and got[-1][1] in (length, length - 1)
        assert all(b - a <= 2577 for a, b in got) and all(x[1] > y[0] for x, y in zip(got, got[1:], strict=False))


def test_tiles_and_grid(values):
    got = one(values, geometry.tiles(F.lit(0), F.lit(0), C("w"), C("h"), F.lit(1000), F.lit("s")), [(900, 900), (1800, 900), (0, 5)], "w int, h int")
    assert [len(g) for g in got] == [1, 2, 0] and got[1][1]["label"] == "s (tile 2/2)" and got[0][0]["has_rail"] is None
    assert [tuple(g) for g in one(values, geometry.fallback_grid(C("w"), C("h")), [(4284, 5712.0), (16348, 3834.0), (1200, 1600.0)], "w int, h double")] == [(2, 3), (4, 2), (1, 1)]


def test_tokens(values):
    assert one(values, geometry.image_tokens(C("w"), C("h"), C("e")), [(1000, 750, 2576), (9000, 9000, 2576), (9000, 9000, 1568)], "w int, h int, e int") == [1000, 4784, 1600]
