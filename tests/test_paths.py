import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadlake.functions import paths as P
from threadlake.operators import companions, containment

name = st.sampled_from(["a", "ab", "b", "b%", "_", "A", "b c"])
path = st.lists(name, min_size=1, max_size=4).map(lambda p: "/" + "/".join(p))
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, values, col):
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


@few
@given(st.sets(path, min_size=1, max_size=25), st.sets(path, min_size=1, max_size=10))
def test_containment_equals_prefix_test(spark, files, folders):
    f, d = frame(spark, files, "file_path"), frame(spark, folders, "path")
    strict = {(x, y) for x in files for y in folders if x.startswith(y + "/")}
    loose = strict | {(x, x) for x in files & folders}
    assert {tuple(r) for r in containment.containment_join(f, d).collect()} == strict
    assert {tuple(r) for r in containment.containment_join(f, d, include_self=True).collect()} == loose
    counted = {tuple(r) for r in containment.count_under(f, d).collect()}
    assert counted == {(y, sum(1 for x in files if x.startswith(y + "/"))) for y in folders}
    deepest = {
        x: max((y for y in folders if x == y or x.startswith(y + "/")), key=len, default=None) for x in files
    }
    assert {tuple(r) for r in containment.deepest_root(f, d).collect()} == set(deepest.items())
    assert {r[0] for r in containment.under_roots(f, d).collect()} == {x for x, y in deepest.items() if y}
    assert {r[0] for r in containment.outside_roots(f, d).collect()} == files - {x for x, _ in strict}


def test_separator_guard(spark, rows):
    f = frame(spark, ["/a/bc/x.emb", "/a/b/x.emb"], "file_path")
    assert rows(containment.containment_join(f, frame(spark, ["/a/b"], "path"))) == [("/a/b/x.emb", "/a/b")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("/a/b.c/d.EMB", ("/a/b.c", "d.EMB", "d", ".emb")),
        ("/x", ("/", "x", "x", "")),
        ("plain.jpg", (".", "plain.jpg", "plain", ".jpg")),
        ("/a/.emb", ("/a", ".emb", "", ".emb")),
        ("/a/b.tar.gz", ("/a", "b.tar.gz", "b.tar", ".gz")),
    ],
)
def test_path_parts(spark, text, want):
    assert tuple(frame(spark, [text], "p").select(*P.path_parts("p")).first()) == want


def test_ancestors(spark):
    got = [tuple(r) for r in frame(spark, ["/a/b/c", "x", "a/b"], "p").select(P.ancestors("p"), P.ancestors("p", True)).collect()]
    assert got == [(["/a", "/a/b"], ["/a", "/a/b", "/a/b/c"]), ([], ["x"]), (["a"], ["a", "a/b"])]


def test_folder_label(spark):
    data = ["/x/y/f.emb", "/y/y/f.emb", "/f.emb", "//f.emb", "a/b", "/y/f.emb"]
    got = [r[0] for r in frame(spark, data, "p").coalesce(1).select(P.folder_label("p")).collect()]
    assert got == ["x › y", "y", "", "", "", "y"]


def test_root_labels(spark):
    data = ["/", "/home", "/media/u/disk", "/data/x/", "/mnt/z"]
    got = [tuple(r) for r in frame(spark, data, "p").coalesce(1).select(P.root_label("p"), P.short_root_label("p")).collect()]
    assert got == [("Root (/)", "/"), ("Home (/home)", "home"), ("disk", "disk"), ("/data/x/", "x"), ("z", "z")]


def test_lower_case_item_is_preferred_and_first_companion(spark, rows):
    items = frame(spark, ["/d/s (1).EMB", "/d/s (1).emb", "/d/S (2).EMB", "/e/s (1).emb", "/d/n.emb"], "file_path")
    pics = frame(spark, ["/d/s (1).png", "/d/s (1).JPG", "/d/S (2).Jpeg", "/d/n.jpg", "/e/other.jpg"], "file_path")
    assert rows(companions.pair_companions(items, pics)) == [
        ("/d/S (2).Jpeg", "/d/S (2).EMB"),
        ("/d/n.jpg", "/d/n.emb"),
        ("/d/s (1).JPG", "/d/s (1).emb"),
        ("/d/s (1).png", "/d/s (1).emb"),
    ]
    assert dict(rows(companions.first_companion(items, pics)))["/d/s (1).emb"] == "/d/s (1).JPG"
    inv = companions.inventory(items, pics)
    assert tuple(companions.inventory_summary(inv).first()) == (5, 3, 2, 5)
    assert rows(companions.unpaired(inv), "item_path") == [("/d/S (2).EMB",), ("/e/s (1).emb",)]
    pairs = companions.order_pairs(companions.build_pairs(items, pics)).select("query", "expected", "num", "ext").collect()
    assert len(pairs) == 4 and {p["num"] for p in pairs} == {"1"}
