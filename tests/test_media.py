import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.operators import designs, embedding, images

IMAGES = "img_id long, height int, width int, channels int, data binary"


def frame(spark, arrays):
    return spark.createDataFrame(
        [(i, *a.shape, bytearray(a.astype("u1").tobytes())) for i, a in enumerate(arrays)], IMAGES
    )


def back(df, *keys):
    return {
        tuple(r[k] for k in keys): np.frombuffer(r["data"], "u1").reshape(r["height"], r["width"], r["channels"])
        for r in df.collect()
    }


def random_images(n, channels=4, size=7):
    rng = np.random.default_rng(4)
    return [rng.integers(0, 256, (size, size + 2, channels)) for _ in range(n)]


def test_alpha_is_composited_on_white(spark):
    a = np.zeros((1, 2, 4), "u1")
    a[0, 1] = (10, 20, 30, 255)
    out = images.on_white(a)
    assert out[0, 0].tolist() == [255, 255, 255] and out[0, 1].tolist() == [10, 20, 30]
    a[0, 0] = (0, 100, 200, 128)
    assert images.on_white(a)[0, 0].tolist() == [127, 177, 227]


def test_prepared_images_are_white_padded_squares(spark):
    wide = np.full((10, 40, 3), 100)
    out = back(images.prepare_images(frame(spark, [wide, np.full((3, 3, 4), 50)]), size=20), "img_id")
    assert out[(0,)].shape == out[(1,)].shape == (20, 20, 3)
    assert (out[(0,)][:7] == 255).all() and (out[(0,)][8:12] == 100).all()


def test_views(spark):
    a = random_images(1, 3, 6)[0]
    views = back(images.expand_views(frame(spark, [a])), "view_id")
    assert sorted(views) == [(i,) for i in range(5)]
    assert (views[(4,)] == a).all() and (views[(1,)] == a[:3, 4:]).all()
    thin = back(images.expand_views(frame(spark, [a[:1]])), "view_id")
    assert len(thin) == 3 and (thin[(2,)] == a[:1]).all()
    whole = back(images.expand_views(frame(spark, [a]), mode="whole"), "view_id")
    assert list(whole) == [(0,)]


def test_augmented_views(spark):
    a = random_images(1, 3)[0].astype("u1")
    views = back(images.augment_views(frame(spark, [a])), "view_id")
    assert len(views) == 6 and (views[(0,)] == a).all() and (views[(1,)] == a[:, ::-1]).all()
    assert (views[(4,)] == np.clip(a * 1.15, 0, 255).astype("u1")).all()
    assert (views[(5,)] == (a * 0.85).astype("u1")).all()
    assert images.rotate(a, 0).tolist() == a.tolist()
    turned = images.rotate(np.zeros((40, 40, 3), "u1"), 5)
    assert (turned[0, 0] == 255).all() and (turned[20, 20] == 0).all()
    # positive angles turn counter-clockwise: a mark on the right moves up
    mark = np.zeros((41, 41, 3), "u1")
    mark[20, 40] = 200
    assert np.argwhere(images.rotate(mark, 5)[:, 30:, 0] == 200)[0][0] < 20


def pixels_by_hand(a, tolerance=30):
    h, w, _ = a.shape
    bg = [sum(int(a[y, x, c]) for y in (0, h - 1) for x in (0, w - 1)) // 4 for c in range(3)]
    shown = [p for p in a.reshape(-1, 4).astype(int) if p[3] >= 128 and sum(abs(p[c] - bg[c]) for c in range(3)) > tolerance]
    if not shown:
        return (*bg, 0, 60, 60, 60)
    return (*bg, len(shown), *[sorted(p[c] for p in shown)[len(shown) // 2] for c in range(3)])


def test_color_profile(spark, rows):
    uniform = np.full((4, 4, 4), 200)
    one = uniform.copy()
    one[1, 2] = (0, 10, 20, 255)
    hidden = one.copy()
    hidden[1, 2, 3] = 100
    arrays = [uniform, one, hidden, np.full((1, 1, 4), 9), *random_images(5)]
    packed = frame(spark, arrays)
    want = sorted((i, *pixels_by_hand(a)) for i, a in enumerate(arrays))
    assert rows(images.image_profile(packed)) == want
    assert rows(images.color_profile(images.pixel_table(packed))) == want
    assert want[1][4:] == (1, 0, 10, 20) and want[2][4:] == (0, 60, 60, 60)


def test_content_box(spark, rows):
    a = np.zeros((100, 80, 3))
    a[20:90, 10:70] = (240, 235, 215)
    small = np.zeros((100, 80, 3))
    small[20:90, 10:20] = (240, 235, 215)
    px = images.pixel_table(frame(spark, [a, small]))
    box = images.content_box(px, images.is_canvas(F.col("r"), F.col("g"), F.col("b")))
    assert rows(box) == [(0, 5, 15, 69, 89, True), (1, 8, 10, 72, 90, False)]


def test_image_source(spark, tmp_path):
    """A bitmap read by Spark's image source comes out as RGB."""
    px = bytes([0, 0, 255, 0, 255, 0, 0, 0])  # one row, BGR, padded to four bytes
    head = b"BM" + (54 + 8).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little")
    info += (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + (8).to_bytes(4, "little") + bytes(16)
    (tmp_path / "a.bmp").write_bytes(head + info + px)
    df = images.from_image_source(spark.read.format("image").load(str(tmp_path)))
    assert list(back(df, "origin").values())[0].tolist() == [[[255, 0, 0], [0, 255, 0]]]


def test_embedding(spark):
    loads = spark.sparkContext.accumulator(0)
    inner = embedding.grid_encoder()

    def factory():
        loads.add(1)
        return inner()

    arrays = random_images(9, 3)
    data = frame(spark, arrays).unionAll(spark.createDataFrame([(99, 0, 0, 3, None)], IMAGES)).coalesce(1)
    got = {r["img_id"]: r["embedding"] for r in embedding.embed(data, factory, ["img_id"], batch_size=4).collect()}
    assert got.pop(99) is None and loads.value == 1
    raw = inner()([a for a in arrays])
    for i, vec in got.items():
        assert np.isclose(np.linalg.norm(vec), 1.0, atol=1e-6)
        assert np.allclose(vec, raw[i] / np.linalg.norm(raw[i]), atol=1e-6)


def test_companion_vectors(spark):
    arrays = random_images(4, 3)
    data = frame(spark, arrays).withColumn("item_id", F.col("img_id") % 2)
    got = {r["item_id"]: np.array(r["embedding"]) for r in embedding.companion_vectors(data, embedding.grid_encoder()).collect()}
    encode = embedding.grid_encoder()()
    for item in (0, 1):
        views = [v for i, a in enumerate(arrays) if i % 2 == item for v in images.augmented(a.astype("u1"))]
        mean = embedding.unit_rows(encode(views)).astype("float32").mean(axis=0)
        assert np.allclose(got[item], mean / np.linalg.norm(mean), atol=1e-5)


# -- stitch records -------------------------------------------------------------------

STITCHES = "design_id long, seq long, x int, y int, cmd string"


def lines_by_hand(records):
    out, prev, color = [], None, 0
    for seq, x, y, cmd in records:
        if cmd == "COLOR_CHANGE":
            color, prev = color + 1, None
            continue
        if cmd in ("END", "STOP"):
            break
        if cmd == "TRIM":
            prev = None
            continue
        if cmd == "STITCH" and prev:
            out.append((seq, *prev, x, y, color))
        prev = (x, y)
    return out


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_segments_equal_the_drawing_loop(spark, rows, width):
    rng = np.random.default_rng(width)
    kinds = ["STITCH"] * 6 + ["JUMP", "TRIM", "COLOR_CHANGE", "OTHER"]
    designs_ = {d: [(s, int(rng.integers(50)), int(rng.integers(50)), str(rng.choice(kinds))) for s in range(40)] for d in range(3)}
    designs_[1][25] = (25, 1, 1, "END")
    designs_[2][0] = (0, 1, 1, "STOP")
    df = spark.createDataFrame([(d, *r) for d, rs in designs_.items() for r in rs], STITCHES)
    want = sorted((d, *line) for d, rs in designs_.items() for line in lines_by_hand(rs))
    assert rows(designs.segments(df, width)) == want


def test_jumps_alone_draw_nothing_and_one_point_has_extent_one(spark, rows):
    df = spark.createDataFrame([(1, 0, 5, 5, "JUMP"), (1, 1, 5, 5, "JUMP"), (2, 0, 3, 4, "STITCH")], STITCHES)
    assert designs.segments(df).count() == 0
    assert rows(designs.design_bbox(df)) == [(1, 5, 5, 5, 5, 1, 1), (2, 3, 3, 4, 4, 1, 1)]
    assert rows(designs.design_stats(df)) == [(1, 0, 2, 1), (2, 1, 0, 1)]


def test_metadata_chain(spark, rows):
    files = spark.createDataFrame([(1, "a", 1024), (2, "b", 61440), (3, "c", 600)], "design_id long, file_name string, size_bytes long")
    st = spark.createDataFrame([(1, 0, 0, 0, "STITCH"), (1, 1, 0, 0, "COLOR_CHANGE")], STITCHES)
    info = bytes(8) + (5_000_001).to_bytes(4, "little") + (7).to_bytes(4, "little") + (4242).to_bytes(4, "little")
    headers = spark.createDataFrame(
        [(1, bytearray(info), bytearray(b"\x09\x00\x00\x00")), (2, bytearray(info), bytearray(b"\x09\x00\x00\x00")), (3, bytearray(b"12345"), bytearray(b"\x09\x00"))],
        "design_id long, info binary, aux binary",
    )
    cols = ("design_id", "stitch_count", "trim_count", "color_count", "approximate", "source")
    assert rows(designs.design_metadata(files, st, headers), *cols) == [
        (1, 1, 0, 2, False, "records"), (2, 4242, None, 9, False, "header"), (3, None, None, None, True, "unknown")
    ]
    assert rows(designs.design_metadata(files, st, headers, estimate=True), *cols) == [
        (1, 1, 0, 2, False, "records"), (2, 4242, 8, 9, False, "header"), (3, 1000, 2, 1, True, "unknown")
    ]


def test_pictures_are_views_of_their_batch():
    import pyarrow as pa

    raw = [bytes(range(12)), None, b"", bytes(range(100, 104)), bytes(6)]
    sizes = [(2, 2, 3), (1, 1, 1), (0, 4, 3), (1, 1, 4), None]
    columns = {n: pa.array([s and s[i] for s in sizes], pa.int32()) for i, n in enumerate(("height", "width", "channels"))}
    for kind in (pa.binary(), pa.large_binary()):
        batch = pa.RecordBatch.from_pydict({**columns, "data": pa.array(raw, kind)})
        for part, lo in ((batch, 0), (batch.slice(2, 3), 2)):
            for found, data, size in zip(images.pictures(part), raw[lo:], sizes[lo:]):
                if data is None or size is None:
                    assert found is None
                else:
                    assert found.shape == size and found.tobytes() == data and not found.flags.owndata


def test_images_without_data_have_no_views(spark, rows):
    data = [(1, 1, 1, 3, bytearray(b"abc")), (2, None, 1, 3, bytearray(b"abc")), (3, 1, 1, 3, None)]
    df = spark.createDataFrame(data, "img_id long, height int, width int, channels int, data binary")
    assert rows(images.augment_views(df, ["img_id"]).select("img_id").distinct()) == [(1,)]
    assert rows(images.image_profile(df), "img_id") == [(1,)]
