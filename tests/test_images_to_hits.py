"""From picture files to search hits, previews and folder counts."""

import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_ingest import put
from test_rollups import counts, folder_rows, recounted

from threadlake.operators import catalog, embedding, search
from threadlake.sources import media, tables
from threadlake.streaming import ingest


def plug_ins():
    """Decoder and encoder; made here, so they travel to the workers by value."""

    def decode(content):
        """A made-up format: height and width, then RGB."""
        if not content.startswith(b"PIC"):
            raise ValueError("not a picture")
        height, width = struct.unpack("<HH", content[3:7])
        return np.frombuffer(content[7:], np.uint8).reshape(height, width, 3)

    def factory():
        return lambda images: np.array([i.reshape(-1, 3).mean(axis=0) for i in images])

    return decode, factory


def picture(colour, height=40, width=30):
    return b"PIC" + struct.pack("<HH", height, width) + bytes(colour) * (height * width)


def unpng(data):
    width, height, _, kind = struct.unpack(">IIBB", data[16:26])
    at = data.index(b"IDAT")
    size = struct.unpack(">I", data[at - 4 : at])[0]
    channels = {0: 1, 2: 3, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(height, -1)
    return lines[:, 1:].reshape(height, width, channels)


def test_png_and_shrink():
    rng = np.random.default_rng(1)
    for channels in (1, 3, 4):
        image = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        assert (unpng(embedding.png(image)) == image).all()
        small = embedding.shrink(image, 3)
        assert small.shape == (3, 2, channels)
        assert (small[0, 0] == np.round(image[:3, :3].reshape(-1, channels).mean(axis=0))).all()
        assert embedding.shrink(image, 7) is image


def test_files_become_hits_with_media_and_counts(spark, tmp_path):
    root, base, fbase = (str(tmp_path / p) for p in ("lib", "table", "folders"))
    tables.write_snapshot(folder_rows(spark, [(f"{root}/a", 2, "Pending"), (f"{root}/b", 3, "Pending")]), fbase)
    colours = {"a/red.emb": (250, 5, 5), "a/green.emb": (5, 250, 5), "b/blue.emb": (5, 5, 250)}
    for name, colour in colours.items():
        put(f"{root}/{name}", picture(colour), 1_700_000_000)
    put(f"{root}/b/broken.emb", b"no picture", 1_700_000_000)
    put(f"{root}/b/empty.emb", b"", 1_700_000_000)
    embedder = embedding.image_embedder(*plug_ins(), preview_side=20, thumbnail_side=5)
    outcomes = ingest.scan_library(spark, [root], base, embedder, now=1, folders_base=fbase)
    failed = {os.path.basename(r.file_path) for r in outcomes.where("outcome = 'failed'").collect()}
    assert failed == {"broken.emb", "empty.emb"}
    assert counts(spark, fbase) == {f"{root}/a": 2, f"{root}/b": 1} == recounted(spark, base, fbase)
    query = spark.createDataFrame([(1, 0, [1.0, 0.1, 0.0])], "query_id long, view_id long, qv array<float>")
    stored = tables.read_catalog(spark, base)
    hits = [r.file_name for r in search.search(stored, query).orderBy(F.desc("score")).collect()]
    assert hits == ["red.emb", "green.emb", "blue.emb"]
    # one preview: the filter reaches the scan
    red = stored.where("file_name = 'red.emb'").first()
    assert red.has_preview
    found = media.read_media(spark, base, [red.id])
    assert "PushedFilters: [IsNotNull(id), EqualTo(id," in found._jdf.queryExecution().executedPlan().toString()
    row = found.first()
    assert unpng(row.preview_png).shape == (20, 15, 3) and (unpng(row.preview_png)[3, 3] == (250, 5, 5)).all()
    assert unpng(catalog.thumbnail(found).first().thumbnail).shape == (5, 4, 3)
    # more batches, a content that goes, and one part after folding
    put(f"{root}/b/grey.emb", picture((9, 9, 9)))
    os.remove(f"{root}/a/green.emb")
    gone = spark.createDataFrame([(f"{root}/a/green.emb", "remove"), (f"{root}/b/grey.emb", "create")], "path string, op string")
    ingest.apply_events(spark, base, gone.withColumn("last_ts", F.current_timestamp()), 0, embedder, 2, "watch", folders_base=fbase)
    assert counts(spark, fbase) == {f"{root}/a": 1, f"{root}/b": 2} == recounted(spark, base, fbase)
    kept = {r.id for r in tables.read_catalog(spark, base).collect()}
    assert {r.id for r in media.read_media(spark, base).collect()} > kept
    media.fold_media(spark, base)
    assert {r.id for r in media.read_media(spark, base).collect()} == kept
    assert len(media._parts(spark, base)) == 1
    ids = spark.createDataFrame([(red.id,), ("none",)], "id string")
    assert [r.id for r in media.read_media(spark, base, ids).collect()] == [red.id]


def test_without_previews_nothing_is_shown(spark, tmp_path):
    root, base = str(tmp_path / "lib"), str(tmp_path / "table")
    put(f"{root}/a.emb", picture((1, 2, 3)))
    plain = embedding.image_embedder(*plug_ins())
    ingest.scan_library(spark, [root], base, lambda contents: plain(contents).select("id", "embedding"), now=1)
    assert [r.has_preview for r in tables.read_catalog(spark, base).collect()] == [False]
    assert media.read_media(spark, base).count() == 0
