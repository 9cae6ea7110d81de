import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.operators import evaluation as E
from threadlake.sources import report

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.lists(st.integers(1, 40_000_000), min_size=1, max_size=40))
def test_estimates_equal_the_formula(spark, sizes):
    got = spark.createDataFrame([(s,) for s in sizes], "n long").select("n", S.estimate_meta("n").alias("m")).collect()
    for r in got:
        n = r["n"]
        stitches = int(n / 0.6)
        colors = max(1, min(50, round(round(n / 1024, 1) / 3)))
        assert tuple(r["m"]) == (stitches, colors, max(0, round(stitches / 500))), n


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_score_texts(spark):
    assert one(spark, S.score_band(F.lit(0.6)), S.score_band(F.lit(0.3)), S.score_band(F.lit(0.29))) == ("high", "mid", "low")
    assert one(spark, S.pct_text(F.lit(0.12345)), S.hits_text(F.lit(0), F.lit(0)), S.hits_text(F.lit(91), F.lit(96))) == (
        "12.3%", "0/0 = 0.0%", "91/96 = 94.8%"
    )
    assert one(spark, S.score_bar(F.lit(0.5), 4), S.score_bar(F.lit(1.0), 3)) == ("██░░", "███")


def test_name_parts(spark):
    data = [("S (12).EMB", "12", "S"), ("a (x) (3) (4)", "3", "a"), ("plain", None, "p"), ("(7)", "7", "(")]
    for text, num, prefix in data:
        assert one(spark, S.name_number(F.lit(text)), S.name_prefix(F.lit(text))) == (num, prefix)


@pytest.mark.parametrize(
    "at, want",
    [((93.8, 100.0, 100.0), "EXCELLENT"), ((89.0, 100.0, 100.0), "GOOD"), ((79.0, 96.0, 96.0), "ACCEPTABLE"), ((95.0, 80.0, 84.9), "POOR")],
)
def test_verdicts(spark, at, want):
    assert one(spark, S.verdict(*[F.lit(x) for x in at])) == (want,)


def test_progress(spark):
    assert one(spark, S.progress_pct(F.lit(5), F.lit(0)), S.progress_pct(F.lit(9), F.lit(3)), S.progress_pct(F.lit(1), F.lit(8))) == (0.0, 100.0, 12.5)


def test_colors_and_pixels(spark):
    got = one(spark, S.unpack_rgb(F.lit(0x1A2B3C)), S.palette_color(F.lit(16)), S.palette_color(F.lit(33)))
    assert [tuple(c) for c in got] == [(0x1A, 0x2B, 0x3C), (0x1A, 0x1A, 0x1A), (255, 255, 255)]
    at = [F.lit(float(v)) for v in (10, 0, 0, 10, 10, 20)]
    assert one(spark, *S.to_pixel(*at, size=100)) == (8 + 42, 8 + 42)


def test_clipping_and_base64(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 200_000),)], "b binary")
    assert df.select(F.length(S.clip_bytes("b")), F.length(S.clip_bytes("b", 3))).first() == (131072, 3)
    assert df.select(F.unbase64(S.preview_base64("b")) == F.col("b")).first()[0]


ROWS = "query_id long, expected string, num string, prefix string, ext string, rank long, score double, top_match string, has_results boolean"


def eval_rows(spark):
    data = [
        (1, "s (1).emb", "1", "s", ".jpg", 1, 0.9, "s (1).emb", True),
        (2, "s (1).emb", "1", "s", ".png", 4, 0.8, "s (9).emb", True),
        (3, "s (2).emb", "2", "s", ".jpg", None, 0.7, "s (9).emb", True),
        (4, "s (2).emb", "2", "s", ".jpg", None, 0.0, "?", False),
        (5, "s (3).emb", "3", "s", ".jpg", 1, 0.7, "s (3).emb", True),
    ]
    return spark.createDataFrame(data, ROWS)


def test_evaluation_tables(spark, rows):
    ev = eval_rows(spark)
    assert tuple(E.hits_at(ev).first()) == (5, 2, 2, 3, 3)
    assert rows(E.accuracy_by(ev), "slice", "value", "total", "hits_1", "hits_5") == [
        ("ext", ".jpg", 4, 2, 2), ("ext", ".png", 1, 0, 1), ("num", "1", 2, 1, 2), ("num", "2", 2, 0, 0),
        ("num", "3", 1, 1, 1), ("overall", None, 5, 2, 3),
    ]
    assert rows(E.false_positives(ev, 5)) == [("s (9).emb", 2)]
    assert rows(E.per_item_class(ev), "num", "class") == [("1", "partial"), ("2", "missed"), ("3", "perfect")]
    top = E.summarize(ev).first()
    assert (top["at_1"], top["at_10"], top["verdict"], top["perfect"], top["partial"], top["missed"]) == (40.0, 60.0, "POOR", 1, 1, 1)
    assert rows(E.failures(ev), "query_id") == [(3,), (4,)]
    assert not E.gate(ev).first()[0] and E.gate(ev.where("rank is not null")).first()[0]
    assert not E.gate(ev.where("rank is not null"), top=3).first()[0]


def test_rank_matches_number_and_letter_case(spark, rows):
    found = spark.createDataFrame(
        [(1, "t (7).emb", 1, 0.9), (1, "S (7).emb", 2, 0.8), (1, "s (7).emb", 3, 0.7), (2, "s (8).emb", 1, 0.5)],
        "query_id long, file_name string, position long, score double",
    )
    truth = spark.createDataFrame(
        [(1, "s (7).emb", "7", "s", ".jpg"), (2, "s (7).emb", "7", "s", ".jpg"), (3, "s (7).emb", "7", "s", ".jpg")],
        "query_id long, expected string, num string, prefix string, ext string",
    )
    assert rows(E.score_results(found, truth), "query_id", "rank", "score", "top_match", "has_results") == [
        (1, 2, 0.9, "t (7).emb", True), (2, None, 0.5, "s (8).emb", True), (3, None, 0.0, "?", False)
    ]


def test_report_folder(spark, tmp_path):
    inv = spark.createDataFrame([(True,), (False,)], "paired boolean")
    report.write_report(eval_rows(spark), inv, str(tmp_path / "r"), "set", "2024-01-01T00:00:00")

    def lines(part):
        folder = tmp_path / "r" / part
        return [json.loads(x) for f in os.listdir(folder) if f.endswith(".json") for x in (folder / f).read_text().splitlines()]

    head = lines("header")[0]
    assert head["total_emb"] == 2 and head["paired_emb"] == 1 and head["total_queries"] == 5
    assert head["accuracy"] == {"@1": 40.0, "@3": 40.0, "@5": 60.0, "@10": 60.0}
    assert head["by_format"][".jpg"] == {"total": 4, "hits_1": 2, "hits_3": 2, "hits_5": 2, "hits_10": 2}
    assert len(lines("details")) == 5 and len(lines("failures")) == 2
    assert lines("false_positives") == [{"top_match": "s (9).emb", "n": 2}]


def test_sizes_in_bytes():
    from threadlake.session import size_in_bytes

    assert [size_in_bytes(x) for x in ("16m", "128MB", "134217728b", "7", "2GiB")] == [16 << 20, 128 << 20, 134217728, 7, 2 << 30]
