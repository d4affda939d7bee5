"""Column functions on literal values."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.functions import geometry, hashing, image, normalize, text


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_canonical_text(spark):
    got = values(spark, ["  Né_à -- X!", "Straße", "", None, "A  B"], text.canonical_text(F.col("v")))
    assert got == ["né_à x", "strasse", "", None, "a b"]


def test_word_tokens(spark):
    assert values(spark, ["a_b A é 12-x", ""], text.word_tokens(F.col("v"))) == [["a", "b", "é", "12", "x"], []]


def test_ratio_matches_difflib(spark):
    pairs = [("collection date", "collection time"), ("date of birth", "time of birth"), ("male", "female"), ("", "x"), ("abc", "abc")]
    got = values(spark, pairs, text.seq_ratio(F.col("a"), F.col("b")), "a string, b string")
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_ratio_bound_is_an_upper_bound(spark):
    pairs = [("collection date", "date"), ("abcd", "xabcdy"), ("a", "bbbbbb"), ("same", "same")]
    got = values(spark, pairs, text.ratio_bound(F.col("a"), F.col("b")), "a string, b string")
    assert all(bound >= SequenceMatcher(None, a, b).ratio() for bound, (a, b) in zip(got, pairs))


def test_value_parts(spark):
    rows = [("Maria  Joao da Silva", "first_token"), ("Maria  Joao da Silva", "remaining_tokens"), ("Maria", "remaining_tokens"), ("  ", "whole"), (" a  b ", "whole")]
    assert values(spark, rows, text.value_part(F.col("v"), F.col("p")), "v string, p string") == ["Maria", "Joao da Silva", None, None, "a b"]


def test_same_line_suffix(spark):
    aliases = F.array(F.lit("birth weight"), F.lit("weight"))
    assert values(spark, ["Birth Weight: 3 kg", "weight – 2", "Birth weight:", "nothing"], text.same_line_suffix(F.col("v"), aliases)) == ["3 kg", "2", None, None]


def test_text_supports_value(spark):
    rows = [("Name: Amina", "AMINA"), ("Silva, da Joao", "Joao Silva"), ("Amina", "Fatima"), ("x", ""), ("a b", "b c")]
    assert values(spark, rows, text.text_supports_value(F.col("t"), F.col("v")), "t string, v string") == [True, True, False, False, False]


def date(spark, rows, order="DMY"):
    return [(r["value"], r["codes"]) for r in values(spark, rows, normalize.normalize_date(F.col("v"), order))]


def test_dates(spark):
    assert date(spark, ["12/08/2024", "06,08,24", "03.082026", "2024-1-5", "31/02/2024", "junk", "12082024", "1 Aug 2024", "August 1 2024"]) == [
        ("2024-08-12", []), ("2024-08-06", []), ("2026-08-03", []), ("2024-01-05", []), (None, ["invalid_date"]), (None, ["invalid_date"]), ("2024-08-12", []), ("2024-08-01", []), ("2024-08-01", []),
    ]


def test_date_orders(spark):
    assert date(spark, ["12/08/2024", "13/08/2024"], "REJECT_AMBIGUOUS") == [(None, ["ambiguous_date"]), ("2024-08-13", [])]
    assert date(spark, ["12/08/2024", "12 Aug 2024"], "MDY") == [("2024-12-08", []), ("2024-12-20", [])]
    assert date(spark, ["12 Aug 2024"], "DMY") == [(None, ["invalid_date"])]
    assert date(spark, ["20240812", "120824"], "YMD") == [("2024-08-12", []), ("2024-08-12", [])]


def test_times(spark):
    got = [(r["value"], r["codes"]) for r in values(spark, ["8:15 AM", "815", "0815", "12 am", "12pm", "25:00", "8", "8:60", "x", "13 pm"], normalize.normalize_time(F.col("v")))]
    assert [v for v, _ in got] == ["08:15", "08:15", "08:15", "00:00", "12:00", None, "08:00", None, None, None]
    assert all(c == ([] if v else ["invalid_time"]) for v, c in got)


@pytest.mark.parametrize(("raw", "unit", "want"), [("3250 g", "kg", "3.25 kg"), ("3735", "kg", "3.735 kg"), ("62,5 g", "kg", "0.062 kg"), ("3.0kg", "kg", "3 kg"), ("3,5", "g", "3500 g"), ("none", "kg", None), ("10", "kg", "10 kg")])
def test_weights(spark, raw, unit, want):
    got = values(spark, [raw], normalize.normalize_weight(F.col("v"), unit))[0]
    assert got["value"] == want and got["codes"] == ([] if want else ["invalid_weight"])


def test_values_by_type(spark):
    rows = [("yes", "boolean"), ("maybe", "boolean"), ("  ", "date"), (None, "string"), (" a  b ", "string"), ("815", "time")]
    got = values(spark, rows, normalize.normalize_value(F.col("v"), F.col("k"), "DMY"), "v string, k string")
    assert [(r["value"], r["codes"]) for r in got] == [("true", []), (None, ["invalid_boolean"]), (None, ["missing_value"]), (None, ["missing_value"]), ("a b", []), ("08:15", [])]


def test_polygons_and_crops(spark):
    box = geometry.polygon_box(F.col("p"))
    rows = spark.createDataFrame([([[1.5, 2.5], [9.4, 2.0], [9.0, 7.5]],), ([[3.0, 4.0, 3.2, 4.4]],)], "p array<array<double>>")
    assert [tuple(r) for r in rows.select(*box.flat()).collect()] == [(2, 2, 9, 8), (3, 4, 4, 5)]
    item = geometry.Box(columns=tuple(F.lit(v) for v in (5, 7, 45, 27)))
    crop = geometry.Box(columns=tuple(F.lit(v) for v in (20, 30, 180, 100)))
    assert tuple(spark.range(1).select(*geometry.crop_to_page(item, crop).flat()).first()) == (25, 37, 65, 57)


def test_hashes(spark):
    row = spark.range(1).select(hashing.event_id(F.lit("r"), F.lit("n"), F.lit(1), F.lit(None)).alias("e"), hashing.json_literal(F.lit('a"b'), F.lit("string")).alias("j"), hashing.json_literal(F.lit("true"), F.lit("boolean")).alias("b"), hashing.ordinal_id(F.lit("ocr"), F.lit(1), F.lit(7)).alias("o")).first()
    import hashlib

    assert row["e"] == hashlib.sha256(b"r|n|1|-").hexdigest()[:24] and row["j"] == '"a\\"b"' and row["b"] == "true" and row["o"] == "ocr:p1:0007"
    assert hashing.sha256_json({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()


def test_image_features():
    page = np.full((900, 1400, 3), 255, np.uint8)
    page[100:800:40, 100:1300:3] = 20
    page[101:801:40, 100:1300:3] = 20
    got = image.features(page)
    assert got["glare"] == 1.0 and got["contrast"] > 0.90 and got["skew"] == 1.0 and got["resolution"] == 0.75
    for action in ("upscale", "clahe", "denoise_sharpen", "illumination_normalization", "adaptive_binarize", "checkbox_focus", "deskew"):
        assert image.transform_pixels(page[:120, :160], action, 2.0).dtype == np.uint8
    assert image.transform_pixels(page[:120, :160], "upscale").shape == (360, 480, 3)


def test_skew_of_lines():
    page = np.full((400, 400, 3), 255, np.uint8)
    for y in range(40, 360, 30):
        for x in range(40, 360):
            page[int(y + np.tan(np.deg2rad(4)) * (x - 200)) % 400, x] = 0
    assert abs(abs(image.estimate_skew(page[:, :, 0].astype(float))) - 4) <= 0.5


def test_control_states(spark):
    rows = spark.createDataFrame([(0.0,), (0.035,), (0.05,), (0.07,), (0.5,)], "i double").select(image.control_state(F.col("i"), F.lit(1.0)).alias("s")).collect()
    assert [r["s"]["state"] for r in rows] == ["unchecked", "unchecked", "ambiguous", "checked", "checked"] and rows[0]["s"]["state_confidence"] == 1.0 and rows[4]["s"]["state_confidence"] == 1.0
