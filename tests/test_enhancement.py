"""From images to envelopes with table-backed providers: enhancement, descriptions, gates."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.operators import enhance
from formloom.plans.blueprint import Blueprint
from formloom.plans.engine import Evidence, FormEngine
from formloom.plans.forms import BLUEPRINT
from formloom.schemas import BLOCKS, CONTROLS, SPANS


def page(level):
    pixels = np.full((120, 160, 3), level, np.uint8)
    pixels[30:90:12, 20:140] = max(0, level - 12)
    return pixels.tobytes()


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([(j, 160, 120, 3, page(level)) for j, level in (("dim", 60), ("lost", 61), ("plain", 62))], "job_id string, width int, height int, channels int, data binary")


def scan_of(spark):
    """A recogniser that reads pages as written in a table: first as they are, then better on enhanced pages; "lost" loses its text there."""

    def scan(images):
        part = F.split("job_id", "~")
        rows = images.select("job_id", part[0].alias("own"), F.size(part).alias("n"))
        sure = F.when(F.col("n") > 1, 0.99).otherwise(0.82)
        spans = rows.select("job_id", F.lit(1).alias("page"), "own", sure.alias("confidence"), F.col("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
        text = F.when((F.col("own") == "lost") & (F.col("n") > 1), "smudge").when(F.col("seq") == 0, "Serial number").otherwise(F.concat(F.lit("SN-"), F.col("own")))
        box = [(F.lit(10) + 200 * F.col("seq")).cast("int").alias("x1"), F.lit(10).alias("y1"), (F.lit(150) + 200 * F.col("seq")).cast("int").alias("x2"), F.lit(40).alias("y2")]
        spans = spans.select("job_id", "page", F.col("seq").cast("long"), F.concat(F.lit("s"), F.col("seq").cast("string")).alias("id"), text.alias("text"), "confidence", *box, F.lit(None).cast("string").alias("script"), F.lit("ocr-a").alias("source"), F.lit(0).alias("attempt"))
        return Evidence(spans.where("job_id not like 'plain~%'"), spark.createDataFrame([], BLOCKS), spark.createDataFrame([], CONTROLS))

    return scan


def replies(images, e):
    said = F.when(F.col("job_id") == "plain", F.lit(json.dumps({"detectedDocumentType": "other", "schemaMatch": "mismatch", "handwritingPresent": True, "handwritingLegibility": "poor", "recommendedProfiles": ["local_contrast"]})))
    return images.select("job_id", said.otherwise(F.lit(json.dumps({"detectedDocumentType": "order_form", "schemaMatch": "match", "handwritingPresent": False, "recommendedProfiles": ["deskew"]}))).alias("reply"))


def test_images_to_envelopes(spark, images):
    assert spark.createDataFrame([], SPANS).columns == scan_of(spark)(images).spans.columns
    found = FormEngine(spark, Blueprint.from_dict(BLUEPRINT), scan=scan_of(spark), understand=replies).extract_images(images)
    tried = {}
    for r in found.enhancements.collect():
        tried.setdefault(r["job_id"], []).append((r["eligible"], r["chosen"], r["reason"]))
    assert set(tried) == {"dim", "lost", "plain"} and sum(c for _, c, _ in tried["dim"]) == 1
    assert not any(e for e, _, _ in tried["lost"]) and all("baseline_text_not_preserved" in why for _, _, why in tried["lost"])
    assert not any(e for e, _, _ in tried["plain"]) and all("insufficient_ocr_gain" in why for _, _, why in tried["plain"])
    ready = {r["job_id"]: r["mean_confidence"] for r in found.readiness.collect()}
    assert ready["dim"] == pytest.approx(0.99) and ready["lost"] == ready["plain"] == pytest.approx(0.82)
    serial = {r["job_id"]: r for r in found.decisions.where("path = 'data.serialNumber'").collect()}
    assert serial["dim"]["value"] == "SN-dim" and serial["lost"]["value"] == "SN-lost"
    assert "document_schema_mismatch" in serial["plain"]["reasons"] and "document_schema_mismatch" not in serial["dim"]["reasons"]
    assert {r["job_id"]: r["handwriting"] for r in found.understood.collect()} == {"dim": "not_present", "lost": "not_present", "plain": "poor"}
    assert {r["job_id"] for r in found.envelopes.collect()} == {"dim", "lost", "plain"}


def test_variants_are_drawn(spark, images):
    variants = spark.createDataFrame([("dim", 0, ["upscale"], 0.0), ("dim", 1, ["clahe", "denoise_sharpen"], 0.0)], "job_id string, variant int, actions array<string>, degrees double")
    got = {r["job_id"]: r for r in enhance.draw_variants(images, variants).collect()}
    assert set(got) == {"dim~0", "dim~1"} and got["dim~0"]["width"] == 480 and got["dim~1"]["width"] == 160 and got["dim~1"]["data"] != page(60)


def test_strange_job_names_are_reported(spark):
    rows = [(j, 1, 0, "a", "Serial number", 0.9, 0, 0, 9, 9, None, "x", 0) for j in ("good", "../bad")]
    e = Evidence(spark.createDataFrame(rows, SPANS), spark.createDataFrame([("b ad", 1, 0, "b", "text", "", 0.9, 0, 0, 9, 9, 0, "x")], BLOCKS), spark.createDataFrame([], CONTROLS))
    found = FormEngine(spark, Blueprint.from_dict(BLUEPRINT)).extract(e)
    assert {tuple(r) for r in found.warnings.collect()} == {("../bad", "invalid_job_id"), ("b ad", "invalid_job_id")}
    assert {r["job_id"] for r in found.decisions.collect()} == {"good"}
