"""Mapping, decisions, grounding, regions, readiness and audit on small literal tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from formloom.operators import audit, decide, grounding, mapping, readiness, regions
from formloom.plans.blueprint import Blueprint, Settings, SpecError
from formloom.schemas import BLOCKS, CONTROLS, SPANS

ALL = ["same_line", "right_of_label", "below_label"]
SPEC = {
    "id": "t", "version": "1", "document_type": "t", "normalization": {"date_order": "DMY"},
    "fields": {
        "data.baby.firstName": {"aliases": ["first name"], "strategies": ALL, "group_aliases": ["rn"], "group_value_part": "first_token", "critical": True},
        "data.baby.lastName": {"aliases": ["last name"], "strategies": ALL, "group_aliases": ["rn"], "group_value_part": "remaining_tokens", "critical": True},
        "data.baby.birthWeight": {"type": "weight", "aliases": ["birth weight", "peso"], "strategies": ALL},
        "data.serialNumber": {"aliases": ["serial number"], "strategies": ALL, "critical": True, "pattern": "SN-\\d+"},
    },
    "checkbox_groups": {"sex": {"exclusive": True, "aliases": ["sex"], "options": {"male": {"output_path": "data.baby.male", "aliases": ["male", "m"]}, "female": {"output_path": "data.baby.female", "aliases": ["female", "f"]}}}},
}
BP = Blueprint.from_dict(SPEC)


def spans(spark, rows):
    """rows of (text, x1, y1, x2, y2[, source]) in one job."""
    data = [("j", 1, i, f"s{i}", r[0], 0.99, *r[1:5], None, r[5] if len(r) > 5 else "ocr", 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SPANS)


def controls(spark, rows):
    return spark.createDataFrame([("j", 1, i, f"control{i}", "checkbox", s, 0.98, *b, 0.1, None, "opencv", 0) for i, (s, b) in enumerate(rows)], CONTROLS)


def tables(spark):
    return BP.path_rows(spark), BP.alias_rows(spark)


def candidates(spark, rows, boxes=(), **kw):
    return mapping.rule_candidates(spans(spark, rows), controls(spark, list(boxes)), *tables(spark), date_order="DMY", **kw)


def by_path(df):
    out = {}
    for r in df.orderBy("seq").collect():
        out.setdefault(r["path"], []).append(r)
    return out


def test_label_to_the_right_and_a_box(spark):
    got = by_path(candidates(spark, [("First name", 10, 10, 110, 35), ("Amina", 130, 10, 210, 35), ("Female", 55, 55, 130, 80)], [("checked", (10, 55, 35, 80))]))
    first = got["data.baby.firstName"][0]
    assert first["value"] == "Amina" and first["source"] == "rule_right_of_label" and first["evidence_ids"] == ["s0", "s1"]
    assert got["data.baby.female"][0]["value"] == "true" and got["data.baby.female"][0]["support_sources"] == ["opencv"]
    assert got["data.baby.male"][0]["value"] == "true"  # 'female' contains 'male'


def test_weight_label_in_another_language(spark):
    got = by_path(candidates(spark, [("PESO", 10, 10, 80, 35), ("3735", 100, 10, 170, 35)]))
    assert got["data.baby.birthWeight"][0]["raw"] == "3735" and got["data.baby.birthWeight"][0]["value"] == "3.735 kg"


def test_group_label_splits_a_name(spark):
    got = by_path(candidates(spark, [("RN:", 10, 10, 55, 35), ("Maria Joao da Silva", 70, 10, 260, 35)]))
    assert got["data.baby.firstName"][0]["value"] == "Maria" and got["data.baby.lastName"][0]["value"] == "Joao da Silva"
    assert got["data.baby.firstName"][0]["source"] == "rule_group_right_of_label"


def test_same_line_value(spark):
    got = by_path(candidates(spark, [("Serial number: SN-42", 10, 10, 300, 35)]))
    assert [(r["raw"], r["source"], r["evidence_ids"]) for r in got["data.serialNumber"]] == [("SN-42", "rule_same_line", ["s0"])]


def test_a_strong_label_neighbour_gives_no_runner_up(spark):
    """The next label is the nearest neighbour, so the value behind it is not taken."""
    got = by_path(candidates(spark, [("First name", 10, 10, 110, 35), ("Last name", 120, 10, 210, 35), ("Amina", 400, 10, 480, 35)]))
    assert "data.baby.firstName" not in got


def test_only_paths_restricts(spark):
    only = spark.createDataFrame([("data.baby.birthWeight",)], "path string")
    got = by_path(candidates(spark, [("PESO", 10, 10, 80, 35), ("3735", 100, 10, 170, 35), ("First name", 10, 200, 110, 225), ("Amina", 130, 200, 210, 225)], only_paths=only))
    assert list(got) == ["data.baby.birthWeight"]


def test_row_order_does_not_matter(spark):
    rows = [("First name", 10, 10, 110, 35), ("Amina", 130, 10, 210, 35), ("First name", 10, 110, 110, 135, "b"), ("Aminah", 130, 110, 210, 135, "b")]
    df = spans(spark, rows)
    first = [tuple(r) for r in mapping.rule_candidates(df, controls(spark, []), *tables(spark)).orderBy("seq").collect()]
    random.seed(1)
    again = spark.createDataFrame(random.sample(df.collect(), len(rows)), SPANS).repartition(3)
    assert first == [tuple(r) for r in mapping.rule_candidates(again, controls(spark, []), *tables(spark)).orderBy("seq").collect()]


SHAPE = "job_id string, page int, path string, path_ord int, raw string, value string, norm_json string, evidence_ids array<string>, source string, support_sources array<string>, recognition double, association double, attempt int, codes array<string>, seq long"


def made(spark, rows):
    """rows of (path, value, sources, strength[, codes[, source]])"""
    data = [("j", 1, r[0], 0, r[1], r[1], f'"{r[1]}"' if r[1] is not None else "null", ["e"], r[5] if len(r) > 5 else "x", r[2], r[3], r[3], 0, r[4] if len(r) > 4 else [], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SHAPE)


def decided(spark, rows, attempt=0, most=2, quality=0.99):
    jobs = spark.createDataFrame([("j", quality)], "job_id string, image_quality double")
    return {r["path"]: r for r in decide.decide(made(spark, rows), jobs, BP.path_rows(spark), 0.90, attempt, most).collect()}


SN = "data.serialNumber"


def test_one_source_is_capped(spark):
    got = decided(spark, [(SN, "SN-1", ["ocr"], 0.99)])[SN]
    assert got["score"] == 0.89 and got["disposition"] == "retry" and got["reasons"] == ["single_source_cap"]


def test_two_sources_are_accepted(spark):
    got = decided(spark, [(SN, "SN-1", ["ocr"], 0.99), (SN, "SN-1", ["ocr", "local_vlm_visual"], 0.99)])[SN]
    assert got["score"] == pytest.approx(0.99**0.58, abs=1e-6) and got["disposition"] == "accepted" and got["sources"] == 2


def test_conflict_is_capped(spark):
    got = decided(spark, [(SN, "SN-1", ["a", "b"], 0.99), (SN, "SN-2", ["c", "d"], 0.99)], 2)[SN]
    assert got["score"] == 0.59 and got["disposition"] == "review" and got["conflict"] and got["value"] == "SN-1"


@pytest.mark.parametrize("flip", [False, True])
def test_equal_clusters_first_wins(spark, flip):
    rows = [(SN, "SN-1", ["a"], 0.9), (SN, "SN-2", ["b"], 0.9)]
    assert decided(spark, rows[::-1] if flip else rows)[SN]["value"] == ("SN-2" if flip else "SN-1")


def test_fatal_codes_cap(spark):
    got = decided(spark, [(SN, "SN-1", ["a", "b"], 0.99, ["pattern_mismatch"])])[SN]
    assert got["score"] == 0.49 and got["reasons"] == ["pattern_mismatch"]


def test_without_a_candidate(spark):
    first, last = decided(spark, []), decided(spark, [], 2)
    assert first[SN]["disposition"] == "retry" and last[SN]["disposition"] == "review" and last["data.baby.birthWeight"]["disposition"] == "missing"
    assert last[SN]["score"] == 0 and last[SN]["reasons"] == ["no_grounded_candidate"] and len(last) == 6


def test_mismatch_and_routes(spark):
    rows = decide.decide(made(spark, [(SN, "SN-1", ["a", "b"], 0.99)]), spark.createDataFrame([("j", 1.0)], "job_id string, image_quality double"), BP.path_rows(spark), 0.9, 0, 1)
    assert decide.route(rows).first()["route"] == "recover"
    bad = decide.schema_mismatch(rows, spark.createDataFrame([("j",)], "job_id string"))
    assert {r["disposition"] for r in bad.collect()} == {"review"} and max(r["score"] for r in bad.collect()) <= 0.49
    assert decide.route(bad, 1, 1).first()["route"] == "review"


def test_validation(spark):
    rows = [(SN, "XX", ["a"], 0.9), (SN, None, ["a"], 0.9), ("data.baby.birthWeight", "9 kg", ["a"], 0.9), ("data.baby.birthWeight", "900 g", ["a"], 0.9), ("data.baby.birthWeight", "0.3 kg", ["a"], 0.9), (SN, None, ["a"], 0.9, ["missing_value"])]
    got = [r["codes"] for r in decide.validated(made(spark, rows), BP.path_rows(spark)).orderBy("seq").collect()]
    assert got == [["pattern_mismatch"], ["normalization_failed"], ["birth_weight_out_of_range"], ["invalid_weight"], [], ["missing_value"]]


def test_cross_field_codes(spark):
    rows = [("data.baby.dateOfBirth", "2024-02-02", ["a"], 0.9), ("data.baby.sample.collection.date", "2024-02-01", ["a"], 0.9), ("data.baby.sample.collection.date", "2024-02-01", ["a"], 0.8), ("data.baby.male", "true", ["a"], 0.9), ("data.baby.female", "true", ["a"], 0.9)]
    got = [r["codes"] for r in decide.cross_field_codes(made(spark, rows)).orderBy("seq").collect()]
    assert got == [[], ["collection_before_birth"], [], ["exclusive_group_conflict"], ["exclusive_group_conflict"]]


def test_visual_reading_overrides_the_detector(spark):
    rows = [("data.baby.male", "true", ["opencv"], 0.9, [], "opencv_control"), ("data.baby.male", "false", ["ocr", "local_vlm_visual"], 0.9, [], "vlm_visual")]
    kept, removed = decide.reconcile_visual(made(spark, rows), BP.path_rows(spark))
    assert [r["value"] for r in kept.collect()] == ["false"] and removed.first()["removed"] == 1


def test_proposal_targets(spark):
    rows = [("data.baby.birthWeight", "3 kg", ["a"], 0.9), (SN, "SN-1", ["a", "B"], 0.9), ("data.baby.male", "true", ["a", "b"], 0.9)]
    got = {r["path"] for r in decide.proposal_targets(spark.createDataFrame([("j",)], "job_id string"), made(spark, rows), BP.path_rows(spark)).collect()}
    assert got == {"data.baby.birthWeight", "data.baby.firstName", "data.baby.lastName", "data.baby.male", "data.baby.female"}


def verdicts(spark, proposals, visual=False):
    s = spans(spark, [("Name: Amina", 0, 0, 50, 10), ("SEXO", 0, 20, 30, 30)])
    c = controls(spark, [("checked", (40, 20, 50, 30)), ("ambiguous", (60, 20, 70, 30))])
    b = spark.createDataFrame([], BLOCKS)
    image = spark.createDataFrame([("j", "img", "image", 1, 0, 0, 100, 100, 1.0, "source", None, None, None, [])], "job_id string, id string, kind string, page int, x1 int, y1 int, x2 int, y2 int, confidence double, source string, text_sha256 string, artifact_path string, artifact_sha256 string, transform_chain array<string>")
    ledger = audit.evidence_ledger(s, b, c).unionByName(image)
    p = spark.createDataFrame([("j", i, *x) for i, x in enumerate(proposals)], "job_id string, pid long, path string, raw string, evidence_ids array<string>")
    return grounding.verify_proposals(p, BP.path_rows(spark), ledger, s, b, c, visual).orderBy("pid").collect()


def test_grounding_codes(spark):
    got = verdicts(spark, [
        ("data.baby.firstName", "Amina", ["s0"]), ("data.baby.firstName", "Fatima", ["s0"]), ("data.x", "a", ["s0"]), ("data.baby.firstName", "Amina", ["s0", "no"]), ("data.baby.male", None, ["control0"]), ("data.baby.male", "true", ["s1"]),
        ("data.baby.male", "true", ["control1"]), ("data.baby.male", "false", ["control0"]), ("data.baby.male", "true", ["control0"]),
    ])
    assert [r["reject_code"] for r in got] == [None, "value_not_supported_by_cited_text", "unknown_output_path", "unknown_evidence_ids:no", "boolean_requires_value", "boolean_requires_control_evidence", "ambiguous_control_evidence", "boolean_conflicts_with_control", None]
    assert got[0]["value"] == "Amina" and got[0]["recognition"] == 0.99 and got[0]["association"] == 0.92


def test_visual_grounding(spark):
    got = verdicts(spark, [("data.baby.female", "true", ["s1", "img"]), ("data.baby.female", "false", ["control0", "img"])], True)
    assert got[0]["reject_code"] is None and got[0]["support_sources"] == ["ocr", "local_vlm_visual"] and got[0]["source"] == "vlm_visual"
    assert got[1]["reject_code"] == "boolean_conflicts_with_cited_control"


def blocks(spark, rows):
    return spark.createDataFrame([("j", 1, i, f"b{i}", r[0], r[1], 0.9, *r[2], i, "layout") for i, r in enumerate(rows)], BLOCKS)


def test_blocks(spark):
    b = blocks(spark, [("Text", "", (0, 0, 100, 100)), ("Header Image", "", (0, 0, 50, 50)), ("text", "", (0, 0, 2, 2)), ("text", "", (20, 20, 60, 60))])
    got = regions.eligible_blocks(b, width=200, height=200, least_area=0.01).orderBy("index").collect()
    assert [r["id"] for r in got] == ["b0", "b3"]
    s = spans(spark, [("x", 30, 30, 50, 50), ("y", 90, 90, 130, 130), ("z", 150, 150, 160, 160)])
    chosen = regions.eligible_blocks(b)
    assert {(r["item_id"], r["block_id"]) for r in regions.region_members(s, chosen).collect()} == {("s0", "b0"), ("s0", "b3")}
    assert {(r["id"], r["block_id"]) for r in regions.best_block(s, chosen).collect()} == {("s0", "b3")}


def test_search_is_a_shared_budget(spark):
    """Ten fields without a place share three crops."""
    b = regions.eligible_blocks(blocks(spark, [("text", "", (0, 20 * i, 100, 20 * i + 10)) for i in range(10)]))
    plans = spark.createDataFrame([("j", f"data.f{i}", i, None, None, None, None, [], ["upscale", "clahe"], ["x"]) for i in range(10)], "job_id string, path string, ord int, x1 int, y1 int, x2 int, y2 int, evidence_ids array<string>, actions array<string>, reasons array<string>")
    none = spark.createDataFrame([], "job_id string, page int, block_id string, path string, score double")
    tasks, unmatched = regions.recovery_tasks(plans, b, none, BP.path_rows(spark).where("checkbox"), 3)
    got = tasks.collect()
    assert len(got) == 3 and all(len(t["paths"]) == 10 and set(t["reasons"]) == {"search"} and t["actions"] == ["upscale", "clahe"] for t in got) and unmatched.count() == 0
    tasks, unmatched = regions.recovery_tasks(plans, b, none, BP.path_rows(spark).where("checkbox"), 3, search_all=False)
    assert tasks.count() == 0 and unmatched.count() == 10


def test_task_actions(spark):
    rows = spark.createDataFrame([(["upscale", "clahe"], False), (["checkbox_focus", "upscale"], True), (["checkbox_focus", "upscale"], False), ([], True)], "a array<string>, b boolean")
    assert [r[0] for r in rows.select(regions.task_actions(F.col("a"), F.col("b"))).collect()] == [["upscale", "clahe"], ["checkbox_focus", "upscale"], ["upscale", "clahe"], ["upscale", "checkbox_focus"]]


def test_suppression_is_greedy(spark):
    df = spark.createDataFrame([("j", 1, "a", 0.9, 0, 0, 10, 10), ("j", 1, "b", 0.8, 1, 0, 11, 10), ("j", 1, "c", 0.7, 3, 0, 13, 10), ("j", 1, "d", 0.9, 50, 50, 60, 60)], "job_id string, page int, id string, confidence double, x1 int, y1 int, x2 int, y2 int")
    assert [r["id"] for r in regions.suppress_overlaps(df).orderBy("rank").collect()] == ["a", "d", "c"]


def test_readiness(spark):
    rows = spark.createDataFrame([("j", "abcd efgh", 0.9), ("j", "  ", 0.1), ("j", "xy", 0.5), ("k", "", 0.9)], "job_id string, text string, confidence double")
    got = {r["job_id"]: r for r in readiness.ocr_readiness(rows).collect()}
    mean, high = (0.9 * 8 + 0.5 * 2) / 10, 0.8
    assert got["j"]["score"] == pytest.approx(0.65 * mean + 0.2 * high + 0.15 * (1 - math.exp(-10 / 120))) and got["j"]["span_count"] == 2 and got["k"]["score"] == 0


def test_handwriting_lowers_readiness(spark):
    row = spark.range(1).select(*[readiness.fused_readiness(F.lit(0.95), F.lit(0.9), readiness.semantic_quality(F.lit(h), F.array().cast("array<string>"))).alias(h) for h in ("good", "poor")], readiness.fused_readiness(F.lit(0.95), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("alone")).first()
    assert row["poor"] < row["good"] and row["alone"] == pytest.approx(0.95)


def test_enhancement(spark):
    rows = spark.createDataFrame([(0.8, 0.9, 1.0, 1.0, 0.9, 0.9), (0.8, 0.81, 0.1, 0.5, 0.9, 0.7)], "ocr_before double, ocr_after double, text_retention double, control_retention double, technical_before double, technical_after double")
    got = readiness.enhancement_gates(rows).collect()
    assert got[0]["eligible"] and got[0]["reason"] == "eligible"
    assert got[1]["reason"] == "insufficient_ocr_gain+baseline_text_not_preserved+controls_not_preserved+technical_quality_regressed"
    assert readiness.plan_variants(["adaptive_binarize"], ["upscale", "deskew", "illumination_normalization", "clahe"]) == [["deskew", "illumination_normalization", "upscale"], ["deskew"], ["illumination_normalization", "clahe"]]
    assert readiness.plan_variants([], []) == []


def test_trace_is_idempotent(spark):
    rows = spark.createDataFrame([("r", "n", 0, None, "ok", "secret", 1), ("r", "n", 0, None, "ok", "secret", 2), ("r", "n", 0, None, "failed", "secret", 3)], "run_id string, node string, attempt int, input_hash string, status string, values string, at int")
    events = audit.trace_events(rows)
    assert "values" not in events.columns
    once = audit.trace_append(events, events.limit(0))
    assert sorted(r["at"] for r in once.collect()) == [1, 3] and audit.trace_append(events, once).count() == 0


def test_envelope(spark):
    jobs = spark.createDataFrame([("j", 0.99)], "job_id string, image_quality double")
    d = decide.decide(made(spark, [(SN, "SN-1", ["a", "b"], 0.99), ("data.baby.firstName", " ", ["a", "b"], 0.99)]), jobs, BP.path_rows(spark))
    fix = spark.createDataFrame([("j", "data.baby.lastName", "Silva"), ("j", "data.nowhere", "x")], "job_id string, path string, value string")
    out = audit.envelopes(d, BP.output_paths, fix, (SN,))
    row = out.first()
    assert row["data"]["serialNumber"] == "SN-1" and row["data"]["baby"]["firstName"] is None and row["data"]["baby"]["lastName"] == "Silva" and row["meta"]["pre"]["serialNumber"] == "SN-1"
    import json

    assert set(json.loads(audit.envelope_json(out).first()["value"])) == {"data", "meta"}


def test_blueprint_rules():
    with pytest.raises(SpecError, match="twice"):
        Blueprint.from_dict(SPEC | {"checkbox_groups": {"g": {"options": {"o": {"output_path": SN, "aliases": ["x"]}}}}})
    with pytest.raises(SpecError, match="start with"):
        Blueprint.from_dict(SPEC | {"fields": {"x.y": {"aliases": ["a"]}}})
    with pytest.raises(SpecError, match="unknown keys"):
        Blueprint.from_dict(SPEC | {"extra": 1})
    assert BP.output_paths[-2:] == ["data.baby.male", "data.baby.female"] and BP.critical_paths == {"data.baby.firstName", "data.baby.lastName", SN}
    assert BP.hints({"data.baby.male"})["data.baby.male"]["exclusive"] is True


def test_settings_rules(tmp_path):
    with pytest.raises(SpecError, match="local"):
        Settings.from_dict({"vlm": {"base_url": "http://10.0.0.1/v1"}})
    assert Settings.from_dict({"vlm": {"base_url": "http://10.0.0.1/v1", "allow_private_lan": True}}).vlm.allow_private_lan
    with pytest.raises(SpecError, match="local"):
        Settings.from_dict({"vlm": {"base_url": "http://example.com/v1", "allow_private_lan": True}})
    with pytest.raises(SpecError, match="folders"):
        Settings.from_dict({"paddle": {"enabled": True, "text_detection_model_dir": str(tmp_path)}})
    with pytest.raises(SpecError, match="component"):
        Settings.from_dict({"paddle": {"enabled": True, "text_enabled": False, "layout_enabled": False}})
    assert Settings.from_dict({"paddle": {"engine": "a", "layout_engine": "b"}}).paddle.resolved_layout_engine == "b"
    assert Settings().policy.accept_threshold == 0.90
