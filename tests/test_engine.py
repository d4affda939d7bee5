"""The engine, sources, sinks, providers and streaming end to end."""

import json
import struct
import zlib

import pandas as pd
import pytest

from formloom.plans.blueprint import Settings
from formloom.plans.engine import Evidence, FormEngine
from formloom.sources import evidence, providers, sinks
from formloom.streaming import ingest

from test_operators import BP, blocks, controls, spans

BOX = lambda *b: dict(zip(("x1", "y1", "x2", "y2"), b))


def two_engines(spark):
    rows = [("First name", 50, 70, 190, 105, "a"), ("Amina", 220, 70, 330, 105, "a"), ("First name", 50, 170, 190, 205, "b"), ("Amina", 220, 170, 330, 205, "b")]
    return Evidence(spans(spark, rows), blocks(spark, [("text", "", (40, 40, 350, 120))]), controls(spark, []))


def test_two_engines_agree(spark):
    found = FormEngine(spark, BP).extract(two_engines(spark))
    d = {r["path"]: r for r in found.decisions.collect()}
    assert d["data.baby.firstName"]["disposition"] == "accepted" and d["data.baby.firstName"]["score"] >= 0.90
    assert found.envelopes.first()["data"]["baby"]["firstName"] == "Amina"
    assert found.ledger.count() == 5 and {r["path"] for r in found.review_queue.collect()} >= {"data.serialNumber"}


def test_blank_page_goes_to_review(spark):
    e = Evidence(evidence.empty(spark, "spans"), blocks(spark, [("text", "", (0, 0, 10, 10))]), evidence.empty(spark, "controls"))
    s = Settings.from_dict({"policy": {"max_field_retries": 0}})
    found = FormEngine(spark, BP, s).extract(e)
    assert {r["disposition"] for r in found.decisions.collect()} == {"review", "missing"} and found.routes.first()["route"] == "review"


def test_recovery_provider_adds_a_source(spark):
    """A crop read again agrees with the page, under a source of its own."""
    e = two_engines(spark)
    one = Evidence(e.spans.where("source = 'a'"), e.blocks, e.controls)

    def again(tasks, ev, attempt):
        assert tasks.count() > 0
        return ev.spans.selectExpr("job_id", "page", "seq + 100 as seq", "concat(id, ':r') as id", "text", "confidence", "x1", "y1", "x2", "y2", "script", "concat(source, ':layout_crop') as source", f"{attempt} as attempt")

    found = FormEngine(spark, BP, recover=again).extract(one)
    assert {r["path"]: r["disposition"] for r in found.decisions.collect()}["data.baby.firstName"] == "accepted"


def test_proposals_are_verified(spark):
    e = two_engines(spark)
    one = Evidence(e.spans.where("source = 'a'"), e.blocks, e.controls)
    answers = spark.createDataFrame([("j", 0, "data.baby.firstName", "Amina", ["s1"]), ("j", 1, "data.baby.lastName", "Nobody", ["s1"])], "job_id string, pid long, path string, raw string, evidence_ids array<string>")
    found = FormEngine(spark, BP, proposals=providers.table_proposals(answers)).extract(one)
    assert [r["warning"] for r in found.warnings.collect()] == ["rejected_proposal:data.baby.lastName:value_not_supported_by_cited_text"]
    assert "vlm_grounded" in {r["source"] for r in found.candidates.collect()}


def test_corrections_win(spark):
    fix = spark.createDataFrame([("j", "data.serialNumber", "SN-9")], "job_id string, path string, value string")
    assert FormEngine(spark, BP).extract(two_engines(spark), corrections=fix).envelopes.first()["data"]["serialNumber"] == "SN-9"


def sidecar(folder, name="form-1"):
    data = {
        "ocrSpans": [{"id": "x", "text": "First name", "confidence": 0.99, "bbox": BOX(50, 70, 190, 105), "page": 1, "source": "a", "attempt": 3}, {"id": "y", "text": "Amina", "confidence": 0.9, "bbox": BOX(220, 70, 330, 105), "page": 1, "source": "a"}],
        "layoutBlocks": [], "controls": [{"id": "c", "kind": "checkbox", "state": "checked", "stateConfidence": 0.9, "bbox": BOX(5, 5, 4, 9), "page": 1, "source": "opencv"}],
    }
    (folder / f"{name}.json").write_text(json.dumps(data, indent=1))


def test_sidecars(spark, tmp_path):
    sidecar(tmp_path)
    s, b, c = evidence.sidecar_evidence(evidence.read_sidecars(spark, str(tmp_path)))
    rows = s.orderBy("seq").collect()
    assert [(r["job_id"], r["id"], r["attempt"]) for r in rows] == [("form-1", "ocr:p1:0000", 0), ("form-1", "ocr:p1:0001", 0)] and b.count() == 0 and c.count() == 0
    found = FormEngine(spark, BP).extract(Evidence(s, b, c))
    sinks.write_results(found.envelopes, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["data"]["baby"]["firstName"] is None
    assert sinks.json_schema(found.envelopes.select("data").schema)["additionalProperties"] is False


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sidecar(tmp_path / "in", "a")
    engine = FormEngine(spark, BP)

    def process(batch):
        return engine.extract(Evidence(*evidence.sidecar_evidence(batch))).decisions

    for name in ("b", None):
        query = ingest.run_stream(ingest.stream_sidecars(spark, str(tmp_path / "in")), process, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        query.awaitTermination(120)
        if name:
            sidecar(tmp_path / "in", name)
    got = spark.read.parquet(str(tmp_path / "out")).select("job_id").distinct().collect()
    assert {r["job_id"] for r in got} == {"a", "b"}


def test_trace_file(spark, tmp_path):
    from formloom.operators.audit import trace_events

    rows = trace_events(spark.createDataFrame([("r", "n", 0, None, "ok", 1)], "run_id string, node string, attempt int, input_hash string, status string, at int"))
    for _ in range(2):
        sinks.append_trace(rows, str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "trace")).count() == 1
    (tmp_path / "t.jsonl").write_text('{"event_id": "a", "status": "ok"}\nbroken {\n{"event_id": "b", "status": "ok"}\n')
    assert {r["event_id"] for r in sinks.read_trace_lines(spark, str(tmp_path / "t.jsonl")).collect()} == {"a", "b"}


def png(width, height, colour):
    raw = b"".join(b"\0" + bytes(colour) * width for _ in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "page-1.png").write_bytes(png(40, 30, (255, 255, 255)))
    import hashlib

    row = evidence.read_images(spark, str(tmp_path)).first()
    assert row["job_id"] == "page-1" and row["sha256"] == hashlib.sha256((tmp_path / "page-1.png").read_bytes()).hexdigest()
    from formloom.functions.image import assess_images

    got = assess_images(evidence.decode_images(spark, str(tmp_path))).first()
    assert (got["width"], got["height"]) == (40, 30) and "low_resolution" in got["issues"] and got["glare"] == 1.0


def test_crops_fail_alone(spark):
    crops = spark.createDataFrame([("j", "a", "ok"), ("j", "b", "bad")], "job_id string, block_id string, payload string")

    def read(payload):
        if payload == "bad":
            raise RuntimeError("no  model\n here")
        return [{"text": "t", "confidence": 0.5, "x1": 1, "y1": 1, "x2": 2, "y2": 2}]

    got = {r["block_id"]: r for r in providers.recognise_crops(crops, read).collect()}
    assert got["a"]["status"] == "ok" and got["a"]["spans"][0]["text"] == "t" and got["b"]["status"] == "failed" and got["b"]["attempts"] == 2 and got["b"]["error"] == "RuntimeError: no model here"


def test_proposals_are_split_within_a_budget():
    paths = [f"data.p{i}" for i in range(8)]
    cut = providers.propose_resiliently(lambda b: providers.ChatAnswer("{", True), paths, 4, 2)
    assert cut.requests == 2 and cut.warnings[-1].startswith("proposal_budget_exhausted")

    def ask(batch):
        if len(batch) > 1:
            return providers.ChatAnswer("not json")
        return providers.ChatAnswer("Sure: " + json.dumps({"proposals": [{"path": batch[0], "rawValue": "x", "evidenceIds": ["e"]}, {"path": "data.other", "evidenceIds": ["e"]}]}) + " done")

    got = providers.propose_resiliently(ask, paths[:4], 4, 20)
    assert [p["path"] for p in got.proposals] == paths[:4] and got.requests == 7 and "proposal_outside_request:data.other" in got.warnings

    def down(batch):
        raise ConnectionError("refused")

    lost = providers.propose_resiliently(down, paths[:4])
    assert lost.requests == 1 and lost.warnings == ["proposal_request_failed:refused"]


def test_chat_provider(spark):
    def make(job):
        return lambda batch: providers.ChatAnswer(json.dumps({"proposals": [{"path": p, "rawValue": True, "evidenceIds": [job]} for p in batch]}))

    targets = spark.createDataFrame([("j", "data.a", 0), ("j", "data.b", 1)], "job_id string, path string, ord int")
    got = providers.chat_proposals(make)(targets).orderBy("pid").collect()
    assert [(r["path"], r["raw"], r["evidence_ids"]) for r in got] == [("data.a", "true", ["j"]), ("data.b", "true", ["j"])]


def test_registry():
    with pytest.raises(providers.ProviderError, match="register"):
        providers.lookup("none")
    providers.register("x", lambda: 1)
    assert providers.lookup("x")() == 1 and providers.worker_model(("k",), lambda: [1]) is providers.worker_model(("k",), lambda: [2])


def test_recogniser_results(spark):
    rows = pd.DataFrame({"job_id": ["j"], "json": [json.dumps({"res": {"parsing_res_list": [{"block_bbox": [1, 2, 30, 40], "block_label": "text", "block_content": "x", "score": 0.0}, {"bbox": [0, 0, 0, 0], "confidence": 0.5}]}})]})
    got = evidence.layout_results(spark.createDataFrame(rows)).orderBy("seq").collect()
    assert [(r["label"], r["confidence"], r["x2"]) for r in got] == [("text", 0.75, 30), ("unknown", 0.5, 1)]
    text = pd.DataFrame({"job_id": ["j"], "json": [json.dumps({"rec_texts": [" a ", " ", "b"], "rec_scores": [0.9, 0.9, 0.8], "rec_polys": [[[0, 0], [5, 0], [5, 5]]] * 3})]})
    got = evidence.text_results(spark.createDataFrame(text)).orderBy("seq").collect()
    assert [(r["id"], r["text"]) for r in got] == [("ocr:p1:0000", "a"), ("ocr:p1:0001", "b")]


def test_cli_schema(spark, tmp_path, capsys):
    import yaml
    from formloom import cli

    from test_operators import SPEC

    (tmp_path / "bp.yaml").write_text(yaml.safe_dump(SPEC))
    assert cli.main(["schema", "--blueprint", str(tmp_path / "bp.yaml")]) == 0
    assert "serialNumber" in json.loads(capsys.readouterr().out)["properties"]["data"]["properties"]


def form_page(boxes):
    import numpy as np

    page = np.full((600, 800, 3), 255, np.uint8)
    for x, y, ticked in boxes:
        page[y : y + 35, x : x + 35] = 0
        page[y + 3 : y + 32, x + 3 : x + 32] = 255
        if ticked:
            for k in range(26):
                page[y + 4 + k, x + 3 + k : x + 7 + k] = 0
                page[y + 4 + k, x + 28 - k : x + 32 - k] = 0
    return page


def test_boxes_are_found_with_their_states(spark):
    from formloom.functions.controls import detect_controls

    page = form_page([(100, 100, True), (100, 200, False)])
    images = spark.createDataFrame([("j", 800, 600, 3, bytearray(page.tobytes())), ("blank", 800, 600, 3, bytearray(form_page([]).tobytes()))], "job_id string, width int, height int, channels int, data binary")
    got = detect_controls(images).orderBy("seq").collect()
    assert [(r["job_id"], r["id"], r["state"], r["kind"]) for r in got] == [("j", "control:p1:0000", "checked", "checkbox"), ("j", "control:p1:0001", "unchecked", "checkbox")]
    assert abs(got[0]["x1"] - 100) <= 2 and abs(got[0]["y2"] - 135) <= 2


def test_understanding(spark):
    from formloom.operators.understanding import decode_understanding, understood

    good = {"schemaMatch": "mismatch", "handwritingPresent": True, "handwritingLegibility": "poor", "qualityIssues": [{"kind": "blur", "severity": "mild", "affects": ["document"]}], "recommendedProfiles": ["local_contrast", "none"]}
    rows = [("a", "Here: " + json.dumps(good)), ("b", json.dumps({"handwritingPresent": True})), ("c", "no json"), ("d", json.dumps({"languages": ["x"] * 6})), ("e", json.dumps({"handwritingPresent": False, "handwritingLegibility": "good"})), ("f", json.dumps({"schemaMatch": "maybe"}))]
    got = {r["job_id"]: r for r in understood(decode_understanding(spark.createDataFrame(rows, "job_id string, reply string"))).collect()}
    assert got["a"]["mismatch"] and got["a"]["handwriting"] == "poor" and got["a"]["severities"] == ["mild"] and got["a"]["actions"] == ["clahe"]
    assert [got[k]["error"] for k in "abcdef"] == [None, "handwriting_inconsistent", "unreadable", "list_too_long", None, "unknown_name"] and got["e"]["handwriting"] == "not_present"


def test_runs_resume(spark, tmp_path):
    from formloom.plans.runs import Run

    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        run = Run(spark, str(tmp_path / "run"), "r1")
        assert run.stage("map", build).count() == 3
        with pytest.raises(ValueError), run.step("score", inputs={"a": 1}):
            raise ValueError("bad")
        run.write_trace()
    assert len(built) == 1
    got = spark.read.parquet(str(tmp_path / "run" / "trace")).collect()
    assert sorted((r["node"], r["status"]) for r in got) == [("map", "ok"), ("score", "failed")]


def test_overlay_leaves_the_page_alone(spark):
    from formloom.functions.overlay import draw, png, render_overlays

    page = form_page([(100, 100, True)])
    before = page.copy()
    drawn = draw(page, [(10, 10, 60, 60, "text")])
    assert (page == before).all() and (drawn != page).any() and (draw(page, []) != page).any() and png(drawn).startswith(b"\x89PNG")
    images = spark.createDataFrame([("j", 800, 600, 3, bytearray(page.tobytes()))], "job_id string, width int, height int, channels int, data binary")
    row = render_overlays(images, blocks(spark, [("text", "", (10, 10, 60, 60)), ("text", "", (70, 10, 90, 60))])).first()
    assert row["blocks"] == 2 and row["label_counts"] == {"text": 2} and len(row["sha256"]) == 64


def test_http_service(spark):
    import threading
    import urllib.error
    import urllib.request

    from formloom.api import make_server

    server = make_server(FormEngine(spark, BP), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/v1/extractions"
    body = {"ocrSpans": [{"text": "Serial number: SN-1", "confidence": 0.99, "bbox": BOX(0, 0, 90, 20), "page": 1, "source": "a"}]}
    got = json.loads(urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), {"X-Job-Id": "job-1"})).read())
    assert set(got) == {"data", "meta"} and got["meta"]["fields"]["data.serialNumber"]["disposition"] == "review"
    for request, status in ((urllib.request.Request(url, b"[]"), 422), (urllib.request.Request(url + "x", b"{}"), 404), (urllib.request.Request(url, b"{}", {"X-Job-Id": "../x"}), 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(request)
        assert e.value.code == status
    server.shutdown()


def test_nothing_is_mapped_or_scored_again_from_the_same_evidence(spark, monkeypatch):
    """Without a reader, a retry and the re-verification see what the first attempt saw: rules map once, and decisions are made once before and once after."""
    from formloom.operators import decide, mapping

    calls, mapped, decided = [], mapping.rule_candidates, decide.decide
    monkeypatch.setattr(mapping, "rule_candidates", lambda *a, **k: calls.append("map") or mapped(*a, **k))
    monkeypatch.setattr(decide, "decide", lambda *a, **k: calls.append("decide") or decided(*a, **k))
    e = two_engines(spark)
    one = Evidence(e.spans.where("source = 'a'"), e.blocks, e.controls)
    s = Settings.from_dict({"association": {"layout_blocks_enabled": False}})
    engine = FormEngine(spark, BP, s)
    found = engine.extract(one)
    assert calls == ["map", "decide", "decide"]
    # As mapped, scored and mapped again from scratch.
    quality = found.readiness.select("job_id", found.readiness["score"].alias("image_quality"))
    first, last = engine.score(engine.map_rules(one), quality, 0), engine.score(engine.map_rules(one), quality, 1)
    key = lambda rows: sorted(map(str, rows.collect()))
    assert {"retry"} < {r["disposition"] for r in first.union(last).collect()}
    assert key(decide.retried(first, engine.paths, 1)) == key(last) and key(decide.retried(first, engine.paths, 0)) == key(first)
    kept = ["job_id", "path", "value", "raw", "disposition", "reasons", "evidence_ids"]
    assert key(found.decisions.select(kept)) == key(last.select(kept))
