"""The run's providers together: chat requests over HTTP, crops, crop proposals, durable runs, reviews that are waited for, uploads."""

import http.server
import io
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from formloom.api import form_parts, make_server
from formloom.plans.blueprint import Provider, Settings
from formloom.plans.engine import Evidence, FormEngine
from formloom.plans.runs import Run
from formloom.sources import chat, crops, evidence

from test_engine import form_page, png, two_engines
from test_operators import BP, blocks, spans


def completion(text, reason="stop"):
    return json.dumps({"choices": [{"message": {"content": text}, "finish_reason": reason}]}).encode()


def ask(post, **settings):
    return chat.ChatClient(Provider(**settings), post).ask("hello", b"png", "s", {}, 7)


def test_only_the_transport_is_tried_again():
    calls = []

    def flaky(url, headers, body, timeout):
        calls.append((url, headers["Authorization"], json.loads(body)["max_tokens"], timeout))
        if len(calls) < 2:
            raise ConnectionResetError("gone")
        return completion("{}", "length")

    got = ask(flaky, api_key="k", timeout_seconds=3, base_url="http://127.0.0.1:9/v1/")
    assert got.truncated and calls == [("http://127.0.0.1:9/v1/chat/completions", "Bearer k", 7, 3)] * 2

    def down(*args):
        calls.append(args)
        raise TimeoutError("slow")

    calls.clear()
    with pytest.raises(ConnectionError, match="slow"):
        ask(down, request_retries=2)
    assert len(calls) == 3

    def refused(*args):
        calls.append(args)
        raise urllib.error.HTTPError("u", 503, "busy", {}, io.BytesIO())

    calls.clear()
    with pytest.raises(OSError):
        ask(refused, request_retries=2)
    assert len(calls) == 1
    assert all(chat.read_answer(x).text == "" for x in (b"no", b"[]", b'{"choices": []}', completion(None)))


def test_post_over_http():
    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.update(path=self.path, body=self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(completion("fine"))

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = chat.ChatClient(Provider(base_url=f"http://127.0.0.1:{server.server_address[1]}/v1")).ask("p", None, "s", {}, 5)
    server.shutdown()
    assert got.text == "fine" and seen["path"] == "/v1/chat/completions" and json.loads(seen["body"])["messages"][1]["content"] == [{"type": "text", "text": "p"}]


def test_controls_of_a_request():
    box = lambda y: [0, y, 9, y + 9]
    match = lambda **scores: [{"path": p, "score": v} for p, v in scores.items()]
    held = [{"id": "c1", "bbox": box(50), "sure": 0.4, "matches": match(a=0.8)}, {"id": "c2", "bbox": box(10), "sure": 0.9, "matches": match(a=0.8, b=1.0)}, {"id": "c3", "bbox": box(0), "sure": 1.0, "matches": match(b=1.0)}]
    assert [c["id"] for c in chat.controls_for(held, ["a"], 9)] == ["c2", "c1"] and [c["id"] for c in chat.controls_for(held, ["a", "b"], 1)] == ["c3"]
    assert chat.controls_for(held, ["z"], 9) == [] and "matches" not in chat.controls_for(held, ["a"], 9)[0]


@pytest.fixture(scope="module")
def form_image(spark):
    page = form_page([(100, 100, True)])
    return spark.createDataFrame([("j", 800, 600, 3, bytearray(page.tobytes()))], "job_id string, width int, height int, channels int, data binary")


def page_evidence(spark):
    """A page whose recogniser sees a block of boxes but neither its label nor the box."""
    return Evidence(spans(spark, [("Serial number", 300, 400, 420, 430), ("SN-1", 440, 400, 500, 430)]), blocks(spark, [("text", "sex: male", (80, 80, 400, 160))]), evidence.empty(spark, "controls"))


def reads_male():
    """A recogniser that finds the word beside the box, wherever the crop is scaled to; nested, so that workers needn't have this module."""

    def read(pixels):
        k = 3 if pixels.shape[1] > 900 else 1
        return [{"text": "Male", "confidence": 0.97, "x1": 77 * k, "y1": 32 * k, "x2": 132 * k, "y2": 67 * k}]

    return read


def test_a_box_that_only_a_crop_shows(spark, form_image):
    engine = FormEngine(spark, BP, Settings.from_dict({"association": {"layout_block_ocr_enabled": False}}), recognise=reads_male())
    found = engine.extract(page_evidence(spark), images=form_image)
    male = [r for r in found.candidates.where("path = 'data.baby.male'").collect()]
    assert [r["value"] for r in male] == ["true"] and male[0]["source"] == "opencv_control"
    ledger = {r["id"]: r for r in found.ledger.collect()}
    block = male[0]["evidence_ids"][0].rsplit(":", 3)[0]
    assert set(male[0]["evidence_ids"]) <= set(ledger) and {f"crop:j:{block}", "image:j"} <= set(ledger)
    box, label = (ledger[i] for i in male[0]["evidence_ids"])
    assert abs(box["x1"] - 100) <= 3 and abs(box["y2"] - 135) <= 3 and (label["x1"], label["y1"], label["x2"], label["y2"]) == (145, 100, 200, 135)
    assert found.warnings.count() == 0


def test_crops_that_fail_are_reported(spark, form_image):
    def bad(pixels):
        raise RuntimeError("no model")

    found = FormEngine(spark, BP, recognise=bad).extract(page_evidence(spark), images=form_image)
    assert {r["warning"].split(":")[0] for r in found.warnings.collect()} == {"layout_crop_failed"} and found.envelopes.count() == 1


def test_crops_and_pages_are_shown_to_a_model(spark, form_image):
    """The model sees the box on the crop only; what it says of the page cites evidence that isn't there."""
    def post(url, headers, body, timeout):
        completion = lambda text: json.dumps({"choices": [{"message": {"content": text}}]}).encode()
        content = json.loads(body)["messages"][1]["content"]
        shown = json.loads(content[0]["text"].split("Evidence: ", 1)[1])
        if "allowedPaths" not in shown:
            return completion(json.dumps({"detectedDocumentType": "t", "schemaMatch": "match", "handwritingPresent": False}))
        image = shown["imageEvidenceId"]
        assert content[1]["image_url"]["url"].startswith("data:image/png;base64,") and shown["documentContext"] or image.startswith("crop:")
        male = [p for p in shown["allowedPaths"] if p == "data.baby.male"]
        cited = [image, shown["ocr"][0]["id"]] if image.startswith("crop:") else ["nowhere"]
        return completion(json.dumps({"proposals": [{"path": p, "rawValue": True, "evidenceIds": cited} for p in male]}))

    settings = Settings.from_dict({"association": {"layout_block_ocr_enabled": False, "evidence_reverify_enabled": False}})
    model = chat.ChatModel(settings.vlm, BP, post)
    found = FormEngine(spark, BP, settings, proposals=model, understand=model.understand, recover=crops.CropReader(form_image, reads_male(), detect=False)).extract(page_evidence(spark), images=form_image)
    sources = {r["source"] for r in found.candidates.where("path = 'data.baby.male' and value = 'true'").collect()}
    assert sources == {"vlm_visual"}
    assert [r["warning"].rsplit(":", 2)[0] for r in found.warnings.collect()] == ["rejected_proposal:data.baby.male"]
    assert found.descriptions.first()["modelId"] == "local" and found.descriptions.first()["analysis"]["detectedDocumentType"] == "t" and found.understood.first()["error"] is None


def test_a_run_goes_on(spark, tmp_path):
    asked = []

    def propose(targets):
        asked.append(1)
        return spark.createDataFrame([("j", 0, "data.baby.firstName", "Amina", ["s1"])], "job_id string, pid long, path string, raw string, evidence_ids array<string>")

    got = []
    for _ in range(2):
        found = FormEngine(spark, BP, Settings.from_dict({"association": {"reverify_with_vlm": False}}), proposals=propose).extract(two_engines(spark), run=Run(spark, str(tmp_path / "run"), "r"))
        got.append(sorted(map(str, found.decisions.collect())))
    assert len(asked) == 1 and got[0] == got[1]
    trace = spark.read.parquet(str(tmp_path / "run" / "trace"))
    assert {"rule_candidates", "proposals", "decisions", "final_decisions"} <= {r["node"] for r in trace.collect()} and trace.count() == trace.select("event_id", "status").distinct().count()


def test_reviews_are_waited_for(spark):
    engine = FormEngine(spark, BP, Settings.from_dict({"policy": {"review_mode": "interrupt"}}))
    found = engine.extract(two_engines(spark))
    assert found.envelopes.count() == 0 and "data.serialNumber" in found.pending.first()["unresolved"]
    fixes = spark.createDataFrame([("j", "data.serialNumber", "SN-7"), ("j", "data.unknown", "x"), ("k", "data.serialNumber", "SN-8")], "job_id string, path string, value string")
    done = engine.resume(found, fixes)
    assert done.pending.count() == 0 and done.review_queue.count() == 0 and done.envelopes.first()["data"]["serialNumber"] == "SN-7"
    as_is = engine.extract(two_engines(spark), corrections=spark.createDataFrame([("j", None, None)], "job_id string, path string, value string"))
    assert as_is.envelopes.first()["data"]["serialNumber"] is None and as_is.pending.count() == 0
    assert engine.resume(found, fixes.where("job_id = 'k'")).pending.count() == 1


def test_layouts_are_written(spark, tmp_path):
    from formloom.operators.audit import layout_extractions
    from formloom.sources.sinks import write_records

    found = FormEngine(spark, BP).extract(two_engines(spark))
    write_records(layout_extractions(found.layouts, found.decisions, found.envelopes), str(tmp_path / "layouts"))
    row = json.loads(spark.read.text(str(tmp_path / "layouts")).first()[0])
    assert row["layouts"][0]["span_ids"] == ["s0", "s1"] and row["combined"]["acceptedPaths"] == ["data.baby.firstName"]
    assert json.loads(row["combined"]["data"])["baby"]["firstName"] == "Amina" and row["combined"]["fieldDecisions"]["data.baby.firstName"]["disposition"] == "accepted"


def test_uploads(spark):
    assert form_parts('multipart/form-data; boundary="x"', b"--x\r\nContent-Disposition: form-data; name=\"a\"\r\n\r\n1\r\n--x--\r\n") == {"a": b"1"}

    def scan(images):
        return Evidence(images.select("job_id", F.lit(1).alias("page"), F.lit(0).cast("long").alias("seq"), F.lit("s0").alias("id"), F.lit("Serial number: SN-5").alias("text"), F.lit(0.99).alias("confidence"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(90).alias("x2"), F.lit(20).alias("y2"),
                                      F.lit(None).cast("string").alias("script"), F.lit("a").alias("source"), F.lit(0).alias("attempt")), evidence.empty(spark, "blocks"), evidence.empty(spark, "controls"))

    server = make_server(FormEngine(spark, BP, scan=scan), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/v1/extractions"

    def send(content):
        body = b"".join(b'--q\r\nContent-Disposition: form-data; name="%s"\r\n\r\n%s\r\n' % p for p in ((b"job_id", b"up-1"), (b"document", content))) + b"--q--\r\n"
        return urllib.request.Request(url, body, {"Content-Type": "multipart/form-data; boundary=q"})

    got = json.loads(urllib.request.urlopen(send(png(40, 30, (255, 255, 255)))).read())
    assert got["meta"]["fields"]["data.serialNumber"]["evidence_ids"] == ["s0"]
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(send(b"not an image"))
    assert e.value.code == 422
    server.shutdown()
