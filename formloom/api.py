"""A thin HTTP service on the driver: POST /v1/extractions with a sidecar document or an image, one envelope back."""

from __future__ import annotations

import json
import re
import threading
import uuid
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from email import policy
from email.parser import BytesParser

from pyspark.sql import SparkSession, functions as F

from .operators.audit import envelope_json
from .plans.engine import Evidence, FormEngine
from .schemas import JOB_ID
from .sources.evidence import SIDECAR, decode_images, sidecar_evidence
from .stages import shared_folder

MOST_BYTES = 32 << 20


def extract_document(engine: FormEngine, body: str, job_id: str) -> str:
    """The envelope of one sidecar document, as JSON."""
    spark = engine.spark
    rows = spark.createDataFrame([(job_id, body)], "job_id string, body string").select("job_id", F.from_json("body", SIDECAR).alias("s")).select("job_id", "s.*")
    found = envelope_json(engine.extract(Evidence(*sidecar_evidence(rows))).envelopes).first()
    return found["value"] if found else json.dumps({"data": None, "meta": None})


def form_parts(content_type: str, body: bytes) -> dict[str, bytes]:
    """The parts of a multipart/form-data body by name."""
    message = BytesParser(policy=policy.HTTP).parsebytes(b"Content-Type: " + content_type.encode("latin-1") + b"\r\n\r\n" + body)
    parts = message.iter_parts() if message.is_multipart() else ()
    return {p.get_param("name", header="content-disposition"): p.get_payload(decode=True) or b"" for p in parts}


@contextmanager
def _uploaded(spark: SparkSession, job_id: str, content: bytes):
    """A folder that holds one file, where Spark can read it, for as long as it is needed."""
    paths = spark._jvm.org.apache.hadoop.fs
    folder = paths.Path(f"{shared_folder(spark)}/upload-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(paths.Path(folder, job_id))
    try:
        stream.write(bytearray(content))
        stream.close()
        yield folder.toString()
    finally:
        files.delete(folder, True)


def extract_image(engine: FormEngine, content: bytes, job_id: str) -> str | None:
    """The envelope of one image file, read by the engine's scan provider; None if it isn't an image."""
    with _uploaded(engine.spark, job_id, content) as folder:
        images = decode_images(engine.spark, folder).withColumn("job_id", F.lit(job_id))
        if images.isEmpty():
            return None
        found = envelope_json(engine.extract_images(images).envelopes).first()
        return found["value"] if found else json.dumps({"data": None, "meta": None})


def make_server(engine: FormEngine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for one engine; requests run one at a time. Call serve_forever() on it."""
    turn = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            job = self.headers.get("X-Job-Id") or uuid.uuid4().hex
            if self.path != "/v1/extractions":
                return self._reply(404, '{"error": "not_found"}')
            if size > MOST_BYTES or not re.fullmatch(JOB_ID, job):
                return self._reply(400, '{"error": "bad_request"}')
            raw, kind = self.rfile.read(size), self.headers.get("Content-Type") or ""
            if kind.lower().startswith("multipart/form-data"):
                return self._image(form_parts(kind, raw), job)
            body = raw.decode("utf-8", "replace")
            try:
                if not isinstance(json.loads(body), dict):
                    raise ValueError
            except ValueError:
                return self._reply(422, '{"error": "not_a_json_object"}')
            with turn:
                return self._reply(200, extract_document(engine, body, job))

        def _image(self, parts: dict[str, bytes], job: str) -> None:
            """The part ``document`` is the image; ``job_id`` may name the job."""
            job = parts["job_id"].decode("utf-8", "replace") if parts.get("job_id") else job
            if not parts.get("document") or not re.fullmatch(JOB_ID, job):
                return self._reply(400, '{"error": "bad_request"}')
            if engine.scan is None:
                return self._reply(501, '{"error": "no_scan_provider"}')
            with turn:
                found = extract_image(engine, parts["document"], job)
            return self._reply(200, found) if found else self._reply(422, '{"error": "not_an_image"}')

        def log_message(self, *args) -> None:
            """Requests hold personal data; nothing is logged."""

    return ThreadingHTTPServer((host, port), Handler)
