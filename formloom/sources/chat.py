"""A chat model behind an HTTP endpoint: what it is shown of a document, its requests, and a client on the workers.

What a request shows is gathered in Spark, one row per document; a document's evidence is one page's. Requests are sent
on the workers, within each document's budget. Only failures of the transport are tried again; an answer with an error
status isn't, and an answer that can't be read is asked for again in halves (``propose_resiliently``).
"""

from __future__ import annotations

import base64
import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.image import assess_images, pixels_of
from ..functions.overlay import png
from ..functions.text import safe_error
from ..operators import understanding
from ..operators.mapping import KEY, associate_controls, label_matches
from ..schemas import PROPOSALS
from .crops import MARK
from .providers import ChatAnswer, ProposalProvider, proposal_rows, propose_resiliently
from .sinks import json_schema

if TYPE_CHECKING:
    from ..plans.blueprint import Blueprint, Provider

#: Sends a body: (url, headers, body, timeout in seconds) -> body of the answer. Runs on workers, so it is pickled.
Post = Callable[[str, dict[str, str], bytes, float], bytes]

#: What a description is shown at most, besides the settings' own limits.
TEXT, BLOCKS, CONTROLS = 160, 40, 24
#: Weight of a label's match and of the state's certainty in the choice of controls; fixed values.
MATCH_WEIGHT, STATE_WEIGHT = 0.75, 0.25

_STRING = {"type": "string"}
PROPOSAL_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["proposals"],
    "properties": {"proposals": {"type": "array", "items": {
        "type": "object", "additionalProperties": False, "required": ["path", "rawValue", "evidenceIds"],
        "properties": {"path": _STRING, "rawValue": {"type": ["string", "boolean", "null"]}, "evidenceIds": {"type": "array", "items": _STRING}},
    }}},
}
SYSTEM = "Answer with one JSON object that follows the schema and nothing else. Use only the evidence that is given."
PROPOSE = (
    "Read the form below and propose values for the paths in allowedPaths, no others. A text value is copied letter by letter from the evidence it cites; "
    "labels may be in any language, values are never translated or corrected. For a control_option the value is true or false, judged by the marks on the image; "
    "detected states may be wrong. Where valuePart asks for a part of a name, copy that part of the one text that holds it. Cite evidence ids for each value, "
    "imageEvidenceId where the image decides. Leave out what can't be seen.\nEvidence: "
)
DESCRIBE = (
    "Describe the page below as a document: its type and whether that matches expectedDocumentType, languages, handwriting and how legible it is, regions, groups of controls, "
    "defects of the image and the enhancements that would help. Name printed labels only, never what was filled in. Boxes are pixels.\nEvidence: "
)


def http_post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> bytes:
    """POST without proxies: endpoints are local."""
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
    with opener.open(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
        return reply.read()


def read_answer(reply: bytes) -> ChatAnswer:
    """The text of a chat completion; one that isn't JSON of that shape is an empty answer, which can't be decoded."""
    try:
        choice = json.loads(reply)["choices"][0]
        text = choice["message"]["content"]
        return ChatAnswer("" if text is None else text, choice.get("finish_reason") == "length")
    except (ValueError, LookupError, TypeError, AttributeError):
        return ChatAnswer("")


@dataclass(frozen=True)
class ChatClient:
    settings: Provider
    post: Post = http_post

    def ask(self, prompt: str, image: bytes | None, schema_name: str, schema: dict[str, Any], max_tokens: int) -> ChatAnswer:
        """One completion. Raises OSError for an error status at once, and when the transport failed 1 + request_retries times."""
        s = self.settings
        content: list[dict[str, Any]] = [{"type": "text", "text": prompt}]
        if image is not None:
            content.append({"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}})
        body = {
            "model": s.model, "temperature": 0, "max_tokens": max_tokens,
            "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": content}],
            "response_format": {"type": "json_schema", "json_schema": {"name": schema_name, "strict": True, "schema": schema}},
        }
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {s.api_key}"}
        for left in range(int(s.request_retries), -1, -1):
            try:
                return read_answer(self.post(f"{s.base_url.rstrip('/')}/chat/completions", headers, json.dumps(body, ensure_ascii=False).encode(), s.timeout_seconds))
            except urllib.error.HTTPError:
                raise
            except (OSError, http.client.HTTPException) as e:
                if not left:
                    raise ConnectionError(safe_error(f"{type(e).__name__}: {e}")) from e
        raise AssertionError


# What is shown of a document.


def _bbox() -> Column:
    return F.array("x1", "y1", "x2", "y2").alias("bbox")


def _listed(rows: DataFrame, name: str, order: list, fields: list, most: int | None = None) -> DataFrame:
    """``name``: an array per job of the fields of its rows in ``order``, the first ``most`` of them."""
    ranked = rows.withColumn("r_", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))
    if most is not None:
        ranked = ranked.where(F.col("r_") <= most)
    return ranked.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name))


def _gathered(jobs: DataFrame, parts: list[DataFrame], column: str) -> DataFrame:
    rows = jobs.select("job_id").distinct()
    for p in parts:
        rows = rows.join(p, "job_id", "left")
    return rows.select("job_id", F.to_json(F.struct(*[c for c in rows.columns if c != "job_id"])).alias(column))


def understanding_ledger(e: Any, images: DataFrame, settings: Provider) -> DataFrame:
    """(job_id, ledger) of what a description is shown of each image: quality, and the first spans, blocks and controls."""
    # An order that blocks don't have is last.
    blocks = _listed(e.blocks, "layout", ["page", F.coalesce("order", F.lit(1_000_000)), "y1", "x1", "id"], ["id", "label", _bbox()], BLOCKS)
    spans = _listed(e.spans, "ocr", ["page", "y1", "x1", "id"], ["id", F.left("text", F.lit(TEXT)).alias("text"), "confidence", _bbox()], int(settings.max_understanding_ocr_spans))
    controls = _listed(e.controls, "controls", ["seq"], ["id", "kind", F.col("state").alias("stateHint"), _bbox()], min(CONTROLS, int(settings.max_controls_per_request)))
    quality = assess_images(images)
    marks = [c for c in quality.columns if c not in ("job_id", "width", "height", "issues", "recommendations")]
    quality = quality.select("job_id", F.struct("width", "height").alias("imageSize"), F.struct(*marks).alias("technicalQuality"))
    return _gathered(images, [quality, spans, blocks, controls], "ledger")


def proposal_ledger(e: Any, jobs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(job_id, ledger) of what proposals are shown: all spans and blocks, and controls whose label resembles an option, with how much it does by path."""
    spans = _listed(e.spans, "ocr", ["seq", "id"], ["id", "text", _bbox()])
    blocks = _listed(e.blocks, "layout", ["seq", "id"], ["id", "label", "content", _bbox()])
    matches = label_matches(e.spans, aliases).groupBy(*KEY, "label_id", "path").agg(F.max("score").alias("score")).groupBy(*KEY, "label_id").agg(F.array_sort(F.collect_list(F.struct("path", "score"))).alias("matches"))
    held = associate_controls(e.controls, e.spans).join(matches, [*KEY, "label_id"])
    controls = _listed(held, "controls", ["y1", "x1", "id"], ["id", "state", F.col("label_id").alias("labelEvidenceId"), _bbox(), F.col("state_confidence").alias("sure"), "matches"])
    return _gathered(jobs, [spans, blocks, controls], "ledger")


def controls_for(controls: list[dict[str, Any]], paths: list[str], most: int) -> list[dict[str, Any]]:
    """The controls to show with a request for ``paths``: best match and certainty first, at most ``most``; ties in reading order."""
    worth = [(MATCH_WEIGHT * max(own) + STATE_WEIGHT * (c.get("sure") or 0.0), c) for c in controls if (own := [m["score"] for m in c["matches"] if m["path"] in paths])]
    ranked = sorted(worth, key=lambda x: (-x[0], x[1]["bbox"][1], x[1]["bbox"][0]))
    return [{k: v for k, v in c.items() if k not in ("sure", "matches")} for _, c in ranked[:most]]


def proposal_prompt(ledger: dict[str, Any], paths: list[str], hints: dict[str, Any], most_controls: int, image_id: str | None, context: Any = None) -> str:
    shown = {
        "allowedPaths": paths, "fieldHints": {p: hints[p] for p in paths if p in hints}, "ocr": ledger.get("ocr") or [], "layout": ledger.get("layout") or [],
        "controls": controls_for(ledger.get("controls") or [], paths, most_controls), "imageEvidenceId": image_id, "documentContext": context,
    }
    return PROPOSE + json.dumps(shown, ensure_ascii=False, separators=(",", ":"))


def description_prompt(ledger: dict[str, Any], document_type: str, anchors: list[str], hints: dict[str, Any]) -> str:
    shown = {"expectedDocumentType": document_type, "expectedAnchors": anchors, "expectedFields": hints} | ledger
    return DESCRIBE + json.dumps(shown, ensure_ascii=False, separators=(",", ":"))


class ChatModel:
    """Proposals and descriptions by a chat model, for FormEngine. ``bind`` makes a provider of one table of evidence."""

    def __init__(self, settings: Provider, blueprint: Blueprint, post: Post = http_post) -> None:
        self.settings, self.blueprint, self.post = settings, blueprint, post

    def _images(self, rows: DataFrame, images: DataFrame | None) -> DataFrame:
        if images is None:
            return rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("channels", "int"), ("data", "binary"))])
        return rows.join(images.select("job_id", "width", "height", "channels", "data"), "job_id", "left")

    def bind(self, e: Any, images: DataFrame | None = None, described: DataFrame | None = None, kind: str = "image") -> ProposalProvider:
        """A provider over evidence, decoded images and descriptions (job_id, u). An image is cited as ``kind``:job."""
        settings, post, hints = self.settings, self.post, self.blueprint.hints(set(self.blueprint.output_paths))
        aliases = self.blueprint.alias_rows(e.spans.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = ChatClient(settings, post)
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    ledger, image = json.loads(row.ledger), None if row.data is None else png(pixels_of(row))
                    context = json.loads(row.context) if isinstance(row.context, str) else None

                    def ask(paths: list[str], ledger=ledger, image=image, context=context, image_id=None if image is None else f"{kind}:{row.shown_as}") -> ChatAnswer:
                        prompt = proposal_prompt(ledger, paths, hints, int(settings.max_controls_per_request), image_id, context)
                        return client.ask(prompt, image, "form_proposals", PROPOSAL_SCHEMA, int(settings.max_tokens))

                    got = propose_resiliently(ask, list(row.paths), int(settings.max_paths_per_request), int(settings.max_proposal_requests))
                    out += proposal_rows(row.job_id, got)
                yield pd.DataFrame(out, columns=["job_id", "pid", "path", "raw", "evidence_ids"])

        def propose(targets: DataFrame) -> DataFrame:
            rows = targets.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))
            rows = self._images(rows.join(proposal_ledger(e, targets, aliases), "job_id"), images)
            rows = rows.join(described.select("job_id", F.to_json("u").alias("context")), "job_id", "left") if described is not None else rows.withColumn("context", F.lit(None).cast("string"))
            # A crop stands for a page under a name of job and block; its evidence id has a colon there.
            return rows.withColumn("shown_as", F.replace("job_id", F.lit(MARK), F.lit(":"))).mapInPandas(run, PROPOSALS)

        return propose

    def understand(self, images: DataFrame, e: Any) -> DataFrame:
        """Replies (job_id, reply) that describe images; a request that failed gives an empty reply."""
        settings, post, b = self.settings, self.post, self.blueprint
        hints = b.hints(set(b.output_paths))
        schema = json_schema(T.StructType.fromDDL(understanding.SCHEMA))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = ChatClient(settings, post)
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    try:
                        prompt = description_prompt(json.loads(row.ledger), b.document_type, b.anchors, hints)
                        answer = client.ask(prompt, png(pixels_of(row)), "document_description", schema, int(settings.understanding_max_tokens))
                        text = answer.text if isinstance(answer.text, str) else json.dumps(answer.text) if isinstance(answer.text, dict) else "".join(p.get("text", "") for p in answer.text)
                    except OSError:
                        text = ""
                    out.append((row.job_id, text))
                yield pd.DataFrame(out, columns=["job_id", "reply"])

        return self._images(understanding_ledger(e, images, settings), images).mapInPandas(run, "job_id string, reply string")
