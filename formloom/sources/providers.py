"""Provider interfaces: recognisers and models plug in as functions of DataFrames.

Models are not bundled. A provider runs in mapInPandas, holds its model once per
worker, and reports failures as rows, so that one bad crop doesn't fail a task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import safe_error
from ..schemas import PROPOSALS


class EvidenceProvider(Protocol):
    """Reads images (job_id, content, ...) and returns rows of its kind of evidence."""

    def __call__(self, images: DataFrame, attempt: int) -> DataFrame: ...


class ProposalProvider(Protocol):
    """Answers targets (job_id, path, batch) with proposals."""

    def __call__(self, targets: DataFrame) -> DataFrame: ...


class ProviderError(RuntimeError):
    """A provider is missing or was set up wrongly; the message says what to install or change."""


_FACTORIES: dict[str, Callable[..., Any]] = {}
_WORKERS: dict[tuple, Any] = {}


def register(name: str, factory: Callable[..., Any]) -> None:
    _FACTORIES[name] = factory


def lookup(name: str) -> Callable[..., Any]:
    if name not in _FACTORIES:
        raise ProviderError(f"no provider named {name!r}; register one, or switch the engine off. Known: {sorted(_FACTORIES)}")
    return _FACTORIES[name]


def worker_model(key: tuple, build: Callable[[], Any]) -> Any:
    """A model held once per Python worker."""
    if key not in _WORKERS:
        _WORKERS[key] = build()
    return _WORKERS[key]


def attempted(call: Callable[[], Any], retries: int) -> tuple[Any, str | None, int]:
    """What ``call`` returns, the error of the last of 1 + ``retries`` tries if all failed, and the number of tries."""
    error = None
    for tries in range(1, retries + 2):
        try:
            return call(), None, tries
        except Exception as e:  # a crop's failure is its own
            error = safe_error(f"{type(e).__name__}: {e}")
    return None, error, retries + 1


def recognise_crops(crops: DataFrame, recognise: Callable[[Any], list[dict[str, Any]]], retries: int = 1) -> DataFrame:
    """Run ``recognise`` on each crop (job_id, block_id, payload); each is tried 1 + ``retries`` times by itself.

    Returns job_id, block_id, status, attempts, error and the found spans in crop pixels.
    """
    schema = "job_id string, block_id string, status string, attempts int, error string, spans array<struct<text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                found, error, tries = attempted(lambda row=row: list(recognise(row.payload)), retries)
                out.append((row.job_id, row.block_id, "failed" if error else "ok", tries, error, found or []))
            yield pd.DataFrame(out, columns=["job_id", "block_id", "status", "attempts", "error", "spans"])

    return crops.select("job_id", "block_id", "payload").mapInPandas(run, schema)


def table_proposals(answers: DataFrame) -> ProposalProvider:
    """A provider that answers from a table of proposals (job_id, pid, path, raw, evidence_ids)."""

    def propose(targets: DataFrame) -> DataFrame:
        return answers.join(targets.select("job_id", "path").distinct(), ["job_id", "path"], "left_semi").select("job_id", "pid", "path", "raw", "evidence_ids")

    return propose


@dataclass
class Budget:
    """Requests left."""

    left: int

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


@dataclass
class ChatAnswer:
    text: str
    truncated: bool = False


@dataclass
class ProposalResult:
    proposals: list[dict[str, Any]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    requests: int = 0


def decode_reply(text: Any) -> dict[str, Any]:
    """The first JSON object of a model's reply, which may be parts or have text around it."""
    if isinstance(text, dict):
        return text
    if isinstance(text, list):
        text = "".join(p.get("text", "") for p in text if isinstance(p, dict))
    at = text.find("{")
    if at < 0:
        raise ValueError("no JSON object in the reply")
    return json.JSONDecoder().raw_decode(text[at:])[0]


def propose_resiliently(ask: Callable[[list[str]], ChatAnswer], paths: list[str], per_request: int = 4, requests: int = 4) -> ProposalResult:
    """Ask for paths in batches; a truncated or unreadable reply is asked again in halves, within the budget.

    Transport errors become warnings and are not split. Proposals for paths that weren't asked for become warnings.
    """
    result, budget = ProposalResult(), Budget(requests)
    paths = list(dict.fromkeys(paths))
    queue = [paths[i : i + per_request] for i in range(0, len(paths), per_request)]
    while queue:
        batch = queue.pop(0)
        if not budget.take():
            left = [p for b in [batch, *queue] for p in b]
            result.warnings.append(f"proposal_budget_exhausted:{len(left)}")
            break
        result.requests += 1
        try:
            answer = ask(batch)
        except OSError as e:
            result.warnings.append(f"proposal_request_failed:{safe_error(str(e))}")
            continue
        try:
            if answer.truncated:
                raise ValueError("truncated")
            found = decode_reply(answer.text).get("proposals") or []
        except (ValueError, AttributeError):
            if len(batch) > 1:
                half = (len(batch) + 1) // 2
                queue[:0] = [batch[:half], batch[half:]]
            else:
                result.warnings.append(f"proposal_unreadable:{batch[0]}")
            continue
        for p in found:
            if p.get("path") in batch and p.get("evidenceIds"):
                result.proposals.append(p)
            else:
                result.warnings.append(f"proposal_outside_request:{p.get('path')}")
    return result


def proposal_rows(job_id: str, got: ProposalResult) -> list[tuple]:
    """PROPOSALS rows of a job's answers; a warning is a row without a path."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = [(job_id, i, p["path"], text(p.get("rawValue")), p["evidenceIds"]) for i, p in enumerate(got.proposals)]
    return rows + [(job_id, len(rows) + i, None, w, []) for i, w in enumerate(got.warnings)]


def chat_proposals(make_ask: Callable[[str], Callable[[list[str]], ChatAnswer]], per_request: int = 4, requests: int = 4) -> ProposalProvider:
    """A provider around a chat model: ``make_ask(job_id)`` runs on the worker and returns the function that sends one request."""

    def propose(targets: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    got = propose_resiliently(make_ask(row.job_id), list(row.paths), per_request, requests)
                    out += proposal_rows(row.job_id, got)
                yield pd.DataFrame(out, columns=["job_id", "pid", "path", "raw", "evidence_ids"])

        rows = targets.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))
        return rows.mapInPandas(run, PROPOSALS)

    return propose


def prompt_payload(spans: DataFrame, blocks: DataFrame, most_spans: int = 80, most_blocks: int = 40) -> DataFrame:
    """What a prompt shows of a page: the first spans and blocks in reading order, texts cut to 160 characters."""
    from pyspark.sql import Window

    def first(rows: DataFrame, order: list, most: int, text: str, name: str) -> DataFrame:
        ranked = rows.withColumn("r_", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).where(F.col("r_") <= most)
        item = F.struct("r_", "id", F.left(text, F.lit(160)).alias("text"), "x1", "y1", "x2", "y2")
        return ranked.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias(name))

    s = first(spans, ["page", "y1", "x1", "id"], most_spans, "text", "ocrSpans")
    b = first(blocks, ["page", F.coalesce("order", F.lit(1_000_000)), "y1", "x1", "id"], most_blocks, "content", "layoutBlocks")
    rows = s.join(b, "job_id", "full")
    return rows.select("job_id", F.to_json(F.struct("ocrSpans", "layoutBlocks")).alias("payload"))
