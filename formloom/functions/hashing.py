"""Digests, canonical JSON and stable identifiers."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, functions as F


def text_sha256(v: Column) -> Column:
    return F.sha2(v.cast("binary"), 256)


def event_id(run_id: Column, node: Column, attempt: Column, input_hash: Column) -> Column:
    """24 hex digits that name a step of a run; the same step has the same id when it is repeated."""
    return F.left(F.sha2(F.concat_ws("|", run_id, node, attempt.cast("string"), F.coalesce(input_hash, F.lit("-"))), 256), F.lit(24))


def ordinal_id(prefix: Column, page: Column, ordinal: Column) -> Column:
    return F.format_string("%s:p%d:%04d", prefix, page, ordinal)


def json_literal(value: Column, kind: Column) -> Column:
    """A scalar as a JSON literal: booleans bare, other values quoted."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), F.lit("null")).when((kind == "boolean") & value.isin("true", "false"), value).otherwise(quoted)


def fingerprint(norm_json: Column) -> Column:
    return F.sha2(norm_json.cast("binary"), 256)


def canonical_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha256_json(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
