"""More registered queries: files, streams, plans of work, replies, budgets and settings over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import audit, readiness, regions, understanding
from ..schemas import BLOCKS, CONTROLS, SPANS
from ..sources import chat, crops, evidence, providers, sinks
from ..stages import shared_folder
from ..streaming import ingest
from .catalogue import _BP, _table, query
from .blueprint import Provider
from .forms import BLOCKS as FORM_BLOCKS, forms, portable
from .oracle import _values


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Files.


@query("SELECT r_name AS job_id, length(r_name) + 1 AS length, sha256(r_name || chr(10)) AS sha256 FROM regions", {"regions": "SELECT replace(r_name, ' ', '_') AS r_name FROM region"})
def file_digests(spark, sf_dir):
    """Files scanned as a run takes them in: name, size and digest. One is written for each region."""
    path = _folder(spark, "files")
    named = _table(spark, sf_dir, "region").select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("r_name"))
    for (name,) in named.collect():
        named.where(F.col("r_name") == name).coalesce(1).write.text(f"{path}/{name}")
    rows = evidence.read_images(spark, f"{path}/*/part-*")
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.col("length").cast("int").alias("length"), "sha256")


_SIDE = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events"


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar rows of users, made of their events; every seventh event has an empty box."""
    e = _table(spark, sf_dir, "events")
    wide = F.when(F.col("event_id") % 7 == 0, 5).otherwise(9)
    box = F.struct(F.lit(5).alias("x1"), F.lit(5).alias("y1"), wide.alias("x2"), F.lit(9).alias("y2"))
    item = F.struct("event_id", F.struct(F.lit("old").alias("id"), F.col("event_type").alias("text"), F.lit(0.5).alias("confidence"), box.alias("bbox"), (1 + F.col("event_id") % 2).cast("int").alias("page"), F.lit("x").alias("script"), F.lit("side").alias("source"), F.lit(9).alias("attempt")).alias("s"))
    rows = e.groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("ocrSpans"))
    shape = {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in evidence.SIDECAR.split(", ")}
    none = lambda name: F.from_json(F.lit("[]"), shape[name]).alias(name)
    return rows.select("job_id", "ocrSpans", none("layoutBlocks"), none("controls"))


@query(f"SELECT user_id::VARCHAR AS job_id, 'ocr:p' || (1 + event_id % 2) || ':' || printf('%04d', i) AS id, event_type AS text, 0 AS attempt FROM ({_SIDE}) WHERE event_id % 7 > 0")
def sidecar_scan(spark, sf_dir):
    """Spans of sidecar rows, renamed by their place, with the attempt of the scan."""
    return evidence.sidecar_evidence(_sidecars(spark, sf_dir))[0].select("job_id", "id", "text", "attempt")


@query(f"SELECT user_id::VARCHAR AS job_id, 'ocrSpans' AS kind, i::BIGINT AS seq, 'invalid_box' AS reason FROM ({_SIDE}) WHERE event_id % 7 = 0")
def sidecar_rejects(spark, sf_dir):
    return evidence.sidecar_rejects(_sidecars(spark, sf_dir))


@query("SELECT r_name AS job_id, 'ocr:p1:0000' AS id, r_regionkey::VARCHAR AS text FROM region")
def sidecar_files(spark, sf_dir):
    """The same from files: a JSON document for each region, named after it."""
    path = _folder(spark, "sidecars")
    for r in _table(spark, sf_dir, "region").collect():
        doc = f'{{"ocrSpans": [{{"text": "{r["r_regionkey"]}", "confidence": 1.0, "bbox": {{"x1": 0, "y1": 0, "x2": 2, "y2": 2}}}}]}}'
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(f"{path}/{r['r_name']}")
    rows = spark.read.schema(evidence.SIDECAR).json(f"{path}/*/part-*", multiLine=True).withColumn("job_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return evidence.sidecar_evidence(rows.withColumn("job_id", F.replace("job_id", F.lit("%20"), F.lit(" "))))[0].select("job_id", "id", "text")


@query("SELECT * FROM (SELECT 'spans' AS kind, 0 AS n UNION ALL SELECT 'blocks', 0 UNION ALL SELECT 'controls', 0)")
def empty_scans(spark, sf_dir):
    """Recognisers that are switched off give tables of the right shape without rows."""
    found = [evidence.empty(spark, kind).groupBy().agg(F.lit(kind).alias("kind"), F.count("*").cast("int").alias("n")) for kind in ("spans", "blocks", "controls")]
    assert [evidence.empty(spark, k).columns for k in ("spans", "blocks", "controls")] == [[c.strip().split(" ")[0].strip("`") for c in s.split(",")] for s in (SPANS, BLOCKS, CONTROLS)]
    return found[0].union(found[1]).union(found[2])


@query("SELECT user_id AS job_id, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY user_id")
def stream_ingest(spark, sf_dir):
    """Files that drop into a folder go through a stream once, though it is started twice."""
    path, out, checkpoint = (_folder(spark, n) for n in ("drop", "out", "stream"))
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    e.repartition(4, "user_id").write.json(path)
    files = spark.readStream.schema(e.schema).json(path)
    for _ in range(2):
        ingest.run_stream(files, lambda batch: batch.select("user_id", "event_type"), out, checkpoint).awaitTermination()
    return spark.read.parquet(f"{out}/batch=*").groupBy(F.col("user_id").alias("job_id")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT user_id::VARCHAR AS run_id, event_type AS node, count(*)::BIGINT AS written FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_trace(spark, sf_dir):
    """Steps streamed into a trace, from two streams of the same files: each event is there once."""
    path, out = _folder(spark, "steps"), _folder(spark, "trace")
    e = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("node"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("input_hash"), F.lit("ok").alias("status"), F.col("event_id").cast("double").alias("at"))
    e.repartition(3).write.parquet(path)
    for n in range(2):
        ingest.stream_trace(spark.readStream.schema(e.schema).parquet(path), out, _folder(spark, f"check{n}")).awaitTermination()
    return spark.read.parquet(out).groupBy("run_id", "node").agg(F.count("*").alias("written"))


@query("SELECT user_id AS job_id, max(value) AS value FROM events GROUP BY user_id")
def durable_run(spark, sf_dir):
    """A stage written by a run and read again by a run of the same folder, whose own computation isn't asked for."""
    from .runs import Run

    folder = _folder(spark, "run")
    rows = lambda: _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("value").alias("value"))
    Run(spark, folder).stage("map", rows)

    def never() -> DataFrame:
        raise AssertionError("a stage that was written is computed again")

    return Run(spark, folder).stage("map", never)


# Plans of work.


@query("SELECT user_id AS job_id, coalesce(round(avg(CASE WHEN event_type = 'click' THEN value END), 6), 0.0) AS mean FROM events GROUP BY user_id")
def stage_mean(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "click", F.col("value")).alias("value"))
    return audit.stage_mean(rows, "value").select("job_id", F.round("mean", 6).alias("mean"))


_SUGGESTED = "CASE o_orderkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['clahe', 'deskew'] WHEN 2 THEN ['illumination_normalization'] ELSE ['upscale', 'unknown', 'upscale'] END"
_ADVISED = "CASE o_orderkey % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['review', 'upscale'] WHEN 2 THEN ['deskew', 'clahe', 'denoise_sharpen', 'upscale'] WHEN 3 THEN ['illumination_normalization'] ELSE ['clahe'] END"


def _advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = lambda sql: sql.replace("[]::VARCHAR[]", "array()").replace("[", "array(").replace("]", ")")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr(array(_SUGGESTED)).cast("array<string>").alias("suggested"), F.expr(array(_ADVISED)).cast("array<string>").alias("recommendations"))


@query(f"SELECT o_orderkey AS job_id, array_to_string(list_filter({_ADVISED}, lambda a: a IN ('upscale', 'denoise_sharpen', 'clahe', 'illumination_normalization', 'deskew'))[1:3], '+') AS actions FROM orders")
def planned_actions(spark, sf_dir):
    return _advice(spark, sf_dir).select("job_id", F.array_join(readiness.planned_actions(F.col("recommendations")), "+").alias("actions"))


_ORDERED = f"SELECT o_orderkey AS job_id, list_filter(['deskew', 'illumination_normalization', 'clahe', 'denoise_sharpen', 'upscale'], lambda a: list_contains({_SUGGESTED}, a) OR list_contains(list_filter({_ADVISED}, lambda b: b <> 'review')[1:3], a)) AS o FROM orders"


@query(
    "SELECT * FROM (SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY pos) - 1)::INT AS variant, actions FROM (SELECT job_id, actions, min(pos) AS pos FROM (SELECT job_id, unnest(v) AS actions, generate_subscripts(v, 1) AS pos FROM all_variants) GROUP BY job_id, actions)) WHERE variant < 3",
    {"ordered_": _ORDERED, "all_variants": "SELECT job_id, list_concat(CASE WHEN len(o) > 1 THEN [array_to_string(o[1:3], '+')] ELSE [] END, list_transform(o, lambda a: CASE WHEN a = 'illumination_normalization' THEN a || '+clahe' ELSE a END)) AS v FROM ordered_"},
)
def variant_plans(spark, sf_dir):
    """Pages to try for each order's suggestions and advice: all actions together, then one by one."""
    return readiness.variant_rows(_advice(spark, sf_dir)).select("job_id", "variant", F.array_join("actions", "+").alias("actions"))


_ASKED = "CASE o_orderkey % 4 WHEN 0 THEN ['upscale', 'clahe'] WHEN 1 THEN ['checkbox_focus', 'upscale', 'review'] WHEN 2 THEN ['adaptive_binarize'] ELSE ['denoise_sharpen', 'checkbox_focus'] END"


@query(
    "SELECT job_id, array_to_string(CASE WHEN list_contains(a, 'upscale') THEN a ELSE list_prepend('upscale', a) END, '+') AS actions FROM acted",
    {"acted": f"""SELECT job_id, CASE WHEN boxes THEN CASE WHEN list_contains(b, 'checkbox_focus') THEN b ELSE list_prepend('checkbox_focus', b) END ELSE CASE WHEN list_contains(s, 'clahe') THEN s ELSE list_append(s, 'clahe') END END AS a
        FROM (SELECT o_orderkey AS job_id, o_orderkey % 3 = 0 AS boxes, list_filter({_ASKED}, lambda x: x <> 'review') AS b, list_filter({_ASKED}, lambda x: x NOT IN ('adaptive_binarize', 'checkbox_focus', 'review')) AS s FROM orders)"""},
)
def crop_actions(spark, sf_dir):
    """What is done with a crop, by what was asked for and whether it shows boxes only."""
    asked = F.expr(_ASKED.replace("[", "array(").replace("]", ")"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), asked.alias("asked"))
    return rows.select("job_id", F.array_join(regions.task_actions(F.col("asked"), F.col("job_id") % 3 == 0), "+").alias("actions"))


_PLANNED = """SELECT job_id, 'data.serialNumber' AS path, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, 'upscale+clahe' AS actions, CASE WHEN job_id::BIGINT % 2 = 0 THEN 'source_conflict' ELSE 'below_accept_threshold' END AS reasons FROM spans WHERE id IN ('l0', 'v0') AND job_id::BIGINT % 5 > 0 GROUP BY job_id
    UNION ALL SELECT job_id, 'data.baby.male', x1, y1, x2, y2, 'checkbox_focus+upscale', 'below_accept_threshold' FROM controls WHERE id = 'c0'"""


@query(_PLANNED)
def recovery_plans(spark, sf_dir):
    """Plans for fields to retry: the box around a serial number's label and value, and around a check box."""
    spans, blocks, controls = forms(spark, sf_dir)
    k = F.col("job_id").cast("long")
    none, jobs = F.array().cast("array<string>"), controls.select("job_id").distinct()
    serial = jobs.where(k % 5 > 0).select("job_id", F.lit("data.serialNumber").alias("path"), F.lit(0).alias("ord"), F.lit("retry").alias("disposition"), F.array(F.lit("l0"), F.lit("v0")).alias("evidence_ids"), F.when(k % 2 == 0, F.array(F.lit("source_conflict"))).otherwise(none).alias("reasons"))
    male = jobs.select("job_id", F.lit("data.baby.male"), F.lit(5), F.lit("retry"), F.array(F.lit("c0")), none)
    done = jobs.select("job_id", F.lit("data.baby.firstName"), F.lit(1), F.lit("accepted"), F.array(F.lit("v1")), none)
    plans = regions.plan_recovery(serial.union(male).union(done), audit.evidence_ledger(spans, blocks, controls))
    return plans.select("job_id", "path", "x1", "y1", "x2", "y2", F.array_join("actions", "+").alias("actions"), F.array_join("reasons", "+").alias("reasons"))


_TASKED = "SELECT o_orderkey::VARCHAR AS job_id, 'b' || (o_orderkey % 3) AS block_id, unnest(['data.serialNumber', 'data.baby.firstName', 'data.baby.birthWeight']) AS path, unnest(['evidence', 'label', 'search']) AS how FROM orders"


@query(
    "SELECT t.job_id, t.block_id, t.path, t.how FROM tasked t WHERE NOT (t.path = 'data.serialNumber' AND t.job_id::BIGINT % 2 = 0) AND (t.how <> 'search' OR 0.70::DOUBLE + (t.job_id::BIGINT % 4) * 0.05::DOUBLE >= 0.78::DOUBLE)",
    {"tasked": _TASKED},
)
def crop_proposals(spark, sf_dir):
    """Paths to ask about for a crop: unresolved, and placed by evidence or label or seen in it."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("job_id"))
    block = F.concat(F.lit("b"), (F.col("k") % 3).cast("string")).alias("block_id")
    tasks = o.select("job_id", block, F.array(*map(F.lit, ("data.serialNumber", "data.baby.firstName", "data.baby.birthWeight"))).alias("paths"), F.array(*map(F.lit, ("evidence", "label", "search"))).alias("reasons"))
    solved = o.where("k % 2 = 0").select("job_id", F.lit("data.serialNumber").alias("path"), F.lit("x").alias("value"))
    seen = o.select("job_id", block, F.lit("data.baby.birthWeight").alias("path"), (0.70 + (F.col("k") % 4) * 0.05).alias("score"))
    return regions.crop_proposal_targets(tasks, solved, seen)


# Replies, budgets, names.

_HAND = "CASE o_orderkey % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' WHEN 2 THEN 'poor' WHEN 3 THEN 'not_present' ELSE 'unreadable' END"


@query(f"""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unreadable' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 3 THEN 'handwriting_inconsistent' END AS error,
    CASE WHEN o_orderkey % 7 > 0 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 = 3) THEN CASE WHEN o_orderkey % 2 = 0 THEN {_HAND} ELSE 'not_present' END END AS handwriting,
    o_orderkey % 7 > 0 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 = 3) AND o_orderkey % 11 = 0 AS mismatch,
    CASE WHEN o_orderkey % 7 > 0 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 = 3) THEN 'moderate' ELSE '' END AS severities,
    CASE WHEN o_orderkey % 7 > 0 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 = 3) THEN 'clahe+deskew' ELSE '' END AS actions FROM orders""")
def understood_replies(spark, sf_dir):
    """Replies of a model that describe a page: some without JSON, some that contradict themselves."""
    k = F.col("o_orderkey")
    hand = F.expr(_HAND)
    page = F.to_json(F.struct(F.lit("order_form").alias("detectedDocumentType"), F.when(k % 11 == 0, "mismatch").otherwise("match").alias("schemaMatch"), (k % 2 == 0).alias("handwritingPresent"), hand.alias("handwritingLegibility"),
                              F.array(F.struct(F.lit("blur").alias("kind"), F.lit("moderate").alias("severity"))).alias("qualityIssues"), F.array(F.lit("local_contrast"), F.lit("none"), F.lit("deskew")).alias("recommendedProfiles")))
    replies = _table(spark, sf_dir, "orders").select(k.alias("job_id"), F.when(k % 7 == 0, F.lit("sorry, no")).otherwise(F.concat(F.lit("Here it is: "), page)).alias("reply"))
    rows = understanding.understood(understanding.decode_understanding(replies))
    return rows.select("job_id", "error", "handwriting", "mismatch", F.array_join("severities", "+").alias("severities"), F.array_join("actions", "+").alias("actions"))


_PARTS = "SELECT p_partkey AS k, 2 + p_partkey % 6 AS paths, p_partkey % 4 AS bad FROM part"


@query(f"""SELECT k AS job_id, CASE bad WHEN 0 THEN 0 ELSE least(paths, 8) END AS proposals, CASE bad WHEN 0 THEN ceil(paths / 4.0)::INT ELSE ceil(paths / 4.0)::INT END AS requests,
    CASE bad WHEN 0 THEN ceil(paths / 4.0)::INT ELSE 0 END AS warnings FROM ({_PARTS})""")
def proposal_requests(spark, sf_dir):
    """Requests of a chat provider within its budget; every fourth endpoint can't be reached, which isn't asked again."""

    def run(frames):
        import json

        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                names = [f"data.p{i}" for i in range(row.paths)]

                def ask(batch, down=row.bad == 0):
                    if down:
                        raise ConnectionError("refused")
                    return providers.ChatAnswer("noted: " + json.dumps({"proposals": [{"path": p, "rawValue": "x", "evidenceIds": ["e"]} for p in batch]}))

                got = providers.propose_resiliently(ask, names, 4, 2)
                out.append((row.k, len(got.proposals), got.requests, len(got.warnings)))
            yield pd.DataFrame(out, columns=["job_id", "proposals", "requests", "warnings"])

    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (2 + F.col("p_partkey") % 6).cast("int").alias("paths"), (F.col("p_partkey") % 4).cast("int").alias("bad"))
    return rows.mapInPandas(run, "job_id long, proposals int, requests int, warnings int")


@query("SELECT doc_id, left(trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g')), 240) AS message FROM documents")
def squeezed_errors(spark, sf_dir):
    """Texts as error messages: on one line, 240 characters at most, which is the operator's own limit."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.squeezed_error(F.col("text")).alias("message"))


@query("SELECT p_partkey, list_transform(string_split(lower(replace(p_type, ' ', '_')), '_'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END).list_aggregate('string_agg', '') AS name FROM part")
def camel_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.camel(F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("name"))


_ALL = [(p, i, s.critical or s.required, False) for i, (p, s) in enumerate(_BP.fields.items())]
_ALL += [(o.output_path, len(_ALL) + i, False, True) for i, (_, _, o) in enumerate(_BP.options())]


@query(_values(_ALL, "path, ord, critical, checkbox"))
def path_sets(spark, sf_dir):
    """Output, critical and check box paths of the forms' blueprint, in file order."""
    return _BP.path_rows(spark).select("path", "ord", "critical", "checkbox")


@query(_values([("data.serialNumber", "serial number"), ("data.serialNumber", "serial no"), ("data.baby.firstName", "first name"), ("data.baby.firstName", "given name"), ("data.baby.sample.collection.date", "collection date"), ("data.baby.birthWeight", "birth weight"), ("data.baby.dateOfBirth", "date of birth"), ("data.baby.male", "sexo"), ("data.baby.male", "masculino"), ("data.baby.female", "sexo"), ("data.baby.female", "feminino")], "path, alias"))
def label_aliases(spark, sf_dir):
    """What a path's printed label may be; an option's includes its group's."""
    return _BP.label_alias_rows(spark)


@query("SELECT * FROM (SELECT 'job_id' AS name, 'string' AS kind UNION ALL SELECT 'data', 'object' UNION ALL SELECT 'meta', 'object')")
def envelope_schema(spark, sf_dir):
    """The exported JSON Schema of the result: its properties and their types."""
    from pyspark.sql import types as T

    blank = spark.createDataFrame([], "job_id string, path string, value string, raw string, score double, disposition string, reasons array<string>, evidence_ids array<string>")
    found = sinks.json_schema(T.StructType(audit.envelopes(blank, _BP.output_paths).schema.fields))
    assert found["additionalProperties"] is False
    kind = lambda t: next(x for x in ([t] if isinstance(t, str) else t) if x != "null")
    return spark.createDataFrame([(n, kind(s["type"])) for n, s in found["properties"].items()], "name string, kind string")


# Requests, crops, layouts.

_SHOWN = [("data.serialNumber", 0, "lm"), ("data.baby.firstName", 1, "lm"), ("data.baby.birthWeight", 3, "lm"), ("data.baby.male", 5, "lm"), ("data.baby.female", 6, "lf")]


def _echo(url, headers, body, timeout):
    """A model that answers each path with how much it was shown, and cites the first text."""
    import json

    shown = json.loads(json.loads(body)["messages"][1]["content"][0]["text"].split("Evidence: ", 1)[1])
    seen = f"{len(shown['ocr'])}/{len(shown['layout'])}/{'+'.join(c['id'] for c in shown['controls'])}"
    answer = {"proposals": [{"path": p, "rawValue": seen, "evidenceIds": [shown["ocr"][0]["id"]]} for p in shown["allowedPaths"]]}
    return json.dumps({"choices": [{"message": {"content": json.dumps(answer)}, "finish_reason": "stop"}]}).encode()


@query(f"""SELECT s.job_id, p.path, s.n || '/' || b.n || '/' || a.id AS raw, s.first AS cited FROM (SELECT job_id, count(*) AS n, min_by(id, seq) AS first FROM spans GROUP BY job_id) s
    JOIN (SELECT job_id, count(*) AS n FROM blocks GROUP BY job_id) b ON b.job_id = s.job_id CROSS JOIN ({_values(_SHOWN, "path, ord, label")}) p JOIN assoc a ON a.job_id = s.job_id AND a.label_id = p.label""")
def chat_requests(spark, sf_dir):
    """Requests of four paths and of one for each form: all its texts and blocks are shown, and the controls of the options asked for."""
    from ..plans.engine import Evidence

    spans, blocks, controls = forms(spark, sf_dir)
    targets = spans.select("job_id").distinct().join(spark.createDataFrame([a[:2] for a in _SHOWN], "path string, ord int"))
    ask = chat.ChatModel(Provider(), _BP, _echo).bind(Evidence(spans, blocks, controls))
    return ask(targets).select("job_id", "path", "raw", F.element_at("evidence_ids", 1).alias("cited"))


def _measure(pixels):
    """A recogniser that reads a crop's size and level, and fails on every tenth level."""
    level = int(pixels[0, 0, 0])
    if level % 10 == 0:
        raise ValueError("no text")
    return [{"text": f"{pixels.shape[1]}x{pixels.shape[0]}:{level}", "confidence": 0.9, "x1": 2, "y1": 2, "x2": 8, "y2": 6}]


_CUT = """SELECT *, level % 10 > 0 AS good FROM (SELECT p_partkey::VARCHAR AS job_id, 20 + p_partkey % 200 AS level, unnest(['a', 'b', 'page']) AS block_id, unnest([1, 3, 1]) AS s,
    unnest([greatest(0, p_partkey % 7 - 3), 27, 0]) AS cx1, unnest([1, 17, 0]) AS cy1, unnest([p_partkey % 7 + 23, 60, 60]) AS cx2, unnest([19, 40, 40]) AS cy2 FROM part)"""


@query(
    """SELECT job_id, block_id, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, CASE WHEN good THEN 1 ELSE 2 END AS attempts, CASE WHEN good THEN (cx2 - cx1) * s || 'x' || (cy2 - cy1) * s || ':' || level END AS text,
    CASE WHEN good THEN cx1 + round_even(2.0 / s, 0)::INT END AS x1, CASE WHEN good THEN cy1 + round_even(2.0 / s, 0)::INT END AS y1, CASE WHEN good THEN cx1 + round_even(8.0 / s, 0)::INT END AS x2, CASE WHEN good THEN cy1 + round_even(6.0 / s, 0)::INT END AS y2 FROM cut""",
    {"cut": _CUT},
)
def crop_readings(spark, sf_dir):
    """Crops of a small page for each part, one as it is, one upscaled and beyond the page's edge, and the page: read, with texts on the page's pixels."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("job_id"))
    level = F.lpad(F.hex((20 + F.col("k") % 200).cast("int")), 2, "0")
    images = p.select("job_id", F.lit(60).alias("width"), F.lit(40).alias("height"), F.lit(3).alias("channels"), F.unhex(F.repeat(level, F.lit(60 * 40 * 3))).alias("data"))
    none, i = F.lit(None).cast("int"), lambda c: c.cast("int")
    plain = F.array().cast("array<string>")
    a = p.select("job_id", F.lit("a").alias("block_id"), F.lit(1).alias("page"), i(F.col("k") % 7).alias("x1"), F.lit(4).alias("y1"), i(F.col("k") % 7 + 20).alias("x2"), F.lit(16).alias("y2"), plain.alias("actions"))
    b = p.select("job_id", F.lit("b"), F.lit(1), F.lit(30), F.lit(20), F.lit(58), F.lit(38), F.array(F.lit("upscale")))
    whole = p.select("job_id", F.lit("page"), F.lit(1), none, none, none, none, plain)
    read = crops.read_crops(crops.cut_crops(images, a.union(b).union(whole), 3), _measure)
    found = crops.crop_spans(read, 0, "ocr:layout_crop").select("job_id", "block_id", "text", "x1", "y1", "x2", "y2")
    return read.select("job_id", "block_id", "status", "attempts").join(found, ["job_id", "block_id"], "left")


_BOXED = "CASE WHEN id = 'fig' THEN {} ELSE {} END AS {}"


@query(
    """SELECT e.job_id, e.id AS block_id, e.label, coalesce(m.ids, '') AS span_ids, coalesce(c.ids, '') AS control_ids FROM elig e
    LEFT JOIN (SELECT m.job_id, m.block_id, string_agg(s.id, '+' ORDER BY s.seq) AS ids FROM memb m JOIN spans s ON s.job_id = m.job_id AND s.id = m.item_id GROUP BY ALL) m ON m.job_id = e.job_id AND m.block_id = e.id
    LEFT JOIN (SELECT c.job_id, b.id AS block_id, string_agg(c.id, '+' ORDER BY c.seq) AS ids FROM controls c JOIN blocks b ON b.job_id = c.job_id AND (c.x1 + c.x2) / 2.0 BETWEEN b.x1 AND b.x2 AND (c.y1 + c.y2) / 2.0 BETWEEN b.y1 AND b.y2 GROUP BY ALL) c ON c.job_id = e.job_id AND c.block_id = e.id""",
    {"blocks": f"SELECT * REPLACE ({_BOXED.format(chr(39) + 'form' + chr(39), 'label', 'label')}, {_BOXED.format(820, 'y1', 'y1')}, {_BOXED.format(900, 'y2', 'y2')}) FROM ({portable(FORM_BLOCKS)})"},
)
def layout_records(spark, sf_dir):
    """What each block of a form holds, the boxes' block included."""
    spans, blocks, controls = forms(spark, sf_dir)
    boxed = F.col("id") == "fig"
    blocks = blocks.withColumns({"label": F.when(boxed, "form").otherwise(F.col("label")), "y1": F.when(boxed, 820).otherwise(F.col("y1")), "y2": F.when(boxed, 900).otherwise(F.col("y2"))})
    blocks = regions.eligible_blocks(blocks)
    rows = audit.layout_records(blocks, spans, controls, regions.region_members(spans, blocks), regions.region_members(controls, blocks))
    return rows.select("job_id", "block_id", "label", F.array_join("span_ids", "+").alias("span_ids"), F.array_join("control_ids", "+").alias("control_ids"))
