"""From spans and controls to field candidates: label matches, neighbours, associations.

All joins are equi-joins on (job_id, page) with a residual predicate, so a job's
evidence meets only its own page. Alias scores are computed once for each
distinct canonical text, not for each span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import Box
from ..functions.hashing import json_literal
from ..functions.normalize import normalize_value
from ..functions.text import canonical_text, direct_alias_score, group_alias_score, ratio_bound, same_line_suffix, seq_ratio, value_part
from ..stages import once, small, staged

KEY = ("job_id", "page")
#: What candidates of the control detector are called.
DETECTOR, DETECTOR_SOURCE = "opencv_control", "opencv"
FIELD_MATCH, GROUP_MATCH, OPTION_MATCH, LABEL_LIKE, STRONG = 0.78, 0.90, 0.76, 0.93, 0.78


def alias_scores(texts: DataFrame, aliases: DataFrame, least: float | Column, ratio: bool = True) -> DataFrame:
    """The best score of each distinct canonical text for each (path, kind), from ``least`` on, which may depend on the kind: canon, path, kind, score, plain.

    ``texts`` has one column ``canon``; ``aliases`` is a blueprint's table, which the configuration bounds, so that it may be
    broadcast. ``plain`` leaves out that a group label may be a prefix. The ratio is computed only for pairs
    that neither match nor contain each other and whose lengths and characters allow the score.
    """
    table = aliases.select("path", "kind", canonical_text(F.col("alias")).alias("target")).where("target <> ''").distinct()
    pairs = texts.where("canon is not null").distinct().join(F.broadcast(table))
    n, t = F.col("canon"), F.col("target")
    pairs = pairs.withColumns({"direct": direct_alias_score(n, t), "prefix": F.when(F.col("kind") == "group", group_alias_score(n, t))})
    scored = pairs.where("direct is not null").withColumn("plain", F.col("direct"))
    if ratio:  # rows that are settled go round the Python function
        scored = scored.union(pairs.where(F.col("direct").isNull() & (ratio_bound(n, t) >= least)).withColumn("plain", seq_ratio(n, t)))
    scored = scored.withColumn("score", F.greatest("plain", "prefix"))
    return scored.where(F.col("score") >= least).groupBy("canon", "path", "kind").agg(F.max("score").alias("score"), F.max("plain").alias("plain"))


def with_canon(spans: DataFrame) -> DataFrame:
    return spans.select("*", once(canonical_text(F.col("text")), "canon"))


def label_scores(spans: DataFrame, aliases: DataFrame, ratio: bool = True) -> DataFrame:
    """Scores of a set of spans' texts for all field and group labels; one small table, staged for the joins that follow."""
    return staged(alias_scores(with_canon(spans).select("canon"), aliases.where("kind in ('field', 'group')"), FIELD_MATCH, ratio))


def all_scores(spans: DataFrame, aliases: DataFrame, ratio: bool = True) -> DataFrame:
    """label_scores() and those of options in one: each distinct text is gathered and looked at once."""
    return staged(alias_scores(with_canon(spans).select("canon"), aliases, F.when(F.col("kind") == "option", OPTION_MATCH).otherwise(FIELD_MATCH), ratio))


def label_hits(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """Spans that are labels of a path: all span columns with path, kind and match.

    A few label texts may be half of all spans, and they are few as a rule: spans stay where they are unless there are many.
    """
    good = scores.where(F.col("score") >= F.when(F.col("kind") == "group", GROUP_MATCH).otherwise(FIELD_MATCH))
    return with_canon(spans).join(small(good.select("canon", "path", "kind", F.col("score").alias("match"))), "canon").drop("canon")


def neighbours(labels: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Value spans right of or below label spans, with a geometric score.

    Label columns get the prefix l_, value columns v_; ``keys`` are carried label columns. A pair may occur once for
    each strategy. A small overlap scores above 1; callers clamp.
    """
    names = ("seq", "id", "text", "confidence", "source", "x1", "y1", "x2", "y2")
    left = labels.select(*KEY, *keys, *[F.col(c).alias(f"l_{c}") for c in names])
    right = spans.select(*KEY, *[F.col(c).alias(f"v_{c}") for c in names])
    pairs = left.join(right, list(KEY)).where("l_id <> v_id")
    a, b = Box("l_"), Box("v_")
    gap = b.x1 - a.x2
    distance = gap / F.greatest(a.height, F.lit(1))
    beside = (F.abs(a.cy - b.cy) <= 0.80 * F.greatest(a.height, b.height)) & (gap >= -0.05 * a.width) & (distance <= 24)
    drop = b.y1 - a.y2
    overlap = F.greatest(F.lit(0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) / F.greatest(F.least(a.width, b.width), F.lit(1))
    under = (drop >= -0.05 * a.height) & (drop <= 4.0 * a.height) & (overlap >= 0.20)
    found = F.array(
        F.when(beside, F.struct(F.lit("right_of_label").alias("strategy"), (1.0 / (1.0 + distance / 8.0)).alias("geometry"))),
        F.when(under, F.struct(F.lit("below_label").alias("strategy"), (0.86 / (1.0 + drop / F.greatest(5.0 * a.height, F.lit(1)))).alias("geometry"))),
    )
    # Strategies that don't apply are filtered as rows: a lambda over the array would not be compiled.
    return pairs.where(beside | under).select("*", F.inline(found)).where("strategy is not null")


def top_neighbours(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of each label the best neighbour if it is strong, else the two best; ties by span order, right before below."""
    own = Window.partitionBy(*KEY, *keys, "l_seq", "l_id").orderBy(F.desc("geometry"), "v_seq", F.desc("strategy"))
    ranked = pairs.withColumns({"rank": F.row_number().over(own), "best": F.first("geometry").over(own)})
    return ranked.where(F.col("rank") <= F.when(F.col("best") >= STRONG, 1).otherwise(2)).drop("best")


def label_like(scores: DataFrame) -> DataFrame:
    """Canonical texts that look like some field or group label."""
    return scores.where(F.col("plain") >= LABEL_LIKE).select("canon").distinct()


def text_rows(spans: DataFrame, paths: DataFrame, aliases: DataFrame, date_order: str = "REJECT_AMBIGUOUS", weight_unit: str = "kg", attempt: int = 0, ratio: bool = True, only_paths: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Field candidates of labels on the same line, to the right and below, with their ``place``; may repeat. ``scores`` are all_scores(), if known."""
    fields = paths.where("not checkbox")
    if only_paths is not None:
        fields = fields.join(small(only_paths.select("path").distinct()), "path", "left_semi")
    spec = F.broadcast(fields.select("path", F.col("ord").alias("path_ord"), "type", "part", "strategies"))
    scores = label_scores(spans, aliases, ratio) if scores is None else scores.where("kind in ('field', 'group')")
    hits = label_hits(spans, scores).join(spec, "path")
    ordered = aliases.groupBy("path", "kind").agg(F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("n"), "ord", "alias"))).alias("a")).select("path", "kind", F.transform("a", lambda x: x["alias"]).alias("by_length"))
    part = F.when(F.col("kind") == "group", F.col("part")).otherwise(F.lit("whole"))
    prefix = F.when(F.col("kind") == "group", F.lit("group_")).otherwise(F.lit(""))
    line = hits.where(F.array_contains("strategies", "same_line")).join(F.broadcast(ordered), ["path", "kind"])
    line = line.select("*", once(value_part(same_line_suffix(F.col("text"), F.col("by_length")), part), "raw")).where("raw is not null")
    line = line.select(
        *KEY, "path", "path_ord", "type", "kind", F.col("seq").alias("l_seq"), F.lit(0).alias("rank"), "raw", F.array("id").alias("evidence_ids"), F.concat(F.lit("rule_"), prefix, F.lit("same_line")).alias("source"),
        F.array("source").alias("support_sources"), F.col("confidence").alias("recognition"), F.col("match").alias("association"),
    )
    keys = ("path", "path_ord", "type", "part", "kind", "match", "strategies")
    near = neighbours(hits, spans, keys).where(F.array_contains("strategies", F.col("strategy")))
    near = with_canon(top_neighbours(near, ("path", "kind")).withColumn("text", F.col("v_text")))
    near = near.join(small(label_like(scores)), "canon", "left_anti").select("*", once(value_part(F.col("v_text"), part), "raw")).where("raw is not null")
    near = near.select(
        *KEY, "path", "path_ord", "type", "kind", "l_seq", "rank", "raw", F.array("l_id", "v_id").alias("evidence_ids"), F.concat(F.lit("rule_"), prefix, F.col("strategy")).alias("source"),
        F.array_distinct(F.array("l_source", "v_source")).alias("support_sources"), F.least("l_confidence", "v_confidence").alias("recognition"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("match") * F.col("geometry"))).alias("association"),
    )
    both = line.unionByName(near).select("*", F.inline(F.array(normalize_value(F.col("raw"), F.col("type"), date_order, weight_unit))))
    return both.select(
        *KEY, "path", "path_ord", "raw", "value", json_literal(F.col("value"), F.col("type")).alias("norm_json"), "evidence_ids", "source", "support_sources", "recognition", "association",
        F.lit(attempt).alias("attempt"), "codes", F.struct(F.lit(0).alias("part"), "path_ord", F.when(F.col("kind") == "group", 1).otherwise(0).alias("k"), "l_seq", "rank").alias("place"),
    )


def text_candidates(*tables: DataFrame, **options) -> DataFrame:
    """text_rows(), deduplicated and numbered."""
    return settled(text_rows(*tables, **options))


def settled(rows: DataFrame, key: tuple[str, ...] = ("source", "norm_json", "evidence_ids"), dealt: bool = False) -> DataFrame:
    """Candidates with ``place``, deduplicated and numbered by job: dealt by job once, which serves both; rows that are ``dealt`` so stay."""
    return numbered(dedupe_candidates(rows if dealt else rows.repartition("job_id"), key))


def dedupe_candidates(candidates: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of candidates alike in ``key`` on a path, the strongest; it takes the first one's place. Ties: the first."""
    names = candidates.columns
    strength = F.col("recognition") * F.col("association")
    by = [*KEY, "path", *[c for c in key if c != "path"]]
    rest = [c for c in names if c not in (*by, "place")]
    own = Window.partitionBy(*by).orderBy(F.desc(strength), "place")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ordered as well, so that one pass does both
    rows = candidates.withColumns({"strength": strength, "rank_": F.row_number().over(own), "first_": F.min("place").over(whole)})
    return rows.where("rank_ = 1").select(*by, *rest, F.col("first_").alias("place")).select(*names)


def numbered(candidates: DataFrame) -> DataFrame:
    """Candidates with ``seq``, their order in the job, in place of ``place``."""
    return candidates.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy("place")) - 1).drop("place")


def associate_controls(controls: DataFrame, spans: DataFrame) -> DataFrame:
    """Controls with ``label_id``: the span that costs least in the same row to the right, or a valid one that is given.

    A control without a span in reach has a null label.
    """
    c = controls.select(*KEY, "seq", "id", *[F.col(x).alias(f"c_{x}") for x in ("x1", "y1", "x2", "y2")])
    s = spans.select(*KEY, F.col("seq").alias("s_seq"), F.col("id").alias("s_id"), *[F.col(x).alias(f"s_{x}") for x in ("x1", "y1", "x2", "y2")])
    a, b = Box("c_"), Box("s_")
    dy, distance = F.abs(a.cy - b.cy), b.x1 - a.x2
    near = c.join(s, list(KEY)).where((dy <= F.greatest(a.height, b.height)) & (distance >= -0.25 * a.width) & (distance <= 16.0 * a.width))
    cost = F.greatest(F.lit(0.0), distance) + 2.0 * dy
    best = near.groupBy(*KEY, "id").agg(F.min_by("s_id", F.struct(cost.alias("cost"), "s_seq")).alias("near_id"))
    joined = controls.join(best, [*KEY, "id"], "left")
    if "associated_label_id" in controls.columns:
        known = spans.select(*KEY, F.col("id").alias("associated_label_id"), F.lit(True).alias("known")).distinct()
        joined = joined.join(known, [*KEY, "associated_label_id"], "left").withColumn("label_id", F.when(F.col("known"), F.col("associated_label_id")).otherwise(F.col("near_id"))).drop("known")
    else:
        joined = joined.withColumn("label_id", F.col("near_id"))
    return joined.select(*controls.columns, "label_id")


def associate_two_sided(controls: DataFrame, spans: DataFrame, most_widths: float = 14.0) -> DataFrame:
    """The variant that also takes labels to the left, at a penalty of two of the control's widths; blank spans don't count."""
    c = controls.select(*KEY, "id", *[F.col(x).alias(f"c_{x}") for x in ("x1", "y1", "x2", "y2")])
    s = spans.where("trim(text) <> ''").select(*KEY, F.col("seq").alias("s_seq"), F.col("id").alias("s_id"), *[F.col(x).alias(f"s_{x}") for x in ("x1", "y1", "x2", "y2")])
    a, b = Box("c_"), Box("s_")
    dy = F.abs(a.cy - b.cy)
    right, left = b.x1 - a.x2, a.x1 - b.x2
    beside = right >= -0.25 * a.width
    reach = F.when(beside, F.greatest(F.lit(0), right)).when(left >= 0, left)
    near = c.join(s, list(KEY)).where((dy <= 0.85 * F.greatest(a.height, b.height)) & (reach <= most_widths * a.width))
    cost = reach + 2.0 * dy + F.when(beside, F.lit(0.0)).otherwise(2.0 * a.width)
    best = near.groupBy(*KEY, "id").agg(F.min_by("s_id", F.struct(cost.alias("cost"), "s_seq")).alias("label_id"))
    return controls.join(best, [*KEY, "id"], "left").select(*controls.columns, "label_id")


def control_rows(associated: DataFrame, spans: DataFrame, paths: DataFrame, aliases: DataFrame, attempt: int = 0, ratio: bool = True, scores: DataFrame | None = None) -> DataFrame:
    """Boolean candidates of controls, for every option that their label resembles; an ambiguous state has no value."""
    labels = with_canon(spans).select(*KEY, F.col("id").alias("label_id"), "canon", F.col("confidence").alias("label_confidence"), F.col("source").alias("label_source"))
    options = "kind = 'option'"
    scores = small(staged(alias_scores(labels.select("canon"), aliases.where(options), OPTION_MATCH, ratio)) if scores is None else scores.where(options))
    spec = F.broadcast(paths.select("path", F.col("ord").alias("path_ord")))
    rows = associated.join(labels, [*KEY, "label_id"]).join(scores, "canon").join(spec, "path")
    value = F.when(F.col("state") == "checked", "true").when(F.col("state") == "unchecked", "false")
    codes = F.when(value.isNull(), F.array(F.lit("ambiguous_control_state"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(
        *KEY, "path", "path_ord", value.alias("raw"), value.alias("value"), F.coalesce(value, F.lit("null")).alias("norm_json"), F.array("id", "label_id").alias("evidence_ids"), F.lit(DETECTOR).alias("source"), F.array(F.lit(DETECTOR_SOURCE)).alias("support_sources"),
        F.col("state_confidence").alias("recognition"), F.col("score").alias("association"), F.lit(attempt).alias("attempt"), codes.alias("codes"),
        F.struct(F.lit(1).alias("part"), "path_ord", F.lit(0).alias("k"), F.col("seq").alias("l_seq"), F.lit(0).alias("rank")).alias("place"),
    )
    return rows


def control_candidates(*tables: DataFrame, **options) -> DataFrame:
    """control_rows(), numbered."""
    return numbered(control_rows(*tables, **options))


def label_matches(spans: DataFrame, aliases: DataFrame, ratio: bool = True) -> DataFrame:
    """How much spans resemble the labels of options: job_id, page, label_id, path, score."""
    labels = with_canon(spans).select(*KEY, F.col("id").alias("label_id"), "canon")
    scores = small(staged(alias_scores(labels.select("canon"), aliases.where("kind = 'option'"), OPTION_MATCH, ratio)))
    return labels.join(scores, "canon").select(*KEY, "label_id", "path", "score")


def request_controls(associated: DataFrame, spans: DataFrame, aliases: DataFrame, targets: DataFrame, most: int = 32, ratio: bool = True) -> DataFrame:
    """The controls worth showing with a request for ``targets`` (job_id, path): those whose label resembles a wanted option.

    Ranked by match and certainty of state, then in reading order; columns of ``associated`` with ``rank``.
    """
    wanted = label_matches(spans, aliases, ratio).join(targets.select("job_id", "path").distinct(), ["job_id", "path"], "left_semi").groupBy(*KEY, "label_id").agg(F.max("score").alias("match"))
    rows = associated.join(wanted, [*KEY, "label_id"]).withColumn("worth", 0.75 * F.col("match") + 0.25 * F.col("state_confidence"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("worth"), "y1", "x1")))
    return ranked.where(F.col("rank") <= most).select(*associated.columns, "rank")


def rule_candidates(spans: DataFrame, controls: DataFrame, paths: DataFrame, aliases: DataFrame, **options) -> DataFrame:
    """Text candidates of all fields, then those of controls, numbered through; ``dealt`` says that spans and controls are dealt by job.

    ``texts`` has at least the texts of ``spans``, where they are to be had without dealing spans; ``scores`` are all_scores() of these, if known.
    """
    ratio, attempt, dealt, texts = options.get("ratio", True), options.get("attempt", 0), options.pop("dealt", False), options.pop("texts", None)
    scores = options.pop("scores", None)
    scores = all_scores(spans if texts is None else texts, aliases, ratio) if scores is None else scores
    text = text_rows(spans, paths, aliases, scores=scores, **options)
    boxes = control_rows(associate_controls(controls, spans), spans, paths, aliases, attempt, ratio, scores)
    if options.get("only_paths") is not None:
        boxes = boxes.join(small(options["only_paths"].select("path").distinct()), "path", "left_semi")
    return settled(text.unionByName(boxes), dealt=dealt)


def best_by_path(candidates: DataFrame) -> DataFrame:
    """The strongest candidate of each path of a job; ties: the first."""
    strength = F.col("recognition") * F.col("association")
    own = Window.partitionBy("job_id", "path").orderBy(F.desc(strength), "seq")
    return candidates.withColumn("r_", F.row_number().over(own)).where("r_ = 1").drop("r_")


def first_by_id(rows: DataFrame) -> DataFrame:
    """Of rows with one id in a job, the first by ``seq``."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy("job_id", "id").orderBy("seq"))).where("r_ = 1").drop("r_")


def merge_candidates(*parts: DataFrame, dealt: bool = False) -> DataFrame:
    """Candidates of several passes; alike in path, value, source and evidence, the strongest stays in the first one's place."""
    rows = None
    for i, p in enumerate(parts):
        own = p.withColumn("place", F.struct(F.lit(i).alias("pass"), "seq")).drop("seq")
        rows = own if rows is None else rows.unionByName(own)
    return settled(rows, ("norm_json", "source", "evidence_ids"), dealt)
