"""Layout blocks: eligibility, membership, best block of evidence or label, search order, recovery tasks."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import CORNERS, Box, belongs, contains_centre, intersection_area
from ..functions.text import canonical_text
from .mapping import KEY

EXCLUDED = ("image", "header_image", "figure", "seal", "stamp")
NO_ORDER = 1_000_000
LABEL_MATCH = 0.78


def block_order() -> list[Column]:
    """Reading order of blocks."""
    return [F.col("page"), F.coalesce("order", F.lit(NO_ORDER)), F.col("y1"), F.col("x1"), F.col("id")]


def reading_order(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*block_order())))


def eligible_blocks(blocks: DataFrame, excluded: tuple[str, ...] = EXCLUDED, most: int = 24, width: int | None = None, height: int | None = None, least_area: float = 0.001, padding: int = 0, pages: DataFrame | None = None) -> DataFrame:
    """The first ``most`` blocks of a job in reading order that may be cropped, with ``index`` from 0.

    With a page size, blocks off the page or smaller than ``least_area`` of it, ``padding`` included, don't count. ``pages``
    (job_id, width, height) has a size for each job; blocks of jobs without one all count.
    """
    names = tuple(x.lower().strip().replace(" ", "_") for x in excluded)
    rows = blocks.where(~F.replace(F.trim(F.lower("label")), F.lit(" "), F.lit("_")).isin(*names)) if names else blocks
    if width and height:
        box = Box().expanded(padding, padding, width, height)
        rows = rows.where(box.valid & (box.area / F.lit(width * height) >= least_area))
    if pages is not None:
        w, h = F.col("page_width"), F.col("page_height")
        rows = rows.join(pages.select("job_id", F.col("width").alias("page_width"), F.col("height").alias("page_height")), "job_id", "left")
        box = Box().expanded(padding, padding, w, h)
        rows = rows.where(w.isNull() | (box.valid & (box.area / F.greatest(w * h, F.lit(1)) >= least_area))).select(*blocks.columns)
    ranked = reading_order(rows)
    return ranked.where(F.col("rank") <= most).withColumn("index", F.col("rank") - 1).drop("rank")


def region_members(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(item_id, block_id) of items that belong to a block; an item may belong to several."""
    i = items.select(*KEY, F.col("id").alias("item_id"), *[F.col(c).alias(f"i_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = blocks.select(*KEY, F.col("id").alias("block_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    return i.join(b, list(KEY)).where(belongs(Box("i_"), Box("b_"))).select(*KEY, "item_id", "block_id")


def best_block(items: DataFrame, blocks: DataFrame, item_key: str = "id") -> DataFrame:
    """The block that covers an item's box best: by coverage and centre, then the smaller, then the earlier one."""
    i = items.select(*KEY, F.col(item_key), *[F.col(c).alias(f"i_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = blocks.select(*KEY, F.col("id").alias("block_id"), "index", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    a, r = Box("i_"), Box("b_")
    both = intersection_area(a, r)
    coverage = both / F.greatest(a.area, F.lit(1))
    inside = contains_centre(r, a)
    near = i.join(b, list(KEY)).where((both > 0) & ((coverage >= 0.35) | (inside & (a.area <= 4 * r.area))))
    score = coverage + F.when(inside, 0.25).otherwise(0.0)
    return near.groupBy(*KEY, item_key).agg(F.max_by("block_id", F.struct(score.alias("s"), (-r.area).alias("a"), (-F.col("index")).alias("i"))).alias("block_id"))


def label_fragments(spans: DataFrame, group: tuple[str, ...] = KEY, most: int = 4) -> DataFrame:
    """Texts of 1 to ``most`` spans in a row in reading order, with where they start and how many they are."""
    own = Window.partitionBy(*group).orderBy("y1", "x1", "id")
    texts = [F.col("text"), *[F.lead("text", k).over(own) for k in range(1, most)]]
    rows = spans.select(*group, F.row_number().over(own).alias("start"), *[t.alias(f"t{k}") for k, t in enumerate(texts)])
    parts = [F.when(F.col(f"t{k}").isNotNull(), F.struct(F.lit(k + 1).alias("length"), F.concat_ws(" ", *[F.col(f"t{j}") for j in range(k + 1)]).alias("fragment"))) for k in range(most)]
    return rows.select(*group, "start", F.inline(F.array_compact(F.array(*parts))))


#: Stands for a run of characters that no target has, one for each: no letter, number or space, so that canonical texts don't have it.
OTHER = "\0"


@lru_cache(maxsize=8)
def _text_scorer(targets: tuple[tuple[str, ...], ...], ratio: bool) -> Callable[[str], tuple[float | None, ...]]:
    """Scores of a canonical text for each path's targets, as printed_label_scores() says; a worker keeps those of texts it has seen lately."""
    sets = [[(t, set(t), SequenceMatcher(None, "", t)) for t in ts] for ts in targets]

    @lru_cache(maxsize=1 << 17)
    def scores(n: str) -> tuple[float | None, ...]:
        letters, found = set(n), []
        for ts in sets:
            best = None
            for t, own, matcher in ts:
                if n == t:
                    s = 1.0
                elif t in n:
                    s = max(0.96, min(0.98, len(t) / len(n) + 0.35))
                elif ratio and letters & own:
                    matcher.set_seq1(n)
                    s = matcher.ratio()
                else:
                    continue
                best = s if best is None or s > best else best
            found.append(best)
        return tuple(found)

    return scores


def masked(texts: Column, targets: tuple[tuple[str, ...], ...]) -> Column:
    """An array of texts with OTHER for each character that no target has, each once.

    To a target such characters are all alike, so that scores stay what they were; texts that differ in numbers and names become few.
    """
    kept = "".join(sorted({c for ts in targets for t in ts for c in t}))
    other = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in kept) + "]" if kept else "(?s)."
    return F.array_distinct(F.transform(texts, lambda t: F.regexp_replace(t, other, OTHER)))


def printed_label_scores(texts: Column, aliases: DataFrame, ratio: bool = True) -> tuple[list[str], Column]:
    """The paths, and for an array of canonical texts the best printed-label score of any for each path; a label inside other text scores 0.96.

    Null where nothing is alike. The blueprint bounds ``aliases``, which are collected; texts stay in their rows, so none is dealt by text.
    """
    found: dict[str, list[str]] = {}
    for r in aliases.select("path", canonical_text(F.col("alias")).alias("target")).where("target <> ''").distinct().orderBy("path", "target").collect():
        found.setdefault(r["path"], []).append(r["target"])
    targets = tuple(map(tuple, found.values()))

    def best(rows: pd.Series) -> pd.Series:
        of = _text_scorer(targets, ratio)
        return pd.Series([[max((x for x in xs if x is not None), default=None) for xs in zip(*map(of, row), strict=True)] if len(row) else [None] * len(targets) for row in rows], dtype=object)

    return list(found), F.pandas_udf(best, "array<double>")(masked(texts, targets))


def block_label_scores(blocks: DataFrame, spans: DataFrame, aliases: DataFrame, ratio: bool = True) -> DataFrame:
    """The best score of a block for each path, over its content, its spans and runs of its spans."""
    i = spans.select(*KEY, F.col("id"), "text", *CORNERS, *[F.col(c).alias(f"i_{c}") for c in CORNERS])
    b = blocks.select(*KEY, F.col("id").alias("block_id"), *[F.col(c).alias(f"b_{c}") for c in CORNERS])
    inside = i.join(b, list(KEY)).where(belongs(Box("i_"), Box("b_"))).select(*KEY, "block_id", "id", "text", "y1", "x1")
    pieces = label_fragments(inside, (*KEY, "block_id")).groupBy(*KEY, "block_id").agg(F.collect_set(canonical_text(F.col("fragment"))).alias("pieces"))
    own = blocks.select(*KEY, F.col("id").alias("block_id"), canonical_text(F.coalesce("content", F.lit(""))).alias("own"))
    rows = own.join(pieces, [*KEY, "block_id"], "left")
    texts = F.array_distinct(F.array_compact(F.concat(F.array("own"), F.coalesce("pieces", F.array().cast("array<string>")))))
    paths, scores = printed_label_scores(F.filter(texts, lambda t: t != ""), aliases, ratio)
    # Dealt by job before a block becomes a row for each path.
    rows = rows.select(*KEY, "block_id", scores.alias("s")).repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id")
    listed = F.arrays_zip(F.array(*map(F.lit, paths)).cast("array<string>").alias("path"), F.col("s").alias("score"))
    return rows.select(*KEY, "block_id", F.inline(listed).alias("path", "score")).where("score is not null").groupBy(*KEY, "block_id", "path").agg(F.max("score").alias("score"))


def best_label_block(scores: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block whose text is a path's printed label: best score, then the smaller, then the earlier one."""
    rows = scores.where(F.col("score") >= LABEL_MATCH).join(blocks.select(*KEY, F.col("id").alias("block_id"), "index", Box().area.alias("area")), [*KEY, "block_id"])
    return rows.groupBy("job_id", "path").agg(F.max_by("block_id", F.struct("score", (-F.col("area")).alias("a"), (-F.col("index")).alias("i"))).alias("block_id"))


def search_blocks(blocks: DataFrame, scores: DataFrame, wanted: DataFrame, limit: int = 4, prefer_empty: DataFrame | None = None) -> DataFrame:
    """The ``limit`` blocks of a job to search for ``wanted`` (job_id, path): by label relevance, confidence and reading order.

    With ``prefer_empty`` (spans), blocks without any span come before others of the same relevance.
    """
    relevance = scores.join(wanted.select("job_id", "path").distinct(), ["job_id", "path"], "left_semi").groupBy(*KEY, "block_id").agg(F.max("score").alias("relevance"))
    rows = blocks.join(wanted.select("job_id").distinct(), "job_id", "left_semi").withColumn("block_id", F.col("id")).join(relevance, [*KEY, "block_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    order = [F.desc("relevance")]
    if prefer_empty is not None:
        full = region_members(prefer_empty, blocks).select(*KEY, "block_id").distinct().withColumn("full", F.lit(1))
        rows = rows.join(full, [*KEY, "block_id"], "left")
        order.append(F.coalesce("full", F.lit(0)).asc())
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*order, F.desc("confidence"), "index")))
    return ranked.where(F.col("rank") <= limit).select(*KEY, "block_id", "index", "relevance", "rank")


def plan_recovery(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Plans for fields to retry: the box around their evidence and what to do with the crop."""
    # Decisions are read once: what is carried is the same in all rows of a path.
    kept = ("ord", "evidence_ids", "reasons")
    retry = decisions.where("disposition = 'retry'").select("job_id", "path", F.struct(*kept).alias("d"), F.explode_outer("evidence_ids").alias("id"))
    rows = retry.join(evidence.select("job_id", "id", *CORNERS), ["job_id", "id"], "left")
    rows = rows.groupBy("job_id", "path").agg(F.first("d").alias("d"), *[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")]).select("job_id", "path", "d.*", *CORNERS)
    focus = F.contains(F.lower(F.array_join("evidence_ids", " ")), F.lit("control")) | F.endswith("path", F.lit("male"))
    actions = F.when(focus, F.array(F.lit("checkbox_focus"), F.lit("upscale"))).otherwise(F.array(F.lit("upscale"), F.lit("clahe")))
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("below_accept_threshold")))
    return rows.select("job_id", "path", "ord", *CORNERS, "evidence_ids", actions.alias("actions"), reasons.alias("reasons"))


def recovery_tasks(plans: DataFrame, blocks: DataFrame, scores: DataFrame, checkbox_paths: DataFrame, search_limit: int = 4, search_all: bool = True) -> tuple[DataFrame, DataFrame]:
    """Crops to look at again, and plans without one.

    A plan goes to the block of its evidence (best_block(), on each page), else of its printed label (best_label_block());
    plans without either share the job's search blocks (search_blocks()). ``blocks`` are eligible ones. A task has its
    block, its paths in order, how each was chosen, and its actions.

    A job has a few plans and blocks: both are gathered in one row, so that each table is read once, whatever it takes to make it.
    """
    marked = scores.groupBy(*KEY, "block_id").agg(F.collect_list(F.struct("path", "score")).alias("s"))
    rows = blocks.select(*KEY, F.col("id").alias("block_id"), "index", "confidence", *CORNERS).join(marked, [*KEY, "block_id"], "left")
    area = Box().area.alias("area")
    shown = rows.groupBy("job_id").agg(F.collect_list(F.struct("page", "block_id", "index", "confidence", area, *CORNERS, "s")).alias("blocks"))
    asked = plans.groupBy("job_id").agg(F.collect_list(F.struct(*plans.columns)).alias("plans"))
    jobs = asked.join(shown, "job_id", "left").withColumn("blocks", F.coalesce("blocks", F.slice(F.array(F.lit(None).cast(shown.schema["blocks"].dataType.elementType)), 1, 0)))

    def by_box(p: Column) -> Column:
        def near(b: Column) -> Column:
            a, r = (Box(columns=tuple(x[c] for c in CORNERS)) for x in (p, b))
            both, inside = intersection_area(a, r), contains_centre(r, a)
            coverage = both / F.greatest(a.area, F.lit(1))
            good = (both > 0) & ((coverage >= 0.35) | (inside & (a.area <= 4 * r.area)))
            return F.when(good, F.struct((coverage + F.when(inside, 0.25).otherwise(0.0)).alias("s"), (-b["area"]).alias("a"), (-b["index"]).alias("i"), b["block_id"].alias("id"), b["page"].alias("page")))

        found = F.array_compact(F.transform("blocks", near))
        return F.transform(F.array_distinct(F.transform(found, lambda x: x["page"])), lambda page: F.array_max(F.filter(found, lambda x: x["page"] == page))["id"])

    def by_label(p: Column) -> Column:
        def score(b: Column) -> Column:
            return F.array_max(F.transform(F.filter(b["s"], lambda x: (x["path"] == p["path"]) & (x["score"] >= LABEL_MATCH)), lambda x: x["score"]))

        best = F.array_max(F.filter(F.transform("blocks", lambda b: F.struct(score(b).alias("s"), (-b["area"]).alias("a"), (-b["index"]).alias("i"), b["block_id"].alias("id"))), lambda x: x["s"].isNotNull()))
        return F.when(best.isNotNull(), F.array(best["id"])).otherwise(F.array().cast("array<string>"))

    jobs = jobs.select("job_id", "blocks", F.transform("plans", lambda p: F.struct(p.alias("p"), F.when(p["x1"].isNotNull(), by_box(p)).otherwise(F.array().cast("array<string>")).alias("box"), by_label(p).alias("label"))).alias("plans"))
    placed = lambda p: (F.size(p["box"]) > 0) | (F.size(p["label"]) > 0)
    jobs = jobs.withColumn("open", F.transform(F.filter("plans", lambda p: ~placed(p)), lambda p: p["p"]["path"]))
    relevance = lambda b: F.coalesce(F.array_max(F.transform(F.filter(b["s"], lambda x: F.array_contains("open", x["path"])), lambda x: x["score"])), F.lit(0.0))
    ranked = F.array_sort(F.transform("blocks", lambda b: F.struct((-relevance(b)).alias("r"), F.coalesce(-b["confidence"], F.lit(float("inf"))).alias("c"), b["index"].alias("i"), b["block_id"].alias("id"))))
    found = F.transform(F.slice(ranked, 1, search_limit), lambda x: x["id"]) if search_all else F.array().cast("array<string>")
    jobs = jobs.select("job_id", "plans", F.when(F.size("open") > 0, found).otherwise(F.array().cast("array<string>")).alias("found"))
    rows = jobs.select("job_id", F.inline("plans"), "found")
    none = (F.size("box") == 0) & (F.size("label") == 0)
    rest = rows.where(none & (F.size("found") == 0)).select("p.*").select(*plans.columns)
    how = F.when(F.size("box") > 0, "evidence").when(F.size("label") > 0, "label").otherwise("search")
    at = F.when(F.size("box") > 0, F.col("box")).when(F.size("label") > 0, F.col("label")).otherwise(F.col("found"))
    chosen = rows.select("job_id", F.explode(at).alias("block_id"), "p.path", "p.ord", how.alias("how"), "p.actions")
    boxed = chosen.join(F.broadcast(checkbox_paths.select("path", F.lit(True).alias("box"))), "path", "left")
    tasks = boxed.groupBy("job_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "how", "actions"))).alias("t"), F.bool_and(F.coalesce("box", F.lit(False))).alias("only_boxes"))
    tasks = tasks.select("job_id", "block_id", F.transform("t", lambda x: x["path"]).alias("paths"), F.transform("t", lambda x: x["how"]).alias("reasons"), task_actions(F.array_distinct(F.flatten(F.transform("t", lambda x: x["actions"]))), F.col("only_boxes")).alias("actions"))
    return tasks, rest


def task_actions(requested: Column, only_boxes: Column) -> Column:
    """Actions of a task: checkbox crops are focused; others lose what may erase writing. Both are upscaled."""
    without = lambda names: F.filter(requested, lambda a: ~a.isin(*names))
    first = lambda a, name: F.when(F.array_contains(a, name), a).otherwise(F.array_prepend(a, name))
    boxes = first(without(["review"]), F.lit("checkbox_focus"))
    safe = without(["adaptive_binarize", "checkbox_focus", "review"])
    safe = F.when(F.array_contains(safe, "clahe"), safe).otherwise(F.array_append(safe, F.lit("clahe")))
    return first(F.when(only_boxes, boxes).otherwise(safe), F.lit("upscale"))


def crop_proposal_targets(tasks: DataFrame, candidates: DataFrame, crop_scores: DataFrame) -> DataFrame:
    """Paths of a task that a crop gives reason to ask about: unresolved, and placed by evidence or label, or visible in the crop.

    ``crop_scores`` has job_id, block_id, path, score of the texts read in the crop.
    """
    rows = tasks.select("job_id", "block_id", F.explode(F.arrays_zip("paths", "reasons")).alias("t")).select("job_id", "block_id", F.col("t.paths").alias("path"), F.col("t.reasons").alias("how"))
    open_ = rows.join(candidates.where("value is not null").select("job_id", "path").distinct(), ["job_id", "path"], "left_anti")
    seen = crop_scores.where(F.col("score") >= LABEL_MATCH).select("job_id", "block_id", "path", F.lit(True).alias("seen")).distinct()
    return open_.join(seen, ["job_id", "block_id", "path"], "left").where("how in ('evidence', 'label') or seen").select("job_id", "block_id", "path", "how")


def suppress_overlaps(boxes: DataFrame, most: float = 0.65) -> DataFrame:
    """Detections that no better one of the job and page overlaps by ``most``: best confidence first, then reading order.

    Greedy, hence a fold over the page's boxes in order, in a built-in aggregate.
    """
    item = F.struct((-F.col("confidence")).alias("c"), "y1", "x1", "x2", "y2", "id")
    gathered = boxes.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def near(a: Column, b: Column) -> Column:
        w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
        h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        both = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
        area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
        return both / F.greatest(area(a) + area(b) - both, F.lit(1)) >= most

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: near(x, y)), acc).otherwise(F.array_append(acc, x)))
    return gathered.select(*KEY, F.posexplode(kept).alias("rank", "k")).select(*KEY, "rank", F.col("k.id").alias("id"))
