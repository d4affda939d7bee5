"""Mixing sources to target weights with hash-threshold histograms.

A document's hash decides how often it is taken: floor(r) times for certain and
once more below its source's threshold. Thresholds are found from histograms of
tokens by source and hash bucket: the bucket in which the budget ends is the
only one that is split again, level by level, so nothing is sorted and each
level moves a few rows per source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .session import checkpointed, narrow, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash, and bits of a histogram level.
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def mix_targets(sizes: dict[str | None, int], share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """The words to take from each source: ``share`` of all words dealt by weight, none above ``most`` times its own.

    Sources go by code point, null last; weights repeat along them. What a full source leaves is dealt again by weight.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= most * sizes[s]]
        if not full:
            targets |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            targets[s] = most * float(sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets


@dataclass(frozen=True)
class SourcePlan:
    """Of a source: its words, its target, the times every document is taken, and the hash below which once more."""

    size: int
    target: float
    times: int
    threshold: int


def _hash():
    """The first HASH_BITS of the md5 of the doc_id as text; a null doc_id hashes as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__size": F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"), "__hash": _hash()})


def _edges(rows: DataFrame, open_: DataFrame, shift: int) -> DataFrame:
    """Where the budgets end among the buckets of one level: source, edge, before, words and last, one row per source of ``open_``.

    ``open_`` has edge_source, edge (the bucket of the level above), base (words of all buckets before it) and budget.
    The words of a bucket are summed first, so a window holds the 2 ** LEVEL_BITS buckets of one bucket of a source at most.
    """
    bucket = F.expr(f"shiftright(__hash, {shift})")
    inside = rows.join(open_, F.col("source").eqNullSafe(F.col("edge_source")) & (F.expr(f"shiftright(__hash, {shift + LEVEL_BITS})") == F.col("edge")))
    level = inside.groupBy("source", "base", "budget", bucket.alias("bucket")).agg(F.sum("__size").alias("words"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    level = level.withColumn("upto", upto).withColumn("over", F.col("upto") > F.col("budget"))
    found = F.min(F.when(F.col("over"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "words")))
    return level.groupBy("source").agg(found.alias("at"), F.max("bucket").alias("last")).select("source", F.col("at.bucket").alias("edge"), F.col("at.before").alias("before"), F.col("at.words").alias("words"), "last")


def plan_mix(rows: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST) -> dict[str | None, SourcePlan]:
    """Targets and thresholds by source, from stored rows with source, __size and __hash.

    The driver holds one entry per source; the histograms stay in Spark, which gives back the bucket of each source's boundary.
    """
    spark = rows.sparkSession
    sizes = {r["source"]: r["words"] for r in rows.groupBy("source").agg(F.sum("__size").alias("words")).collect()}
    targets = mix_targets(sizes, share, weights, most)
    times = {s: int(targets[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    budget = {s: targets[s] - times[s] * sizes[s] for s in sizes}
    threshold = dict.fromkeys(sizes, 0)
    at = {s: (0, 0) for s in sizes if budget[s] > 0}  # the bucket to refine, and the words before it
    shift = HASH_BITS
    while at and shift:
        shift -= LEVEL_BITS
        open_ = spark.createDataFrame([(s, edge, base, float(budget[s])) for s, (edge, base) in at.items()], "edge_source string, edge long, base long, budget double")
        found = {r["source"]: r for r in _edges(rows, narrow(open_, len(at)), shift).collect()}
        at = {}
        for s, r in found.items():
            if r["edge"] is None:  # the budget covers all that is left
                threshold[s] = (r["last"] + 1) << shift
            elif shift:
                at[s] = (r["edge"], r["before"])
            else:  # the documents of one hash are left: take them if that comes nearer
                left = budget[s] - r["before"]
                threshold[s] = r["edge"] + (r["words"] - left < left)
    return {s: SourcePlan(sizes[s], targets[s], times[s], threshold[s]) for s in sizes}


def _planned(rows: DataFrame, plan: dict[str | None, SourcePlan]) -> DataFrame:
    """``rows`` with their source's plan and __copies, how often each is taken."""
    plans = rows.sparkSession.createDataFrame([(s, p.size, p.target, p.times, p.threshold) for s, p in plan.items()], "__source string, __total long, __target double, __times long, __threshold long")
    joined = rows.join(narrow(plans, len(plan)), F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumn("__copies", F.col("__times") + (F.col("__hash") < F.col("__threshold")).cast("long"))


def _stored(docs: DataFrame) -> DataFrame:
    return checkpointed(measured(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")).drop("text"))


def _told(found: DataFrame) -> DataFrame:
    return found.withColumns({"size": F.col("__size"), "source_size": F.col("__total"), "target": F.col("__target"), "taken": F.col("__copies") * F.col("__size")})


def mixed(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target and taken (in words, repeats counted).

    ``taken`` is 0 or a multiple of ``size`` of at most ``most``. Rows of one doc_id are taken alike. A null text has
    size 0, an unknown source is a source of its own, and an empty table gives an empty result. Columns of ``docs``
    that are called like one of the results give way to it.
    """
    return _told(_planned(measured(docs), plan_mix(_stored(docs), share, weights, most)))


def mixed_ids(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """mixed() as doc_id, source, size, source_size, target and taken alone: texts are read and counted once."""
    rows = _stored(docs)
    return _told(_planned(rows, plan_mix(rows, share, weights, most))).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or repeated.

    A text without words (null, empty, blank) goes by its hash alike; rows of one doc_id, and null ones, go together; ties
    of hashes too. An empty table gives an empty one. Columns called __hash, __source, __total, __target, __times,
    __threshold, __copies or __copy must not be among those of ``docs``.
    """
    rows = _stored(docs)
    taken = _planned(docs.withColumn("__hash", _hash()), plan_mix(rows))
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed_ids(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * total / weight, source) AS k FROM w),
c AS (SELECT *, coalesce(sum(2.0 * total) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
             1.5 * sum(total) OVER () AS budget FROM o),
u AS (SELECT max((budget - before) / after) FILTER (WHERE (budget - before) / after < 2.0 * total / weight) AS unit FROM c),
t AS (SELECT source, total, least(2.0 * total, coalesce(unit, 1e300) * weight)::DOUBLE AS target FROM o, u),
p AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE floor(target / total) END AS times FROM t),
hs AS (SELECT source, h, sum(size) AS words FROM d GROUP BY ALL),
run AS (SELECT hs.*, p.target - p.times * p.total AS budget, sum(words) OVER (PARTITION BY hs.source ORDER BY h) AS upto
        FROM hs JOIN p ON hs.source IS NOT DISTINCT FROM p.source),
extra AS (SELECT source, h, budget > 0 AND (upto <= budget OR (upto - words <= budget AND upto - budget < budget - (upto - words))) AS more FROM run)
SELECT d.doc_id, d.size, p.total AS source_size, p.target, (d.size * (p.times + CASE WHEN e.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN extra e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
