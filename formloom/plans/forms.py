"""A deterministic form projection of orders and customers, in SQL that Spark and DuckDB both run.

One form of 1200 x 900 pixels per order: five labelled rows, a second engine's
reading for every third form, two boxes with labels, layout blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..stages import TASK_JOBS, by_job, once, staged

WIDTH, HEIGHT = 1200, 900

BASE = """
SELECT CAST(o_orderkey AS BIGINT) AS k, c_name, CAST(o_orderdate AS DATE) AS d, CAST(floor(abs(c_acctbal)) AS BIGINT) AS grams, o_orderstatus AS s
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""
LABELS = "SELECT 0 AS i, 'Serial number' AS label UNION ALL SELECT 1, 'First name' UNION ALL SELECT 2, 'Collection date' UNION ALL SELECT 3, 'Birth weight' UNION ALL SELECT 4, 'Date of birth'"
ENGINES = "SELECT 0 AS e, 'ocr-a' AS source, '' AS mark UNION ALL SELECT 1, 'engine-b', 'b'"
#: What a form shows: five labels and their values by each engine, and the labels of two boxes.
PARTS = f"""
SELECT p, i, label, e, source, mark FROM ({LABELS}) l CROSS JOIN ({ENGINES}) n CROSS JOIN (SELECT 'l' AS p UNION ALL SELECT 'v') k
UNION ALL SELECT 'm', 0, 'Masculino', 0, 'ocr-a', '' UNION ALL SELECT 'f', 0, 'Feminino', 0, 'ocr-a', ''
"""
VALUES = f"""
SELECT k, p, i, label, e, source, mark, 40 + 60 * i + 400 * e AS top, 40 + 10 * length(label) + 20 + 10 * (k % 8) AS beside,
  CASE WHEN p <> 'v' THEN label ELSE CASE i WHEN 0 THEN 'SN-' || CAST(k AS STRING) WHEN 1 THEN c_name
    WHEN 2 THEN CASE k % 4 WHEN 0 THEN CAST(d AS STRING)
      WHEN 1 THEN lpad(CAST(day(d) AS STRING), 2, '0') || '/' || lpad(CAST(month(d) AS STRING), 2, '0') || '/' || CAST(year(d) AS STRING)
      WHEN 2 THEN lpad(CAST(day(d) AS STRING), 2, '0') || lpad(CAST(month(d) AS STRING), 2, '0') || CAST(year(d) AS STRING)
      ELSE '31/02/' || CAST(year(d) AS STRING) END
    WHEN 3 THEN CAST(grams AS STRING) || ' g' ELSE CAST(d + CAST(k % 11 - 8 AS INT) AS STRING) END
  || CASE WHEN e = 1 AND k % 15 = 0 AND i < 2 THEN 'X' ELSE '' END END AS val
FROM ({BASE}) b CROSS JOIN ({PARTS}) l WHERE e = 0 OR k % 3 = 0
"""
SPANS = f"""
SELECT CAST(k AS STRING) AS job_id, 1 AS page, CAST(CASE p WHEN 'l' THEN e * 20 + 2 * i WHEN 'v' THEN e * 20 + 2 * i + 1 WHEN 'm' THEN 40 ELSE 41 END AS BIGINT) AS seq,
  CASE WHEN p IN ('l', 'v') THEN mark || p || CAST(i AS STRING) ELSE 'l' || p END AS id, val AS text, CASE p WHEN 'v' THEN CAST(80 + (k * 7 + i * 3) % 20 AS DOUBLE) / 100 ELSE CAST(99 AS DOUBLE) / 100 END AS confidence,
  CAST(CASE p WHEN 'l' THEN 40 WHEN 'v' THEN beside WHEN 'm' THEN 80 ELSE 280 END AS INT) AS x1, CAST(CASE WHEN p IN ('l', 'v') THEN top ELSE 850 END AS INT) AS y1,
  CAST(CASE p WHEN 'l' THEN 40 + 10 * length(label) WHEN 'v' THEN beside + 8 * length(val) WHEN 'm' THEN 170 ELSE 360 END AS INT) AS x2, CAST(CASE WHEN p IN ('l', 'v') THEN top + 30 ELSE 878 END AS INT) AS y2, source
FROM ({VALUES}) v
"""
CONTROLS = f"""
SELECT CAST(k AS STRING) AS job_id, 1 AS page, CAST(0 AS BIGINT) AS seq, 'c0' AS id, 'checkbox' AS kind, CASE s WHEN 'F' THEN 'checked' WHEN 'O' THEN 'unchecked' ELSE 'ambiguous' END AS state,
  CAST(98 AS DOUBLE) / 100 AS state_confidence, 40 AS x1, 850 AS y1, 68 AS x2, 878 AS y2, 'opencv' AS source FROM ({BASE}) b
UNION ALL
SELECT CAST(k AS STRING), 1, CAST(1 AS BIGINT), 'c1', 'checkbox', CASE s WHEN 'F' THEN 'unchecked' WHEN 'O' THEN 'checked' ELSE 'ambiguous' END, CAST(98 AS DOUBLE) / 100, 240, 850, 268, 878, 'opencv' FROM ({BASE}) b
"""
BLOCKS = f"""
SELECT CAST(k AS STRING) AS job_id, 1 AS page, CAST(i AS BIGINT) AS seq, 'b' || CAST(i AS STRING) AS id, 'text' AS label, label AS content, CAST(95 AS DOUBLE) / 100 AS confidence,
  30 AS x1, CAST(35 + 60 * i AS INT) AS y1, 900 AS x2, CAST(75 + 60 * i AS INT) AS y2, CAST(i AS INT) AS "order", 'layout' AS source
FROM ({BASE}) b CROSS JOIN ({LABELS}) l
UNION ALL
SELECT CAST(k AS STRING), 1, CAST(5 AS BIGINT), 'fig', 'figure', '', CAST(95 AS DOUBLE) / 100, 0, 0, 1200, 20, CAST(5 AS INT), 'layout' FROM ({BASE}) b
"""

#: The forms' blueprint. Its aliases keep clear of the similarity ratio, which SQL can't express.
BLUEPRINT = {
    "id": "order-form", "version": "1", "document_type": "order_form", "normalization": {"date_order": "DMY", "weight_unit": "kg"},
    "fields": {
        "data.serialNumber": {"aliases": ["serial number", "serial no"], "strategies": ["same_line", "right_of_label", "below_label"], "critical": True},
        "data.baby.firstName": {"aliases": ["first name", "given name"], "strategies": ["same_line", "right_of_label", "below_label"], "critical": True},
        "data.baby.sample.collection.date": {"type": "date", "aliases": ["collection date"], "strategies": ["same_line", "right_of_label", "below_label"]},
        "data.baby.birthWeight": {"type": "weight", "aliases": ["birth weight"], "strategies": ["same_line", "right_of_label", "below_label"]},
        "data.baby.dateOfBirth": {"type": "date", "aliases": ["date of birth"], "strategies": ["same_line", "right_of_label", "below_label"], "critical": True},
    },
    "checkbox_groups": {"sex": {"exclusive": True, "aliases": ["sexo"], "options": {"male": {"output_path": "data.baby.male", "aliases": ["masculino"]}, "female": {"output_path": "data.baby.female", "aliases": ["feminino"]}}}},
}


def portable(sql: str) -> str:
    """The SQL as DuckDB runs it on its own tables."""
    return sql.replace("{orders}", "orders").replace("{customer}", "customer")


def form_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return base_table(by_job(spark), sf_dir, [sql])[0]


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Orders, customers, and the number of tasks for the forms, which becomes the session's."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    # An order becomes dozens of rows: deal orders out before, whether they come from few files or many.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // TASK_JOBS))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    return orders, customer, parts


def base_table(spark: SparkSession, sf_dir: str, sqls: list[str]) -> list[DataFrame]:
    """Tables of the forms in a session by_job(): BASE is joined and dealt by job first, and what is made of a form stays where it is."""
    orders, customer, parts = _sources(spark, sf_dir)
    # Packed while they are dealt and unpacked by a generator, which needs all of it: whatever columns are read, the exchange is the same one.
    whole = spark.sql(BASE, orders=orders, customer=customer)
    packed = F.struct(*[c for c in whole.columns if c != "k"])  # the job's name says the key
    base = whole.select(F.col("k").cast("string").alias("job_id"), packed.alias("b")).repartition(parts, "job_id").select("job_id", F.col("job_id").cast("bigint").alias("k"), F.inline(F.array("b")))
    # The parts of a form go to the forms, whatever the session broadcasts: a cartesian product would lose where jobs are.
    few = "SELECT /*+ BROADCAST(l) */ job_id"
    dealt = lambda s: s.replace(BASE, "SELECT * FROM {base}").replace("SELECT k, p, i", f"{few}, k, p, i").replace("SELECT CAST(k AS STRING) AS job_id, 1 AS page, CAST(i", f"{few}, 1 AS page, CAST(i").replace("CAST(k AS STRING) AS job_id", "job_id").replace("SELECT CAST(k AS STRING), 1", "SELECT job_id, 1")

    def table(s: str) -> DataFrame:
        # Halves of a union count as dealt alike only where job_id is no column of a view; metadata keep its new name from being optimised away.
        halves = [spark.sql(dealt(x).replace('"order"', "`order`"), base=base) for x in s.split("\nUNION ALL\n")]
        return reduce(DataFrame.union, [h.withColumn("job_id", F.col("job_id").alias("job_id", metadata={"dealt": True})) for h in halves])

    return [table(s) if BASE in s else spark.sql(s, orders=orders, customer=customer) for s in sqls]


def forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, blocks and controls of all order forms."""
    return tuple(base_table(by_job(spark), sf_dir, [SPANS, BLOCKS, CONTROLS]))


def form_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, controls and jobs of all order forms, not stored: a form's rows stay in one task, which makes them again where they are read."""
    spans, _, controls, jobs = all_forms(spark, sf_dir)
    return spans, controls, jobs


def all_forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Spans, blocks, controls and jobs, as form_jobs() says."""
    spans, blocks, controls, jobs = base_table(by_job(spark), sf_dir, [SPANS, BLOCKS, CONTROLS, f"SELECT DISTINCT CAST(k AS STRING) AS job_id FROM ({BASE}) b"])
    # A half of the blocks that a label's filter empties would no longer count as dealt: the label is no constant to the optimizer.
    blocks = blocks.select(*[once("label", "label") if c == "label" else c for c in blocks.columns])
    return spans.select(*[once("text", "text") if c == "text" else c for c in spans.columns]), blocks, controls, jobs


def form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all spans, repeats included, for readers that ask for no job: made where orders meet their customers, and not dealt by job."""
    own = by_job(spark)
    # Each of the join's tasks makes dozens of texts of an order: they stay as many as the forms' tasks.
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    orders, customer, _ = _sources(own, sf_dir)
    return own.sql(f"SELECT val AS text FROM ({VALUES}) v".replace("SELECT k, p, i", "SELECT /*+ BROADCAST(l) */ k, p, i"), orders=orders, customer=customer)


def staged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(form_table(spark, sf_dir, SPANS))


def staged_forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for plans that read them many times: the projection is computed once, as a recogniser's output would be."""
    return tuple(staged(t) for t in forms(spark, sf_dir))
