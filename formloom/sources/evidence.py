"""Scans: sidecar files, image files, recognisers' JSON, pages, and empty scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import Box, polygon_box
from ..functions.hashing import ordinal_id
from ..schemas import BLOCKS, CONTROLS, JOB_ID, SPANS

_BOX = "bbox struct<x1:int,y1:int,x2:int,y2:int>"
SIDECAR = (
    f"ocrSpans array<struct<id:string,text:string,confidence:double,{_BOX},page:int,script:string,source:string,attempt:int>>, "
    f"layoutBlocks array<struct<id:string,label:string,content:string,confidence:double,{_BOX},page:int,`order`:int,source:string>>, "
    f"controls array<struct<id:string,kind:string,state:string,stateConfidence:double,{_BOX},page:int,inkRatio:double,associatedLabelId:string,source:string,attempt:int>>"
)
KINDS = {"spans": SPANS, "blocks": BLOCKS, "controls": CONTROLS}


def empty(spark: SparkSession, kind: str) -> DataFrame:
    """The result of a recogniser that is switched off."""
    return spark.createDataFrame([], KINDS[kind])


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One row per sidecar file; the job is named after the file."""
    rows = spark.read.schema(SIDECAR).json(path, multiLine=True)
    return rows.withColumn("job_id", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", ""))


def sidecar_evidence(files: DataFrame, attempt: int = 0, prefixes: tuple[str, str, str] = ("ocr", "layout", "control")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, blocks and controls of sidecar rows, renamed by their place in the file. Rows without a valid box are left out."""

    def flat(column: str, prefix: str, schema: str, more: dict[str, str]) -> DataFrame:
        rows = files.select("job_id", F.posexplode(column).alias("seq", "e"))
        e = lambda n: F.col(f"e.{n}")
        page = F.coalesce(e("page"), F.lit(1))
        rows = rows.select("job_id", page.alias("page"), F.col("seq").cast("long"), ordinal_id(F.lit(prefix), page, F.col("seq")).alias("id"), *[e(src).alias(dst) for dst, src in more.items()], *[F.col(f"e.bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).where(Box().valid)
        names = [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]
        return rows.withColumns({n: F.lit(attempt).alias(n) for n in names if n == "attempt"}).select(*names)

    spans = flat("ocrSpans", prefixes[0], SPANS, {"text": "text", "confidence": "confidence", "script": "script", "source": "source"})
    blocks = flat("layoutBlocks", prefixes[1], BLOCKS, {"label": "label", "content": "content", "confidence": "confidence", "order": "order", "source": "source"})
    blocks = blocks.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "content": F.coalesce("content", F.lit(""))})
    controls = flat("controls", prefixes[2], CONTROLS, {"kind": "kind", "state": "state", "state_confidence": "stateConfidence", "ink_ratio": "inkRatio", "associated_label_id": "associatedLabelId", "source": "source"})
    return spans, blocks, controls


def sidecar_rejects(files: DataFrame) -> DataFrame:
    """What sidecar_evidence() leaves out: job_id, kind, seq and reason of each item without a valid box."""
    parts = []
    for kind in ("ocrSpans", "layoutBlocks", "controls"):
        rows = files.select("job_id", F.posexplode(kind).alias("seq", "e")).select("job_id", F.lit(kind).alias("kind"), F.col("seq").cast("long"), *[F.col(f"e.bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
        parts.append(rows.where(F.coalesce(~Box().valid, F.lit(True))).select("job_id", "kind", "seq", F.lit("invalid_box").alias("reason")))
    return parts[0].union(parts[1]).union(parts[2])


def layout_results(rows: DataFrame, source: str = "layout") -> DataFrame:
    """Blocks of a layout recogniser's JSON (job_id, json). A score of zero counts as none; without any, 0.75."""
    item = "struct<block_bbox:array<double>,bbox:array<double>,block_label:string,label:string,block_content:string,content:string,score:double,confidence:double,block_order:string>"
    parsed = rows.select("job_id", F.from_json("json", f"parsing_res_list array<{item}>, res struct<parsing_res_list:array<{item}>>").alias("j"))
    parsed = parsed.select("job_id", F.posexplode(F.coalesce("j.res.parsing_res_list", "j.parsing_res_list")).alias("seq", "b"))
    points = F.array(F.coalesce("b.block_bbox", "b.bbox"))
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return parsed.where(points[0].isNotNull()).select(
        "job_id", F.lit(1).alias("page"), F.col("seq").cast("long"), ordinal_id(F.lit("layout"), F.lit(1), F.col("seq")).alias("id"), F.coalesce("b.block_label", "b.label", F.lit("unknown")).alias("label"),
        F.coalesce("b.block_content", "b.content", F.lit("")).alias("content"), F.coalesce(zero("b.score"), zero("b.confidence"), F.lit(0.75)).alias("confidence"), *polygon_box(points).flat(), F.col("b.block_order").try_cast("int").alias("order"), F.lit(source).alias("source"),
    )


def text_results(rows: DataFrame, source: str = "ocr") -> DataFrame:
    """Spans of a text recogniser's JSON (job_id, json): texts, scores and polygons side by side; blank texts drop out."""
    shape = "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>"
    parsed = rows.select("job_id", F.from_json("json", f"{shape}, res struct<{shape.replace(' array', ':array')}>").alias("j"))
    of = lambda n: F.coalesce(f"j.res.{n}", f"j.{n}")
    parsed = parsed.select("job_id", F.posexplode(F.arrays_zip(of("rec_texts").alias("t"), of("rec_scores").alias("s"), of("rec_polys").alias("p"))).alias("at", "e"))
    good = parsed.select("job_id", "at", F.trim(F.col("e.t")).alias("text"), F.coalesce("e.s", F.lit(0.0)).alias("confidence"), F.col("e.p").alias("poly")).where("text <> ''")
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("at")) - 1
    good = good.withColumn("seq", seq.cast("long"))
    return good.select("job_id", F.lit(1).alias("page"), "seq", ordinal_id(F.lit("ocr"), F.lit(1), F.col("seq")).alias("id"), "text", "confidence", *polygon_box(F.col("poly")).flat(), F.lit(None).cast("string").alias("script"), F.lit(source).alias("source"), F.lit(0).alias("attempt"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with bytes and digest: job_id, path, length, content, sha256. Names that can't be a job's drop out."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias("job_id"), "path", "length", "content", F.sha2("content", 256).alias("sha256")).where(F.col("job_id").rlike(JOB_ID))


def image_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The files that read_images() leaves out: path and reason."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("name"))
    return rows.where(~F.col("name").rlike(JOB_ID)).select("path", F.lit("invalid_job_id").alias("reason"))


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels: job_id, width, height, channels and BGR bytes."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    name = F.regexp_replace(F.element_at(F.split("image.origin", "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias("job_id"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def page_spans(pages: DataFrame) -> DataFrame:
    """Texts of HTML pages as spans in document order: a line per text node between tags, without scripts and styles."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    texts = F.filter(F.transform(F.split(bare, r"<[^>]*>"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    rows = pages.select(F.col("page_id").cast("string").alias("job_id"), F.posexplode(texts).alias("seq", "text"))
    return rows.select("job_id", F.lit(1).alias("page"), F.col("seq").cast("long"), ordinal_id(F.lit("html"), F.lit(1), F.col("seq")).alias("id"), "text", F.lit(1.0).alias("confidence"))
