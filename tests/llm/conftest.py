import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).parents[2]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("formloom-tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    """Synthetic documents with odd cases: nulls, empty and blank texts, repeats, ties, a very long text, clashing columns."""
    base = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [
        (9001, None, None), (9002, "", "src0"), (9003, " \t\n\x0b\x0c\r ", "src0"), (9004, "one two", "src1"), (9005, "ONE  two", "src1"), (9005, "ONE  two", "src1"),
        (None, "Null id text of six words", "src2"), (9006, "é É ünï\xa0code \U0001f600 words here and there", None), (9007, "word " * 40_000, "src3"), (9008, base[5][1].upper(), "src9"),
        (9009, base[5][1] + " tail", "src9"), (9010, "no-break\xa0space stays one", "src9"), (-5, base[6][1], "src4"),
    ]
    rows = [(i, t, s, 1, "x", 0.5) for i, t, s in base + odd]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, component_id string, score double").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
