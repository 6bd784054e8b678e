import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, y int"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return sorted((r.doc_id, r.text, r.lang) for r in documents.collect())


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    prose = "The quick brown fox jumps over the lazy dog and runs far away from it. " * 3
    long = " ".join(f"word{i} and more of it" for i in range(6000))
    rows = [(1, prose, "en"), (1, prose, "en"), (2, prose, "en"), (3, "", "en"), (4, None, "en"), (None, prose, None), (None, None, None), (5, long, None), (6, long, "de"), (7, " \n\t ", "fr"), (8, "7 * 8 | 9\n\n\n", None), (9, "é　日本 ▁x\x00 a▁b  c\r\n<s> <0x0A>", "fr")]
    return spark.createDataFrame([(i, t, g, None, None, 5, None) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
