"""Writing results: JSON Lines, CSV, statistics payloads and saved classifier states."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.functions.text import small_hash


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def copy_input(spark: SparkSession, path: str, target: str) -> bool:
    """A copy of the input as it is, unknown fields and bad lines included; nothing if it is there already (false). Both may be folders or files of any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    fa, fb = a.getFileSystem(conf), b.getFileSystem(conf)
    if fa.makeQualified(a).equals(fb.makeQualified(b)):
        return False
    return jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, True, conf)


def write_sample(df: DataFrame, path: str, n: int = 50, order: str = "case_ord") -> None:
    """The first ``n`` rows in file order."""
    df.orderBy(order).limit(max(0, n)).write.json(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = True) -> None:
    """CSV parts with a header; all cells quoted and quotes doubled, or only where needed."""
    df.write.option("header", True).option("quoteAll", quote_all).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_csv_file(df: DataFrame, path: str) -> int:
    """One local CSV file with a byte order mark for spreadsheets; rows are streamed through the driver. Gives the number of rows."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def export_name(query: str) -> str:
    """A file name from the first 30 characters of a query."""
    return "search_" + (re.sub(r"[^A-Za-z0-9]+", "_", query[:30]).strip("_") or "all") + ".csv"


def write_payload(payload: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)


def save_state(assignments: DataFrame, root: str, dataset_key: str) -> None:
    """Classifier assignments of one data set, in its partition below ``root``."""
    assignments.write.mode("overwrite").parquet(f"{root}/dataset_key={small_hash(dataset_key)}")


def load_state(spark: SparkSession, root: str, dataset_key: str) -> DataFrame:
    return spark.read.parquet(f"{root}/dataset_key={small_hash(dataset_key)}")


def section_report(paragraphs: DataFrame) -> DataFrame:
    """Section counts with their share, for the console."""
    counts = paragraphs.groupBy("section").agg(F.count("*").alias("n"))
    total = paragraphs.agg(F.count("*").alias("all"))
    return counts.select("section", "n", F.round(F.col("n") / total.scalar() * 100, 1).alias("percent")).orderBy(F.desc("n"))
