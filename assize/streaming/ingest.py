"""Decisions as they arrive: the batch normalisers on a stream, and running counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assize.functions import text as X
from assize.operators.corpus import unnest_paragraphs
from assize.sources.jsonl import holds_object, record_of


_LINES = "value string, file string, start long"


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines with their number within their part of a file; a part is read by one task, in order."""
    seen: dict[tuple, int] = {}
    for b in batches:
        n = []
        for key in zip(b["file"], b["start"]):
            n.append(seen.get(key, 0))
            seen[key] = n[-1] + 1
        yield b.assign(n=pd.Series(n, dtype="int64"))


def stream_cases(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """The records of JSON Lines files below ``path`` as they arrive; lines that hold no object are dropped.

    ``case_ord`` is made of a line's place in its file, so a record delivered twice is two, as in a batch, and a repeated trigger
    gives the same numbers. Records without an id are kept and are called case-<case_ord>.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = lines.mapInPandas(_numbered, _LINES + ", n long").withColumn("value", X.strip(F.col("value"))).filter("value <> ''")
    rows = rows.withColumn("case_ord", F.xxhash64("file", "start", "n"))
    rows = rows.filter(holds_object(F.col("value"))).select("case_ord", record_of(F.col("value")).alias("r")).select("case_ord", "r.*")
    own = F.when(X.strip(F.col("case_id")) != "", F.col("case_id"))
    return rows.withColumn("case_id", F.coalesce(own, F.concat(F.lit("case-"), F.col("case_ord").cast("string"))))


def stream_paragraphs(cases: DataFrame) -> DataFrame:
    return unnest_paragraphs(cases)


def stream_section_counts(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("section").agg(F.count("*").alias("n"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet exactly once, for all files there are, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
