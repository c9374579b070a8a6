"""Reading JSON Lines: strict or tolerant, with explicit schemas, and finding the data set."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.functions import text as X
from assize.operators.nested import parse_json


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PARAGRAPH = T.StructType(_strings("section", "text", "para_idx"))
#: Fields that come as a list or as text are read as text (a list as its JSON) and levelled afterwards.
CASE_SCHEMA = T.StructType(
    _strings("case_id", "case_no", "title", "judgment_date", "respondent_state", "defendants", "originating_body", "document_type", "importance", "separate_opinion", "conclusion", "article_no", "ecli", "hudoc_url",
             "keywords", "strasbourg_caselaw", "chamber_composed_of", "domestic_law", "international_law", "rules_of_court", "applicability", "represented_by")
    + [T.StructField("violation", T.ArrayType(T.StringType())), T.StructField("non-violation", T.ArrayType(T.StringType()))]
    + [T.StructField("court_assessment_references", T.StructType([T.StructField("case_references", T.ArrayType(T.StringType()))])), T.StructField("paragraphs", T.ArrayType(PARAGRAPH))]
)


#: The parser's own limits, out of the way: records of any depth and numbers of any length are read.
LIMITS = {"maxNestingDepth": str(2**31 - 1), "maxNumLen": str(2**31 - 1), "maxStringLen": str(2**31 - 1)}
_ANY = T.StructType(_strings("case_id", "_corrupt"))


@F.pandas_udf(T.BooleanType())
def _is_json(values: pd.Series) -> pd.Series:
    def check(v: str | None) -> bool:
        if v is None:
            return False
        try:
            return isinstance(parse_json(v), dict)
        except json.JSONDecodeError:
            return False

    return pd.Series([check(v) for v in values], dtype=bool)


def holds_object(value: Column) -> Column:
    """Whether a trimmed text is a JSON object; one of fields with other types than wanted is.

    The JVM's strict parser decides, but for what only its limits of depth or digits may make it refuse.
    """
    strict = F.schema_of_variant(F.try_parse_json(value))
    lax = F.from_json(value, _ANY, LIMITS | {"columnNameOfCorruptRecord": "_corrupt"})
    disputed = strict.isNull() & value.startswith("{") & lax["_corrupt"].isNull()
    return F.coalesce(strict.startswith("OBJECT"), F.lit(False)) | _is_json(F.when(disputed, value))


def record_of(value: Column, schema: T.StructType = CASE_SCHEMA) -> Column:
    """The record of a JSON object. Paragraphs may be given alone, as JSON text, or as bare texts; one of another shape costs the others nothing."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.dataType == T.ArrayType(PARAGRAPH) else f for f in schema])
    record = F.from_json(value, texts, LIMITS)
    for f in schema:
        if f.dataType == T.ArrayType(PARAGRAPH):
            own = record[f.name]
            entries = F.coalesce(F.when(F.ltrim(own).startswith("["), F.from_json(own, T.ArrayType(T.StringType()), LIMITS)), F.when(own.isNotNull(), F.array(own)))
            bare = lambda e: F.struct(F.lit(None).cast("string").alias("section"), e.alias("text"), F.lit(None).cast("string").alias("para_idx"))
            made = F.transform(entries, lambda e: F.when(F.ltrim(e).startswith("{"), F.coalesce(F.from_json(e, PARAGRAPH, LIMITS), bare(e))).when(e.isNotNull(), bare(e)))
            record = record.withField(f.name, made)
    return record


def read_strict(spark: SparkSession, path: str, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """One object per line; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).options(**LIMITS).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType = CASE_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines that hold an object, with their byte order kept by ``line_order``; and (total, valid, invalid) counts.

    Each line is one value: numbers, texts, null and broken lines are counted as invalid, arrays too.
    """
    lines = spark.read.text(path).filter(X.strip(F.col("value")) != "")
    value = X.strip(F.col("value"))
    parsed = lines.select(value.alias("value"), F.monotonically_increasing_id().alias("line_order"), holds_object(value).alias("valid"))
    counts = parsed.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid")).withColumn("invalid", F.col("total") - F.col("valid"))
    rows = parsed.filter("valid").select("line_order", record_of(F.col("value"), schema).alias("r")).select("line_order", "r.*")
    return rows, counts


def resolve(candidates: list[str], variable: str = "ASSIZE_DATA_FILE") -> str:
    """The file named by the environment if it exists, else the first existing candidate."""
    named = os.environ.get(variable)
    for path in ([named] if named else []) + candidates:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"none of {candidates} exists, and {variable} names no file")


def require_rows(df: DataFrame) -> DataFrame:
    """``df``, which must hold a row."""
    if df.isEmpty():
        raise ValueError("the data set holds no valid record")
    return df


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """A statistics payload: one JSON object over several lines."""
    return spark.read.option("multiLine", True).json(path)
