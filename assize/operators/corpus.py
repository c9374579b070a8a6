"""The normalised model: cases, their paragraphs and their lists, from loosely typed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assize.functions import text as X
from assize.runtime import spread, table


#: Raw fields of which only the presence is kept.
PRESENCE_FIELDS = ("domestic_law", "international_law", "rules_of_court")


def numbered(df: DataFrame, group: str, order: list[str], out: str, chunk: int = 4096) -> DataFrame:
    """Row numbers from 1 within each group in the given order, of which ``order[0]`` is a whole number.

    Rows are numbered within chunks of ``order[0]``, and the sizes of the chunks before are added, so that a
    group of any size is spread over many tasks. A null position comes first.
    """
    rows = df.withColumn("__chunk", F.coalesce(F.floor(F.col(order[0]) / chunk), F.lit(-(2**60))))
    sizes = rows.groupBy(group, "__chunk").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(group).alias("__group"), F.col("__chunk").alias("__c"), before.alias("__before"))
    local = F.row_number().over(Window.partitionBy(group, "__chunk").orderBy(*order))
    rows = rows.withColumn("__local", local).join(sizes, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__chunk") == F.col("__c")))
    return rows.withColumn(out, F.col("__before") + F.col("__local")).drop("__chunk", "__local", "__group", "__c", "__before")


def normalize_cases(raw: DataFrame) -> DataFrame:
    """One row per raw case, in the types of the model. Extra columns are left out; nulls become defaults or stay null."""
    defendants, doc_types = X.list_of(F.col("defendants")), X.list_of(F.col("document_type"))
    violation, non_violation = X.clean_list(F.col("violation")), X.clean_list(F.col("non_violation"))
    have = {c.lower() for c in raw.columns}
    presence = {f"has_{f}": X.is_present(F.col(f), "string") & ~F.lower(F.trim(f)).isin("false", "[]") if f in have else F.lit(False) for f in PRESENCE_FIELDS}
    out = raw.select(
        "case_ord", "case_id", "case_no", "title", "judgment_date", "article_no", X.parse_date(F.col("judgment_date")).alias("date"),
        X.states_of(F.col("respondent_state"), defendants).alias("states"), defendants.alias("codes"),
        X.list_of(F.col("article_no"), distinct=False).alias("articles"), doc_types.alias("doc_types"),
        X.chamber_of(doc_types, F.col("originating_body")).alias("chamber"), X.or_default(F.col("originating_body"), "Unknown").alias("body"),
        X.or_default(F.col("importance"), "Unspecified").alias("importance"), X.truthy(F.col("separate_opinion")).alias("separate_opinion"),
        violation.alias("violation"), non_violation.alias("non_violation"), X.outcome_of(violation, non_violation).alias("outcome"),
        *[c.alias(n) for n, c in X.conclusion_flags(F.col("conclusion")).items()], X.inadmissibility_grounds(F.col("conclusion")).alias("grounds"),
        *[c.alias(n) for n, c in presence.items()], "ecli", "hudoc_url", "source_file", X.clean_list(F.col("court_assessment_references.case_references")).alias("references"),
    )
    return out.withColumn("is_key", F.lower("importance") == "key cases")


def normalize_paragraphs(raw: DataFrame) -> DataFrame:
    """Paragraphs with text, headers left out; section levelled, para_idx falling back to the position."""
    text = X.strip(F.col("text"))
    out = raw.select("case_ord", "case_id", "local_idx", F.coalesce("para_idx", "local_idx").alias("para_idx"), X.section_key(F.col("section")).alias("section"), text.alias("text"), "para_id")
    return out.filter((F.col("text") != "") & (F.col("section") != "header"))


def unnest_paragraphs(cases: DataFrame, paragraphs: str = "paragraphs") -> DataFrame:
    """Rows of a nested array of paragraphs; a case with none gives none. Works on streams, too.

    para_idx is the given number or the position among all entries, local_idx the position among the kept ones.
    """
    entry = lambda p, i: F.struct(
        F.coalesce(p["para_idx"].cast("string").try_cast("int"), i).alias("para_idx"), X.section_key(p["section"]).alias("section"), X.strip(p["text"]).alias("text")
    )
    kept = F.filter(F.transform(paragraphs, entry), lambda p: (p["text"] != "") & (p["section"] != "header"))
    return cases.select("case_ord", "case_id", F.posexplode(kept).alias("local_idx", "p")).select("case_ord", "case_id", "local_idx", "p.para_idx", "p.section", "p.text")


def unique_ids(cases: DataFrame, case_id: str = "case_id", order: str = "case_ord") -> DataFrame:
    """A ``unique_id`` per case: missing ids become case-<order>, repeated ones get -2, -3 and so on.

    A made-up id that meets an existing one gets the order appended, which is unique.
    """
    base = F.coalesce(F.when(F.trim(case_id) != "", F.col(case_id)), F.concat(F.lit("case-"), F.col(order).cast("string")))
    rows = cases.withColumn("__base", base)
    rows = numbered(rows, "__base", [order], "__n").withColumn("__made", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", F.col("__n").cast("string"))))
    existing = cases.select(F.col(case_id).alias("__id")).filter("__id is not null").distinct()
    clash = rows.filter("__n > 1").join(existing, F.col("__made") == F.col("__id")).select(F.col(order).alias("__clash"))
    rows = rows.join(clash, F.col(order) == F.col("__clash"), "left")
    made = F.when(F.col("__clash").isNotNull(), F.concat_ws("-", "__made", F.col(order).cast("string"))).otherwise(F.col("__made"))
    return rows.withColumn("unique_id", made).drop("__base", "__n", "__made", "__clash")


def latest_rows(df: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """Of rows delivered repeatedly the last one, by aggregation with map-side combination instead of a window."""
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(newest, tie)).alias("__row")).select("__row.*")


@dataclass
class Corpus:
    """The tables of one collection."""

    cases: DataFrame
    paragraphs: DataFrame
    keywords: DataFrame
    judges: DataFrame
    citations: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Corpus:
        def items(name: str, column: str, value: Column) -> DataFrame:
            rows = table(spark, root, name).select("case_ord", "case_id", "pos", value.alias("value"))
            return rows.filter(F.col("value") != "")

        return cls(
            normalize_cases(table(spark, root, "cases")),
            normalize_paragraphs(spread(table(spark, root, "paragraphs"))),
            items("keywords", "keyword", X.strip(F.col("keyword"))),
            items("judges", "judge", X.strip(F.col("judge"))),
            items("citations", "citation", X.squeeze(F.col("citation"))),
        )

    @classmethod
    def from_records(cls, records: DataFrame) -> Corpus:
        """From whole JSON records with ``line_order``: lists become tables, of citations that fold alike a case keeps the first."""
        raw = records.withColumnRenamed("line_order", "case_ord").withColumnRenamed("non-violation", "non_violation").withColumn("source_file", F.lit(None).cast("string"))
        raw = unique_ids(raw).withColumn("case_id", F.col("unique_id")).drop("unique_id")

        def items(values: Column) -> DataFrame:
            return raw.select("case_ord", "case_id", F.posexplode(values).alias("pos", "value"))

        return cls(
            normalize_cases(raw),
            unnest_paragraphs(raw).withColumn("para_id", F.xxhash64("case_ord", "local_idx")),
            items(X.list_of(F.col("keywords"))),
            items(X.list_of(F.col("chamber_composed_of"))),
            items(X.citation_distinct(X.list_of(F.col("strasbourg_caselaw"), "[;\n]", distinct=False))),
        )

    def dataset_key(self) -> str:
        """A short name for saved states: made of the number of cases and of the first and last eight."""
        counts = self.paragraphs.groupBy("case_ord").agg(F.count("*").alias("n"))
        base = self.cases.select("case_ord", "case_id", "date")
        ends = [base.orderBy(o).limit(8).join(counts, "case_ord", "left").orderBy(o).collect() for o in (F.asc("case_ord"), F.desc("case_ord"))]
        parts = [";".join(f"{r.case_id},{r.n or 0},{r.date or ''}" for r in end) for end in ends]
        return X.small_hash(f"{self.cases.count()};;{parts[0]};;{parts[1]}")
