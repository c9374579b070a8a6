"""Statistics of a collection: totals, series, rankings, rates, concentration and completeness.

Each is a small DataFrame. All scalar totals come from one aggregation over the cases and one over the
per-case paragraph counts; rankings aggregate first and order the aggregates only. Ties are broken by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assize.functions import text as X
from assize.functions.constants import CHAMBERS, OUTCOMES, PARSER_VERSION, SCHEMA_VERSION, SECTION_LABELS
from assize.operators.corpus import Corpus
from assize.operators.search import top


def per_case_lengths(c: Corpus) -> DataFrame:
    """(case_ord, date, paragraphs), cases without paragraphs included."""
    counts = c.paragraphs.groupBy("case_ord").agg(F.count("*").alias("n"))
    return c.cases.select("case_ord", "date").join(counts, "case_ord", "left").select("case_ord", "date", F.coalesce("n", F.lit(0)).alias("paragraphs"))


def length_stats(c: Corpus) -> DataFrame:
    n = F.col("paragraphs")
    return per_case_lengths(c).agg(
        F.count("*").alias("cases"), F.coalesce(F.sum(n), F.lit(0)).alias("paragraphs"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias("avg"),
        *[F.round(F.coalesce(F.percentile(n, F.lit(q)), F.lit(0.0)), 6).alias(a) for a, q in (("median", 0.5), ("p90", 0.9))],
        F.coalesce(F.min(n), F.lit(0)).alias("min"), F.coalesce(F.max(n), F.lit(0)).alias("max"),
    )


def summary(c: Corpus) -> DataFrame:
    """One row of totals over the cases, with those in which case law, domestic law and so on is present."""
    some = lambda x: F.size(x) > 0
    counts = {
        "dated_cases": F.col("date").isNotNull(), "undated_cases": F.col("date").isNull(), "violation_cases": some("violation"), "non_violation_cases": some("non_violation"),
        "key_cases": F.col("is_key"), "separate_opinion_cases": F.col("separate_opinion"), "inadmissible_cases": F.col("has_inadmissibility"), "struck_out_cases": F.col("is_struck_out"),
        "procedural_cases": F.col("has_procedural_aspect"), "substantive_cases": F.col("has_substantive_aspect"), "referring_cases": some("references"),
        "cases_with_domestic_law": F.col("has_domestic_law"), "cases_with_international_law": F.col("has_international_law"), "cases_with_rules_of_court": F.col("has_rules_of_court"),
    } | {f"{k.lower()}_cases": F.col("chamber") == k for k in CHAMBERS} | {f"outcome_{k}": F.col("outcome") == k for k in OUTCOMES}
    citing = c.citations.select("case_ord").distinct().withColumn("__cites", F.lit(True))
    return c.cases.join(citing, "case_ord", "left").agg(
        F.count("*").alias("total_cases"), *[F.count_if(cond).alias(name) for name, cond in counts.items()], F.count_if("__cites").alias("cases_with_strasbourg_caselaw"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), X.range_label(F.min("date"), F.max("date")).alias("date_range"),
        F.round(X.ratio(F.count_if(F.col("chamber") == CHAMBERS[0]), F.count("*")), 4).alias("grand_chamber_share"),
    )


def distinct_counts(c: Corpus) -> DataFrame:
    """Unique countries and shown articles, and the average number of citations per case."""
    states = c.cases.select(F.explode("states").alias("x")).agg(F.countDistinct("x").alias("unique_countries"))
    articles = c.cases.select(F.explode("articles").alias("x")).filter(X.shown_article(F.col("x"))).agg(F.countDistinct("x").alias("unique_articles"))
    cites = c.citations.agg(F.count("*").alias("n"))
    avg = F.round(X.ratio(cites.scalar(), F.col("all"), 1.0), 4)
    return c.cases.agg(F.count("*").alias("all")).select(states.scalar().alias("unique_countries"), articles.scalar().alias("unique_articles"), avg.alias("avg_citations"))


def by_period(c: Corpus, key=X.month_key) -> DataFrame:
    """(period, cases, paragraphs) of dated cases."""
    rows = per_case_lengths(c).filter("date is not null").select(key(F.col("date")).alias("period"), "paragraphs")
    return rows.groupBy("period").agg(F.count("*").alias("cases"), F.sum("paragraphs").alias("paragraphs")).orderBy("period")


def outcome_buckets(c: Corpus) -> DataFrame:
    """All four buckets in fixed order, empty ones with 0."""
    counts = c.cases.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in OUTCOMES])
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("outcome"), F.lit(label).alias("label"), F.col(k).alias("cases")) for i, (k, label) in enumerate(OUTCOMES.items())])
    return counts.select(F.inline(rows))


def chamber_breakdown(c: Corpus) -> DataFrame:
    counts = c.cases.agg(*[F.count_if(F.col("chamber") == k).alias(k) for k in CHAMBERS])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("chamber"), F.col(k).alias("cases")) for k in CHAMBERS])))


def outcomes_by_year(c: Corpus) -> DataFrame:
    rows = c.cases.filter("date is not null").withColumn("year", X.year_key(F.col("date")))
    return rows.groupBy("year").pivot("outcome", list(OUTCOMES)).count().na.fill(0).orderBy("year")


def aspects_by_year(c: Corpus) -> DataFrame:
    """Procedural and substantive aspects, of years with either."""
    rows = c.cases.filter("date is not null").groupBy(X.year_key(F.col("date")).alias("year"))
    out = rows.agg(F.count_if("has_procedural_aspect").alias("procedural"), F.count_if("has_substantive_aspect").alias("substantive"))
    return out.filter("procedural + substantive > 0").orderBy("year")


def exploded(c: Corpus, column: str, distinct: bool = False) -> DataFrame:
    values = F.array_distinct(column) if distinct else F.col(column)
    return c.cases.select("case_ord", F.explode(values).alias("value"))


def ranking(rows: DataFrame, k: int | None = None, name: str = "value") -> DataFrame:
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    return top(counts, "n", name, k) if k else counts.orderBy(F.desc("n"), name)


def top_countries(c: Corpus, k: int = 20) -> DataFrame:
    return ranking(exploded(c, "states"), k)


def article_mentions(c: Corpus, k: int = 20) -> DataFrame:
    """Mentions count repeated articles of a case, cases do not."""
    rows = exploded(c, "articles").filter(X.shown_article(F.col("value"))).groupBy("value", "case_ord").agg(F.count("*").alias("m"))
    counts = rows.groupBy("value").agg(F.sum("m").alias("mentions"), F.count("*").alias("cases"))
    return counts.orderBy(F.desc("mentions"), "value").limit(k)


def section_counts(c: Corpus) -> DataFrame:
    counts = c.paragraphs.groupBy("section").agg(F.count("*").alias("n"))
    share = F.round(X.ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))), 4)  # a row per section
    return counts.select("section", X.lookup(SECTION_LABELS, F.col("section")).alias("label"), "n", share.alias("percent")).orderBy(F.desc("n"), "section")


def article_outcomes(c: Corpus, k: int = 20) -> DataFrame:
    """Cases per article with and without a violation, by a full outer join of the two counts."""
    v = exploded(c, "violation", True).groupBy("value").agg(F.count("*").alias("violations"))
    n = exploded(c, "non_violation", True).groupBy("value").agg(F.count("*").alias("non_violations"))
    both = v.join(n, "value", "full_outer").na.fill(0, ["violations", "non_violations"]).withColumn("total", F.col("violations") + F.col("non_violations"))
    return both.orderBy(F.desc("total"), "value").limit(k)


def article_violation_rates(c: Corpus, k: int = 20) -> DataFrame:
    """Cases with a violation over cases that name the article; above 1 where the two lists differ."""
    named = exploded(c, "articles", True).filter(X.shown_article(F.col("value"))).groupBy("value").agg(F.count("*").alias("cases"))
    v = exploded(c, "violation", True).groupBy("value").agg(F.count("*").alias("violations"))
    rows = named.join(v, "value", "left").na.fill(0, ["violations"]).withColumn("rate", F.round(X.ratio(F.col("violations"), F.col("cases"), 1.0), 4))
    return rows.orderBy(F.desc("rate"), F.desc("cases"), F.desc("violations"), "value").limit(k)


def state_outcomes(c: Corpus, least: int = 5, k: int = 30) -> DataFrame:
    rows = c.cases.select("outcome", F.explode("states").alias("state")).groupBy("state")
    out = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]).filter(F.col("total") >= least)
    return out.withColumn("violation_percent", F.round(X.ratio(F.col("violation_only") + F.col("both"), F.col("total")), 2)).orderBy(F.desc("total"), F.desc("violation_percent"), "state").limit(k)


def opinion_share_by_body(c: Corpus, k: int = 20) -> DataFrame:
    """The bodies with most cases, and the share of these with a separate opinion."""
    out = c.cases.groupBy("body").agg(F.count("*").alias("cases"), F.count_if("separate_opinion").alias("with_opinion"))
    return out.withColumn("percent", F.round(X.ratio(F.col("with_opinion"), F.col("cases")), 2)).orderBy(F.desc("cases"), "body").limit(k)


def grounds(c: Corpus, k: int = 20) -> DataFrame:
    return ranking(c.cases.filter("has_inadmissibility").select(F.explode("grounds").alias("value")), k)


def citing_cases(c: Corpus, k: int = 20) -> DataFrame:
    """Precedents by number of distinct citing cases, and mentions."""
    once = c.citations.filter("case_id <> ''").groupBy("value", "case_id").agg(F.count("*").alias("m"))
    counts = once.groupBy("value").agg(F.count("*").alias("cases"), F.sum("m").alias("mentions"))
    return counts.orderBy(F.desc("cases"), F.desc("mentions"), "value").limit(k)


def concentration(c: Corpus, k: int = 10) -> DataFrame:
    """Share of the most cited precedents in all citations, alone and running."""
    all_ = c.citations.agg(F.count("*").alias("all"))
    rows = ranking(c.citations, k).withColumn("all", all_.scalar())
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "value")  # k rows
    share = X.ratio(F.col("n"), F.col("all"))
    running = F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(F.row_number().over(w).alias("rank"), "value", "n", F.round(share, 2).alias("share"), F.round(running, 2).alias("running_share"))


#: The fields whose presence is reported, with their kinds; those kept in a table of their own are counted there.
FIELDS = {
    "respondent_state": "string", "defendants": "string", "originating_body": "string", "importance": "string", "keywords": "list", "separate_opinion": "string", "ecli": "string", "hudoc_url": "string",
    "represented_by": "string", "strasbourg_caselaw": "list", "domestic_law": "string", "international_law": "string", "rules_of_court": "string", "violation": "array", "non_violation": "array",
    "applicability": "string", "conclusion": "string", "chamber_composed_of": "list",
}


def field_completeness(raw: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(field, share) of cases in which a raw field, or a list kept in a table of its own, is present; 0 for a field that the data do not have."""
    have = {x.lower() for x in raw.columns}
    empty = lambda f: F.trim(f) == "[]"  # noqa: E731  (of a list read as text)
    conditions = {f: X.is_present(F.col(f), k) & (~empty(f) if k == "string" else F.lit(True)) if f in have else F.lit(False) for f, k in FIELDS.items() if f not in lists}
    one = raw.agg(F.count("*").alias("all"), *[F.count_if(cond).alias(f) for f, cond in conditions.items()])
    for name, rows in lists.items():
        one = one.withColumn(name, rows.agg(F.countDistinct("case_ord")).scalar())
    cells = F.array(*[F.struct(F.lit(n.replace("_v", "-v") if n == "non_violation" else n).alias("field"), F.round(X.ratio(F.col(n), F.col("all"), 1.0), 4).alias("share")) for n in FIELDS])
    return one.select(F.inline(cells))


def section_pivot(c: Corpus, sections: list[str]) -> DataFrame:
    return c.paragraphs.groupBy("case_ord").pivot("section", sections).count().na.fill(0)


def cases_missing(c: Corpus, section: str) -> DataFrame:
    """Cases without a paragraph of the section, by anti-join."""
    return c.cases.select("case_ord", "case_id").join(c.paragraphs.filter(F.col("section") == section).select("case_ord"), "case_ord", "left_anti")


def ratio_to_max(counts: DataFrame, number: str = "n") -> DataFrame:
    """``percent`` of the largest count, for bars."""
    return counts.withColumn("percent", F.floor(F.col(number) / F.max(number).over(Window.partitionBy(F.lit(1))) * 100))


CHAMBER_NAMES = {"GRANDCHAMBER": "Grand Chamber", "CHAMBER": "Chamber", "OTHER": "Other"}


def payload(c: Corpus, raw: DataFrame, source: str, generated_at: str) -> dict:
    """All statistics as one dictionary, with the members and row layouts that readers of statistics files expect; every member is a bounded number of rows."""

    def rows(df: DataFrame, *columns: str) -> list[list]:
        return [[x if not hasattr(x, "isoformat") else x.isoformat() for x in r] for r in df.select(*columns).collect()]

    s, n, d = summary(c).first(), length_stats(c).first(), distinct_counts(c).first()
    months, years = by_period(c).collect(), by_period(c, X.year_key).collect()
    outcomes = rows(outcome_buckets(c).orderBy("rank"), "label", "cases")
    importance = rows(ranking(c.cases.select(F.col("importance").alias("value"))), "value", "n")
    same = ["violation_cases", "non_violation_cases", "grand_chamber_share", "key_cases", "separate_opinion_cases", "cases_with_strasbourg_caselaw", "cases_with_domestic_law", "cases_with_international_law", "cases_with_rules_of_court", "inadmissible_cases", "struck_out_cases"]
    return {
        "generated_at": generated_at, "source_file": source, "schema_version": SCHEMA_VERSION, "parser_version": PARSER_VERSION,
        "summary": {
            "total_cases": s.total_cases, "input_record_count": s.total_cases, "schema_version": SCHEMA_VERSION, "parser_version": PARSER_VERSION, "total_paragraphs": n.paragraphs,
            "dated_cases": s.dated_cases, "undated_cases": s.undated_cases, "date_range_label": s.date_range, "unique_countries": d.unique_countries, "unique_articles": d.unique_articles,
            "avg_paragraphs_per_case": n.avg, "median_paragraphs_per_case": n.median, "p90_paragraphs_per_case": n.p90, "min_paragraphs_per_case": n.min, "max_paragraphs_per_case": n.max,
            **{k: s[k] for k in same}, "grand_chamber_cases": s.grandchamber_cases, "chamber_cases": s.chamber_cases, "other_cases": s.other_cases,
            "avg_strasbourg_citations_per_case": d.avg_citations, "procedural_aspect_cases": s.procedural_cases, "substantive_aspect_cases": s.substantive_cases, **{f"outcome_{k}": s[f"outcome_{k}"] for k in OUTCOMES},
        },
        "series": {
            "cases_by_month": [[r.period, r.cases] for r in months], "cases_by_year": [[r.period, r.cases] for r in years], "paragraphs_by_month": [[r.period, r.paragraphs] for r in months],
            "chamber_breakdown": [[CHAMBER_NAMES[k], s[f"{k.lower()}_cases"]] for k in CHAMBERS], "case_length_snapshot": [["Min", n.min], ["Median", n.median], ["P90", n.p90], ["Max", n.max]],
            "importance_breakdown": importance, "outcome_breakdown": outcomes, "separate_opinion_share_by_body": rows(opinion_share_by_body(c), "body", "percent", "cases", "with_opinion"),
            "outcomes_by_year": rows(outcomes_by_year(c), "year", *OUTCOMES), "procedural_vs_substantive_by_year": rows(aspects_by_year(c), "year", "procedural", "substantive"),
        },
        "rankings": {
            "countries_top": rows(top_countries(c), "value", "n"), "articles_top": rows(article_mentions(c), "value", "mentions"), "sections": rows(section_counts(c), "label", "n"),
            "originating_bodies_top": rows(ranking(c.cases.select(F.col("body").alias("value")), 20), "value", "n"), "importance_distribution": importance,
            "keywords_top": rows(ranking(c.keywords, 30), "value", "n"), "judges_top": rows(ranking(c.judges, 30), "value", "n"), "strasbourg_caselaw_top": rows(ranking(c.citations, 20), "value", "n"),
            "article_outcomes_top": rows(article_outcomes(c), "value", "violations", "non_violations", "total"), "article_violation_rates_top": rows(article_violation_rates(c), "value", "rate", "violations", "cases"),
            "state_outcomes_top": rows(state_outcomes(c), "state", "total", *OUTCOMES, "violation_percent"), "inadmissibility_grounds_top": rows(grounds(c), "value", "n"),
            "precedent_concentration_top": rows(concentration(c), "value", "n", "share", "running_share"), "precedent_to_citing_cases_top": rows(citing_cases(c), "value", "cases"), "outcomes": outcomes,
        },
        "quality": {"field_completeness": {r.field: r.share for r in field_completeness(raw, {"keywords": c.keywords, "chamber_composed_of": c.judges, "strasbourg_caselaw": c.citations}).collect()}},
    }


def metadata_completeness(shares: list[Column]) -> Column:
    """Mean of some completeness shares, in percent."""
    total = shares[0]
    for s in shares[1:]:
        total = total + s
    return total / len(shares) * 100
