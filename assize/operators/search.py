"""Search: boolean text queries with metadata filters, ranking, browsing, paging, facets and export rows.

Case filters are applied to the cases alone; hits are counted per case and section before they meet the cases, so
what is joined is one small row per case with a hit, never the paragraphs' texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assize.functions import text as X
from assize.functions.constants import MAX_HITS, PAGE_SIZE, SECTION_LABELS, SECTION_ORDER
from assize.operators.corpus import Corpus
from assize.plans.query import Query, fold_term, parse
from assize.runtime import materialize


@dataclass(frozen=True)
class Filters:
    """Facet filters; an empty one filters nothing. Values of one filter are alternatives, filters add up."""

    sections: tuple[str, ...] = ()
    articles: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    doc_types: tuple[str, ...] = ()
    chambers: tuple[str, ...] = ()
    bodies: tuple[str, ...] = ()
    importance: tuple[str, ...] = ()
    outcomes: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    separate_opinion: tuple[bool, ...] = ()
    present: tuple[str, ...] = ()
    keyword: str = ""
    precedent: str = ""


def _overlap(column: str, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))


def _case_conditions(f: Filters) -> list[Column]:
    out: list[Column] = []
    if f.articles:
        out.append(_overlap("articles", f.articles))
    if f.states:
        folded = F.transform("states", lambda s: X.fold(s))
        out.append(F.arrays_overlap(folded, F.array(*[F.lit(fold_term(s)) for s in f.states])))
    if f.date_from:
        out.append(F.col("date") >= F.lit(f.date_from).cast("date"))
    if f.date_to:
        out.append(F.col("date") <= F.lit(f.date_to).cast("date"))
    if f.doc_types:
        out.append(_overlap("doc_types", f.doc_types))
    for column, values in (("chamber", f.chambers), ("body", f.bodies), ("importance", f.importance), ("outcome", f.outcomes)):
        if values:
            out.append(F.col(column).isin(*values))
    out += [F.col(name) for name in f.flags]
    if f.separate_opinion:
        out.append(F.col("separate_opinion").isin(*f.separate_opinion))
    return out


def _contains(c: Column, needle: str) -> Column:
    return F.coalesce(X.fold(c), F.lit("")).contains(needle)


def _prefix_condition(key: str, value: str) -> Column:
    if key == "case":
        return reduce(lambda a, b: a | b, [_contains(F.col(c), value) for c in ("case_no", "case_id", "title")])
    if key == "ecli":
        return _contains(F.col("ecli"), value)
    if key == "hudoc":
        return _contains(F.col("hudoc_url"), value) | _contains(X.url_parameter(F.col("hudoc_url")), value)
    if key == "article":
        return X.has_article(F.col("articles"), value)
    if key == "state":
        return F.exists(X.state_search_values(F.col("states"), F.col("codes")), lambda s: s.contains(value))
    return _contains(F.col("body"), value)


def matching_cases(corpus: Corpus, f: Filters, meta: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The cases that pass all filters and all prefixed values. Lists kept in tables of their own filter by semi-join."""
    cases, meta = corpus.cases, meta or {}
    conditions = _case_conditions(f) + [_prefix_condition(k, v) for k, vs in meta.items() if k not in ("judge", "keyword") for v in vs]
    if conditions:
        cases = cases.filter(reduce(lambda a, b: a & b, conditions))
    for key, rows in (("judge", corpus.judges), ("keyword", corpus.keywords)):
        for value in meta.get(key, ()):
            cases = cases.join(rows.filter(_contains(F.col("value"), value)).select("case_ord"), "case_ord", "left_semi")
    if f.keyword:
        # the needle may reach over several keywords of a case, which stand side by side
        joined = corpus.keywords.groupBy("case_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("k"))
        joined = joined.filter(_contains(F.array_join(F.transform("k", lambda x: x["value"]), " "), fold_term(f.keyword)))
        cases = cases.join(joined.select("case_ord"), "case_ord", "left_semi")
    if f.precedent:
        cases = cases.join(corpus.citations.filter(_contains(F.col("value"), fold_term(f.precedent))).select("case_ord"), "case_ord", "left_semi")
    for name in f.present:
        if name != "strasbourg_caselaw":
            cases = cases.filter(F.col(f"has_{name}"))
    if "strasbourg_caselaw" in f.present:
        cases = cases.join(corpus.citations.select("case_ord"), "case_ord", "left_semi")
    return cases


def _paragraphs(corpus: Corpus, query: Query, f: Filters) -> DataFrame:
    rows = corpus.paragraphs
    if f.sections:
        rows = rows.filter(F.col("section").isin(*f.sections))
    return rows.filter(query.text.predicate(F.lower("text")))


def hits(corpus: Corpus, query: str, f: Filters = Filters(), limit: int | None = None) -> DataFrame:
    """Matching paragraphs of matching cases; with ``limit`` the first in corpus order."""
    q = parse(query)
    rows = _paragraphs(corpus, q, f)
    if q.meta or f != Filters(sections=f.sections):
        rows = rows.join(matching_cases(corpus, f, q.meta).select("case_ord"), "case_ord", "left_semi")
    return rows.orderBy("case_ord", "local_idx", "para_id").limit(limit) if limit is not None else rows


def grouped(corpus: Corpus, rows: DataFrame) -> DataFrame:
    """Per case with a hit: number of hits, first hit, and the score of section weights and case boosts."""
    per_case = rows.groupBy("case_ord").agg(F.count("*").alias("hits"), F.min("local_idx").alias("first_hit"), F.sum(X.section_weight(F.col("section"))).alias("weight"))
    joined = per_case.join(corpus.cases, "case_ord")
    return joined.withColumn("score", F.round(F.col("weight") * X.case_boost(F.col("importance"), F.col("chamber")), 6)).drop("weight")


def by_hits(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("hits"), "case_ord")


def by_score(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("score"), F.desc("hits"), F.desc_nulls_last("date"), "case_ord")


def by_date(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("date"), F.desc("case_id"), "case_ord")


def search(corpus: Corpus, query: str, f: Filters = Filters(), limit: int | None = None) -> DataFrame:
    """Ranked cases; a blank query without prefixes browses all matching cases by date. With ``limit`` only the first hits count, see ``is_limited``."""
    q = parse(query)
    if q.text.blank and not q.meta:
        return browse(corpus, f)
    return by_score(grouped(corpus, hits(corpus, query, f, limit)))


def browse(corpus: Corpus, f: Filters = Filters()) -> DataFrame:
    cases = matching_cases(corpus, f)
    if f.sections:
        cases = cases.join(corpus.paragraphs.filter(F.col("section").isin(*f.sections)).select("case_ord"), "case_ord", "left_semi")
    return by_date(cases)


def is_limited(corpus: Corpus, query: str, f: Filters = Filters(), limit: int = MAX_HITS) -> bool:
    """Whether there are more hits than ``limit``."""
    return len(hits(corpus, query, f).select("case_ord").head(limit + 1)) > limit


def page(results: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of an ordered result; numbers start at 1."""
    return results.offset(max(0, number - 1) * size).limit(size)


def clamp_page(number: int, total: int, size: int = PAGE_SIZE) -> int:
    return max(1, min(number, -(-total // size)))


def page_window(number: int, pages: int, around: int = 2) -> list[int]:
    """Page numbers to offer: the first, the last and those around the current one."""
    return sorted({1, max(1, pages), *(p for p in range(number - around, number + around + 1) if 1 <= p <= pages)})


def facet(corpus: Corpus, rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Values of a case column (scalar or list) by number of hits; top ``k``."""
    per_case = rows.groupBy("case_ord").agg(F.count("*").alias("hits")).join(corpus.cases.select("case_ord", column), "case_ord")
    value = F.explode(column) if per_case.schema[column].dataType.typeName() == "array" else F.col(column)
    return top(per_case.select(value.alias("value"), "hits").groupBy("value").agg(F.sum("hits").alias("hits")), "hits", "value", k)


def facet_sections(rows: DataFrame, k: int = 10) -> DataFrame:
    return top(rows.groupBy(F.col("section").alias("value")).agg(F.count("*").alias("hits")), "hits", "value", k)


def facet_words(rows: DataFrame, k: int = 25) -> DataFrame:
    words = rows.select(F.explode(X.search_words(F.col("text"))).alias("value"))
    return top(words.groupBy("value").agg(F.count("*").alias("hits")), "hits", "value", k)


def top(counts: DataFrame, number: str, name: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc(number), name).limit(k)


def facet_domain(corpus: Corpus, column: str) -> DataFrame:
    """Distinct values a facet can take; articles in order of length, sections in reading order."""
    if column == "section":
        rank = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("value"))
        rows = corpus.paragraphs.select(F.col("section").alias("value")).distinct()
        return rows.orderBy(F.when(rank == 0, len(SECTION_ORDER) + 1).otherwise(rank), "value")
    rows = corpus.cases.select(F.explode(column).alias("value") if corpus.cases.schema[column].dataType.typeName() == "array" else F.col(column).alias("value")).distinct()
    return rows.orderBy(F.length("value"), "value") if column == "articles" else rows.orderBy("value")


def case_by_id(corpus: Corpus, case_id: str) -> DataFrame:
    """The first case of that id."""
    return corpus.cases.filter(F.col("case_id") == case_id).orderBy("case_ord").limit(1)


def in_document(corpus: Corpus, case_id: str, text: str = "", section: str = "") -> DataFrame:
    """Paragraphs of one case that contain the text, in reading order."""
    rows = corpus.paragraphs.filter((F.col("case_id") == case_id) & F.lower("text").contains(text.lower()))
    rows = rows.filter(F.col("section") == section) if section else rows
    return rows.orderBy("case_ord", "local_idx", "para_id")


def section_blocks(paragraphs: DataFrame, chunk: int = 4096) -> DataFrame:
    """Runs of paragraphs of one section: (case_ord, block, section, first, last, paragraphs).

    Runs are counted within chunks of positions; what a chunk needs of those before it, their last section and number of runs, is a row per chunk.
    """
    rows = paragraphs.select("case_ord", "local_idx", "para_id", "section", F.floor(F.col("local_idx") / chunk).alias("chunk"))
    inside = Window.partitionBy("case_ord", "chunk").orderBy("local_idx", "para_id")
    rows = rows.withColumn("n", F.row_number().over(inside)).withColumn("opens", F.when(F.lag("section").over(inside).eqNullSafe(F.col("section")), 0).otherwise(1))
    place = F.struct("local_idx", "para_id")
    ends = rows.groupBy("case_ord", "chunk").agg(F.min_by("section", place).alias("head"), F.max_by("section", place).alias("tail"), F.sum("opens").alias("runs"))
    across = Window.partitionBy("case_ord").orderBy("chunk")
    # a run that goes on from the chunk before opens nothing
    ends = ends.withColumn("goes_on", F.coalesce(F.lag("tail").over(across) == F.col("head"), F.lit(False)).cast("int"))
    before = F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(ends.select("case_ord", "chunk", "goes_on", before.alias("before")), ["case_ord", "chunk"])
    rows = rows.withColumn("block", F.col("before") - F.col("goes_on") + F.sum("opens").over(inside))
    return rows.groupBy("case_ord", "block", "section").agg(F.min("local_idx").alias("first"), F.max("local_idx").alias("last"), F.count("*").alias("paragraphs"))


def in_section_order(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs by section in reading order, unknown sections last, then by position."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("section"))
    return paragraphs.orderBy(F.when(rank == 0, len(SECTION_ORDER) + 1).otherwise(rank), "section", "case_ord", "local_idx")


def export_rows(corpus: Corpus, rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Flat rows for CSV in the wide layout: metadata of the case, paragraph number from 1, labels if given, text."""
    c = corpus.cases.withColumnRenamed("case_id", "__id")
    citations = corpus.citations.groupBy("case_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cites"))
    keywords = corpus.keywords.groupBy("case_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("words"))
    out = rows.join(c, "case_ord").join(citations, "case_ord", "left").join(keywords, "case_ord", "left")
    if labels is not None:
        out = out.join(labels.select("para_id", F.array_join("labels", "; ").alias("assigned_labels")), "para_id", "left")
    yes = lambda x: F.when(F.col(x), "yes").otherwise("no")
    cites = F.transform(F.coalesce("cites", F.array()), lambda x: x["value"])
    return out.select(
        "case_id", "case_no", "title", "judgment_date", F.date_format("date", "yyyy-MM-dd").alias("date"), F.array_join("codes", ", ").alias("defendants"), "article_no", F.array_join("states", ", ").alias("states"), F.array_join("articles", "; ").alias("articles"),
        F.array_join("doc_types", ", ").alias("document_types"), "chamber", "body", "importance", yes("separate_opinion").alias("separate_opinion"), "outcome",
        F.array_join("violation", "; ").alias("violation"), F.array_join("non_violation", "; ").alias("non_violation"), yes("has_inadmissibility").alias("inadmissibility"), yes("is_struck_out").alias("struck_out"), yes("has_procedural_aspect").alias("procedural_aspect"), yes("has_substantive_aspect").alias("substantive_aspect"),
        F.array_join(F.transform(F.coalesce("words", F.array()), lambda x: x["value"]), "; ").alias("keywords"),
        "ecli", "hudoc_url", F.size(cites).alias("citations"), F.array_join(F.slice(cites, 1, 3), "; ").alias("first_citations"),
        X.lookup(SECTION_LABELS, F.col("section")).alias("section"), (F.col("para_idx") + 1).alias("paragraph"), *(["assigned_labels"] if labels is not None else []), "text",
    )


def export_short(corpus: Corpus, rows: DataFrame) -> DataFrame:
    """Flat rows for CSV in the short layout of nine columns, metadata as it was read."""
    c = corpus.cases.withColumnRenamed("case_id", "__id")
    text = lambda x: F.coalesce(x, F.lit(""))
    return rows.join(c, "case_ord").select(
        "case_id", text("case_no").alias("case_no"), text("title").alias("title"), text("judgment_date").alias("judgment_date"), F.array_join("codes", ", ").alias("defendants"), text("article_no").alias("articles"),
        X.lookup(SECTION_LABELS, F.col("section")).alias("section"), (F.col("para_idx") + 1).alias("paragraph"), "text",
    )


def placed(results: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """(page, at, row): ordered results with their page and their place, as numbers that follow the order.

    Places in the order are made of those within each range of the sort, so that no task holds all results.
    """
    row = F.struct("case_ord", "case_id", "title", "date", "hits", "score")
    rows = materialize(results.select(row.alias("row"), F.monotonically_increasing_id().alias("at")), "search-results")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    # one row per range
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1))
    rows = rows.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").select((F.floor(place / size) + 1).alias("page"), F.struct("at", "row").alias("placed"))
    return rows


def response(results: DataFrame, seconds: float, size: int = PAGE_SIZE, limited: bool = False) -> DataFrame:
    """The search API's answer, a row per page of the ordered results: (page, json) with totals, time, whether hits were left out, and the results of that page.

    Totals are those of all ``results``. Every result stands on one page; without any, page 1 is empty.
    """
    rows = placed(results, size)
    totals = rows.agg(F.coalesce(F.sum("placed.row.hits"), F.lit(0)).alias("total_hits"), F.count("*").alias("total_cases"))
    first = results.sparkSession.range(1, 2).select(F.col("id").alias("page"), F.lit(None).cast(rows.schema["placed"].dataType).alias("placed"))
    pages = rows.unionByName(first).groupBy("page").agg(F.array_sort(F.collect_list("placed")).alias("placed"))
    answer = F.struct("total_hits", "total_cases", F.lit(round(seconds, 3)).alias("search_time"), F.lit(limited).alias("limited"), F.transform("placed", lambda x: x["row"]).alias("results"))
    return pages.crossJoin(F.broadcast(totals)).select("page", F.to_json(answer).alias("json"))
