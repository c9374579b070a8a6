"""Model, search and statistics on a few rows."""

import json

import pytest
from pyspark.sql import functions as F

from assize.operators import search as S
from assize.operators import statistics as A
from assize.operators.corpus import Corpus, latest_rows, normalize_cases, normalize_paragraphs, numbered, unique_ids, unnest_paragraphs

CASE = (
    "case_ord long, case_id string, case_no string, title string, judgment_date string, respondent_state string, defendants string, originating_body string, document_type string, importance string, "
    "separate_opinion string, violation array<string>, non_violation array<string>, conclusion string, article_no string, ecli string, hudoc_url string, source_file string, court_assessment_references struct<case_references: array<string>>, extra string"
)


def case(i, **k):
    row = dict(case_ord=i, case_id=f"c{i}", case_no=None, title=f"T{i}", judgment_date=None, respondent_state=None, defendants=None, originating_body=None, document_type=None, importance=None, separate_opinion=None, violation=None, non_violation=None, conclusion=None, article_no=None, ecli=None, hudoc_url=None, source_file=None, court_assessment_references=None, extra="?")
    return tuple((row | k).values())


@pytest.fixture(scope="module")
def corpus(spark):
    cases = spark.createDataFrame(
        [
            case(1, judgment_date="1/2/2020", respondent_state="Poland", violation=["6"], article_no="6; 8-1", importance="Key cases", document_type="GRANDCHAMBER", separate_opinion="yes"),
            case(2, judgment_date="2021-03-04", defendants='["TUR"]', non_violation=["8"], article_no="8", originating_body="Section 1", conclusion="Inadmissible: ratione loci"),
            case(3, judgment_date="bad", defendants="FRA; POL"),
            case(4),
        ],
        CASE,
    )
    paragraphs = spark.createDataFrame(
        [(1, 1, "c1", 0, 0, "Merits", "The Court court"), (2, 1, "c1", 1, None, "merits", "private life"), (3, 1, "c1", 2, 2, "header", "court"), (4, 2, "c2", 0, 0, "appendix", " court "), (5, 2, "c2", 1, 1, None, None), (6, 2, "c2", 2, 2, "merits", ""), (7, 3, "c3", 0, 0, "x-y", "nothing")],
        "para_id long, case_ord long, case_id string, local_idx int, para_idx int, section string, text string",
    )
    lists = "case_ord long, case_id string, pos int, value string"
    return Corpus(normalize_cases(cases), normalize_paragraphs(paragraphs), spark.createDataFrame([(1, "c1", 0, "Fair trial"), (1, "c1", 1, "Delay")], lists), spark.createDataFrame([(2, "c2", 0, "Ána B")], lists), spark.createDataFrame([(1, "c1", 0, "A v. B"), (2, "c2", 0, "A v. B"), (2, "c2", 1, "C v. D")], lists))


def ids(df):
    return [r.case_ord for r in df.collect()]


def test_search_and_rank(corpus):
    rows = S.search(corpus, "court").collect()
    assert [(r.case_ord, r.hits) for r in rows] == [(1, 1), (2, 1)]
    assert rows[0].score == round(1.3 * 1.1 * 1.1, 6) and rows[1].score == 0.8
    assert ids(S.search(corpus, "court OR private")) == [1, 2]
    assert ids(S.search(corpus, "judge:ana court")) == [2]
    assert ids(S.search(corpus, "keyword:delay")) == [1]
    assert ids(S.search(corpus, "article:8 court")) == [1, 2]
    assert ids(S.search(corpus, "state:tur court")) == [2]
    assert ids(S.search(corpus, "zzz")) == []


def test_blank_browses(corpus):
    assert ids(S.search(corpus, "  ")) == [2, 1, 4, 3]


def test_filters(corpus):
    assert ids(S.search(corpus, "", S.Filters(states=("poland",)))) == [1, 3]
    assert ids(S.search(corpus, "", S.Filters(date_from="2020-01-01", date_to="2020-12-31"))) == [1]
    assert ids(S.search(corpus, "", S.Filters(flags=("has_inadmissibility",)))) == [2]
    assert ids(S.search(corpus, "", S.Filters(keyword="trial delay"))) == [1]
    assert ids(S.search(corpus, "", S.Filters(precedent="c v"))) == [2]
    assert ids(S.search(corpus, "", S.Filters(separate_opinion=(True,)))) == [1]
    assert ids(S.search(corpus, "", S.Filters(sections=("appendix",)))) == [2]


def test_cap_and_pages(corpus):
    assert S.is_limited(corpus, "court", limit=1) and not S.is_limited(corpus, "court", limit=2)
    assert ids(S.search(corpus, "court", limit=1)) == [1]
    assert ids(S.page(S.browse(corpus), 2, 3)) == [3]
    assert S.clamp_page(9, 41) == 3 and S.clamp_page(0, 0) == 1 and S.page_window(5, 9) == [1, 3, 4, 5, 6, 7, 9]


def test_statistics_invariants(corpus):
    s, n = A.summary(corpus).first(), A.length_stats(corpus).first()
    assert s.total_cases == 4 == s.dated_cases + s.undated_cases
    assert sum(r.cases for r in A.outcome_buckets(corpus).collect()) == 4
    assert s.violation_cases == 1 and s.outcome_neither == 2 and s.grand_chamber_share == 25.0
    assert (n.cases, n.paragraphs, n.min, n.max) == (4, 4, 0, 2)
    shares = [r.running_share for r in A.concentration(corpus).collect()]
    assert shares == sorted(shares) and shares[-1] == 100.0
    assert {r.value: (r.violations, r.non_violations) for r in A.article_outcomes(corpus).collect()} == {"6": (1, 0), "8": (0, 1)}
    assert A.state_outcomes(corpus).count() == 0
    assert ids(A.cases_missing(corpus, "merits").orderBy("case_ord")) == [2, 3, 4]


def test_empty_corpus(corpus):
    empty = Corpus(*[getattr(corpus, t).filter("false") for t in ("cases", "paragraphs", "keywords", "judges", "citations")])
    assert A.summary(empty).first().total_cases == 0
    assert A.length_stats(empty).first().median == 0.0
    assert ids(S.search(empty, "court")) == [] and A.outcome_buckets(empty).count() == 4


def test_islands_and_documents(corpus):
    assert [(r.section, r.paragraphs) for r in S.section_blocks(corpus.paragraphs).filter("case_ord = 1").collect()] == [("merits", 2)]
    assert [r.para_id for r in S.in_document(corpus, "c1", "COURT").collect()] == [1]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_islands_in_chunks(spark, chunk):
    rows = [(1, i, i, s) for i, s in enumerate("aabbbacccca")] + [(2, 0, 50, "a"), (2, 0, 51, "b")]
    df = spark.createDataFrame(rows, "case_ord long, local_idx int, para_id long, section string")
    got = [(r.case_ord, r.block, r.section, r.paragraphs) for r in S.section_blocks(df, chunk).orderBy("case_ord", "block").collect()]
    assert got == [(1, 1, "a", 2), (1, 2, "b", 3), (1, 3, "a", 1), (1, 4, "c", 4), (1, 5, "a", 1), (2, 1, "a", 1), (2, 2, "b", 1)]


def test_numbered_in_chunks(spark):
    rows = spark.createDataFrame([(g, i, "x") for g in ("a", None) for i in (5, 0, 9, 3, 7)], "g string, i long, __n string")
    for chunk in (1, 4, 4096):
        assert sorted((r.g or "", r.i, r.k) for r in numbered(rows.drop("__n"), "g", ["i"], "k", chunk).collect()) == sorted((g, i, k) for g in ("a", "") for k, i in enumerate((0, 3, 5, 7, 9), 1))


def test_unique_ids(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "x"), (5, "x-2")], "case_ord long, case_id string")
    got = {r.case_ord: r.unique_id for r in unique_ids(rows).collect()}
    assert got == {1: "x", 2: "x-2-2", 3: "case-3", 4: "x-3", 5: "x-2"} and len(set(got.values())) == 5


def test_latest_rows(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (1, 7, "d")], "k int, t int, v string")
    assert {(r.k, r.v) for r in latest_rows(rows, ["k"], "t", "v").collect()} == {(1, "d"), (2, "c")}


def test_unnest(spark):
    rows = spark.createDataFrame([(1, "a", [("Merits", " x ", "7"), ("header", "h", None), (None, "y", "n/a"), ("m", None, None)]), (2, "b", [])], "case_ord long, case_id string, paragraphs array<struct<section string, text string, para_idx string>>")
    assert [tuple(r) for r in unnest_paragraphs(rows).collect()] == [(1, "a", 0, 7, "merits", "x"), (1, "a", 1, 2, "unknown", "y")]


def test_payload(spark, corpus):
    raw = spark.createDataFrame([case(1, title="")], CASE)
    p = A.payload(corpus, raw, "x.jsonl", "now")
    assert p["summary"]["total_cases"] == 4 and p["quality"]["field_completeness"]["non-violation"] >= 0.0 and p["series"]["outcome_breakdown"][0][0] == "Violation only"
    assert json.loads(json.dumps(p)) == p
    # the members that readers of statistics files expect
    assert len(p["summary"]) == 36 and len(p["quality"]["field_completeness"]) == 18
    assert sorted(p["series"]) == ["case_length_snapshot", "cases_by_month", "cases_by_year", "chamber_breakdown", "importance_breakdown", "outcome_breakdown", "outcomes_by_year", "paragraphs_by_month", "procedural_vs_substantive_by_year", "separate_opinion_share_by_body"]
    assert sorted(p["rankings"]) == [
        "article_outcomes_top", "article_violation_rates_top", "articles_top", "countries_top", "importance_distribution", "inadmissibility_grounds_top", "judges_top", "keywords_top", "originating_bodies_top", "outcomes",
        "precedent_concentration_top", "precedent_to_citing_cases_top", "sections", "state_outcomes_top", "strasbourg_caselaw_top",
    ]
