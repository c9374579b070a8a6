"""Registered queries whose answers must not end at a page or at the browser's hit cap."""

import json

from pyspark.sql import functions as F

from assize.operators import search as S
from assize.operators.corpus import Corpus
from assize.queries import catalog
from tests.test_corpus_search import CASE, case


def write(spark, folder, counts, text):
    """Tables of one case per count with so many paragraphs."""
    spark.createDataFrame([case(i, importance="Key cases" if i % 3 else None) for i in range(len(counts))], CASE).write.parquet(f"{folder}/cases.parquet")
    rows = [(i, f"c{i}", j) for i, n in enumerate(counts) for j in range(n)]
    paragraphs = spark.createDataFrame(rows, "case_ord long, case_id string, local_idx int")
    paragraphs.select((F.col("case_ord") * 100_000 + F.col("local_idx")).alias("para_id"), "*", F.col("local_idx").alias("para_idx"), F.lit("merits").alias("section"), F.lit(text).alias("text")).write.parquet(f"{folder}/paragraphs.parquet")
    for name, column in (("keywords", "keyword"), ("judges", "judge"), ("citations", "citation")):
        spark.createDataFrame([], f"case_ord long, case_id string, pos int, {column} string").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_response_has_all_hits_and_cases(spark, tmp_path):
    counts = [(i * 7) % 31 for i in range(43)] + [4700]
    d = write(spark, tmp_path / "t", counts, "the court held")
    pages = {r.page: json.loads(r.json) for r in catalog.queries()["search_response"](spark, d).collect()}
    found = [(i, n) for i, n in enumerate(counts) if n]
    assert sum(counts) > 5000 and len(found) > 40
    assert {(p["total_hits"], p["total_cases"]) for p in pages.values()} == {(sum(counts), len(found))}
    scores = {i: round(n * 1.3 * (1.1 if i % 3 else 1.0), 6) for i, n in found}
    order = sorted(found, key=lambda x: (-scores[x[0]], -x[1], x[0]))
    got = [(r["case_ord"], r["hits"], r["score"]) for k in sorted(pages) for r in pages[k]["results"]]
    assert [len(pages[k]["results"]) for k in sorted(pages)] == [20, 20, len(found) - 40] and sorted(pages) == [1, 2, 3]
    assert got == [(i, n, scores[i]) for i, n in order]


def test_response_without_results(spark, tmp_path):
    corpus = Corpus.load(spark, write(spark, tmp_path / "t", [2, 1], "the court held"))
    (row,) = S.response(S.search(corpus, "zzz", limit=None), 0.1234).collect()
    assert row.page == 1 and json.loads(row.json) == {"total_hits": 0, "total_cases": 0, "search_time": 0.123, "limited": False, "results": []}


def test_export_has_all_hits(spark, tmp_path):
    d = write(spark, tmp_path / "t", [5100, 0, 3], "a judgment")
    rows = catalog.queries()["export_rows"](spark, d).groupBy("case_id").agg(F.count("*").alias("n"), F.max("paragraph").alias("last")).collect()
    assert {tuple(r) for r in rows} == {("c0", 5100, 5100), ("c2", 3, 3)}
