"""Consistent forms and n-gram counts."""

import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assize.llm import characters as K
from assize.llm import ngrams as N

BAD = ["ｗide", "é", "ze​ro", "a b", "сourt", "ﬁne", "soft­hyphen", "﻿x", "１２", "Κralor", "a　b", "x\x07", "pрivate", "Αthens", "a⁠"]
GOOD = ["", "plain text", "tab\tand\nline\r\n", "Ünïcode é", "решение о высылке", "Θεμελίνος", "§ 1 – “q” … № 5 ² ½ ™ º", "日本語", "мир and peace", "a-б", "20 °C", "ß ŉ"[:1], "x̱"]


@pytest.mark.parametrize("value", BAD)
def test_cases(value):
    assert K.inconsistent(value) and not K.inconsistent(K.consistent(value))


@pytest.mark.parametrize("value", GOOD)
def test_no_cases(value):
    assert not K.inconsistent(value) and K.consistent(value) == value


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20))
def test_idempotent(value):
    once = K.consistent(value)
    assert K.consistent(once) == once
    assert unicodedata.is_normalized("NFC", once)
    assert K.comparison_key(K.comparison_key(value)) == K.comparison_key(value)


def test_equal_looking_names_compare_equal(spark):
    names = ["Gisa Réssa", "ＧＩＳＡ RÉSSA", "Gіsа Réssа", " gi​sa  réssa ", None, "", "STRASSE", "Straße"]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "entry_id long, judge string, form string")
    keys = {r.entry_id: r["key"] for r in K.normalized(df, "entry_id", "judge").collect()}
    assert keys[0] == keys[1] == keys[2] == keys[3] == "gisa réssa" and keys[4] is None and keys[5] == "" and keys[6] == keys[7]
    assert {r.row_id for r in K.find_inconsistent(df, "entry_id", "judge", "judge").collect()} == {1, 2, 3}
    rows = {r["key"]: (r.variants, r.uses) for r in K.same_looking(df, "judge").collect()}
    assert rows == {"gisa réssa": (4, 4), "strasse": (2, 2)}
    assert K.find_inconsistent(df.filter("false"), "entry_id", "judge", "judge").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12) | st.text("aеéö\u0301ﬁ２　\u200bμmж…²", max_size=8))
def test_first_step_loses_nothing(value):
    assert K.inconsistent(value) == (K.consistent(value) != value or K.mixes_scripts(value))


def test_units_keep_their_letters():
    assert K.consistent("5 μm") == "5 μm" and K.consistent("5 µm") == "5 µm"


def test_lookalikes_are_those_of_public_data(spark):
    """Every pair of the table is one of the Unicode confusables, as the JVM's library has them, but for a few letters that look alike in print."""
    text = spark.sparkContext._jvm.com.ibm.icu.text
    check = text.SpoofChecker.Builder().build()
    # marks aside
    base = lambda c: unicodedata.normalize("NFD", c)[0]
    odd = {a for a, b in K.LOOKALIKES.items() if check.getSkeleton(base(a)) != check.getSkeleton(base(b))}
    # small letters of the shape of capitals, and forms of italics
    assert odd <= set("внктмп" "γηωεκτχ" "Ԛ"), odd


def test_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 300_000), (2, "é" * 300_000)], "i long, t string")
    assert [r.row_id for r in K.find_inconsistent(df, "i", "t", "t").collect()] == [2]


VALUES = [(1, "Fair  Trial"), (1, "fair trial"), (2, " FAIR TRIAL "), (2, None), (2, " "), (3, "fair"), (4, "fair trial now"), (5, "trial"), (None, "fair"), (6, "fair trial"), (6, "fair trial"), (7, "Fa​ir trial")]


def test_values(spark):
    df = spark.createDataFrame([(c, v, "d") for c, v in VALUES], "case_ord long, v string, doc string")
    got = {r.term: (r.occurrences, r.records) for r in N.value_counts(df, "v", "case_ord", "f", rows_per_group=2).collect()}
    assert got == {"fair trial": (5, 3), "fair": (1, 1), "fair trial now": (1, 1), "trial": (1, 1), "fa​ir trial": (1, 1)}
    marks = {r.term: r.mark for r in N.marked(N.value_counts(df, "v", "case_ord", "f"), N.record_totals(df, "v", "case_ord", "f")).collect()}
    assert marks["fair trial"] == "common" and marks["trial"] == "rare"
    assert N.value_counts(df.filter("false"), "v", "case_ord", "f").count() == 0


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_ngrams(spark, rows):
    df = spark.createDataFrame(VALUES, "case_ord long, v string")
    n, docs = Counter(), defaultdict(set)
    for c, v in VALUES:
        w = (v or "").lower().split(" ")
        w = [x for x in w if x]
        for i in range(len(w) if c is not None else 0):
            for j in range(i + 1, min(len(w), i + 2) + 1):
                n[" ".join(w[i:j])] += 1
                docs[" ".join(w[i:j])].add(c)
    got = {r.term: (r.occurrences, r.records) for r in N.ngram_counts(df, "v", "case_ord", "f", longest=2, rows_per_group=rows).collect()}
    assert got == {t: (k, len(docs[t])) for t, k in n.items()}


def test_one_hot_first_term(spark):
    df = spark.range(5000).select((F.col("id") % 900).alias("case_ord"), F.concat(F.lit("hot "), F.col("id") % 50).alias("v"))
    got = {r.term: r.records for r in N.ngram_counts(df, "v", "case_ord", "f", longest=1, rows_per_group=100).collect()}
    assert got["hot"] == 900
    assert [tuple(r) for r in N._salts(df.select(F.lit("f").alias("field"), F.lit("hot").alias("first")), 100).collect()] == [("f", "hot", 50)]
