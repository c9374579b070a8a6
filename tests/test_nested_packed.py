"""Nested records and packed values."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from assize.operators import nested, packed
from assize.operators.nested import DecisionTables, nodes_of, shred, unshred
from assize.operators.packed import split_packed

SCALAR = st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=6).filter(lambda s: s.isascii())
VALUE = st.recursive(SCALAR, lambda v: st.lists(v, min_size=2, max_size=3) | st.dictionaries(st.sampled_from("abcd"), v, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), VALUE, max_size=4))
def test_round_trip(record):
    assert unshred(nodes_of(json.dumps(record), frozenset())) == record


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=10), st.integers(0, 60), st.sampled_from(list('{}[],:"1a\\ ')))
def test_both_parsers_agree(value, at, junk):
    text = json.dumps(value)
    assert nested._parse_steps(text) == value == nested.parse_json(text)
    for broken in (text[:at] + junk + text[at:], text[: max(0, len(text) - 1 - at)]):
        try:
            want = json.loads(broken, parse_constant=nested._no_constant)
        except json.JSONDecodeError:
            want = json
        try:
            got = nested._parse_steps(broken)
        except json.JSONDecodeError:
            got = json
        assert got == want


def test_huge_numbers_and_deep_nesting(spark):
    deep = 150_000
    payloads = [
        '{"paragraphs": [{"n": ' + "7" * 6000 + ', "section": "A", "para_idx": ' + "1" * 5000 + "}]}",
        '{"x": ' + "[" * deep + "]" * deep + ', "paragraphs": ["p"]}', '{"x": ' + '{"a":' * deep + "1" + "}" * deep + ', "paragraphs": ["p"]}', "[" * deep + "]" * deep, "[" * deep, '{"x": ' + "7" * 6000 + ",}",
    ]
    assert children(spark, payloads) == [(0, "paragraph", "0", "a", 0), (1, "paragraph", "0", "unknown", 0), (2, "paragraph", "0", "unknown", 0)]
    numbers = [n for n in nodes_of(payloads[0], frozenset(["paragraphs"])) if n[2] == "n"]
    assert numbers[0][4:] == ("integer", "7" * 6000)


def children(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "record_no long, payload string")
    return sorted(tuple(r) for r in DecisionTables(df).children().collect())


def test_shapes(spark):
    inner = json.dumps([{"section": " Just-Satisfaction ", "para_idx": " 7 ", "notes": {"refs": [None, {"x": 1}]}}, None, "bare"])
    got = children(spark, [json.dumps({"paragraphs": inner, "court_assessment_references": {"case_references": "A v. B"}})])
    assert got == sorted([(0, "paragraph", "0", "just_satisfaction", 7), (0, "note", "0.0", "just_satisfaction", 7), (0, "ref", "0.0.1", "just_satisfaction", 7), (0, "paragraph", "2", "unknown", 2), (0, "case_reference", "0", "", -1)])


def test_odd_records(spark):
    assert children(spark, [None, "", "5", "null", "[1]", '{"paragraphs": [', '{"a": NaN}', "{}", '{"paragraphs": null}']) == []
    got = children(spark, [json.dumps({"paragraphs": [{"para_idx": True, "section": ""}, {"para_idx": 3.0}, {"para_idx": "12x"}, {"para_idx": -4}, ""]}), '{"paragraphs": "\\ud800"}', "[" * 100_000])
    assert got == [(0, "paragraph", str(i), "unknown", n) for i, n in enumerate([0, 1, 2, -4, 4])] + [(1, "paragraph", "0", "unknown", 0)]


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, '{"paragraphs": {}}', "x", 2)], "record_no long, payload string, node string, parent int")
    assert DecisionTables(df).children().count() == 1
    assert DecisionTables(df.filter("false")).children().count() == 0
    assert shred(df, "record_no", "payload").count() == 2


def split(spark, values):
    df = spark.createDataFrame([(i, v, "s", "x") for i, v in enumerate(values)], "case_ord long, article_no string, source_file string, pos string")
    out = {}
    for r in split_packed(df, "article_no", "source_file", ["case_ord"]).orderBy("case_ord", "pos").collect():
        out.setdefault(r.case_ord, []).append(r.article)
    return [out.get(i, []) for i in range(len(values))]


def test_split(spark):
    got = split(spark, ["6, ; 8-1", None, "", " ; ,", "'5(3)' et 13 AND 14", '"the ""pilot"" clause, 46" / 6 § 1', "6 and 8 § 2\r\nP1-3", "it's", "Rule 39|6-1+6-3-c", '""', "5  6", "6" + ";6" * 3000, "andante and and 6"])
    assert got[:11] == [["6", "8-1"], [], [], [], ["5(3)", "13", "14"], ['the "pilot" clause, 46', "6 § 1"], ["6", "8 § 2", "P1-3"], ["it", "s"], ["Rule 39", "6-1+6-3-c"], [], ["5", "6"]]
    assert got[11] == ["6"] * 3001 and got[12] == ["andante", "6"]


def test_split_null_source_and_empty(spark):
    df = spark.createDataFrame([(1, "6;8", None)], "case_ord long, article_no string, source_file string")
    assert [tuple(r) for r in split_packed(df, "article_no", "source_file", ["case_ord"]).collect()] == [(1, 1, "6"), (1, 2, "8")]
    assert split_packed(df.filter("false"), "article_no", "source_file", ["case_ord"]).count() == 0
    clash = df.withColumnRenamed("case_ord", "pos")
    assert split_packed(clash, "article_no", "source_file", ["pos"]).columns == ["pos", "_pos", "article"]


def test_only_inferred_delimiters_part(spark, monkeypatch):
    df = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate([("6; 8", "a"), ("6, 8", "b"), ("6 and 8", "a"), ("5  7", "b"), ("1;and;2", "c"), ("3 et'x'", "c")])], "case_ord long, article_no string, source_file string")
    got = {}
    for r in split_packed(df, "article_no", "source_file", ["case_ord"]).orderBy("case_ord", "pos").collect():
        got.setdefault(r.case_ord, []).append(r.article)
    assert got == {0: ["6", "8"], 1: ["6", "8"], 2: ["6", "8"], 3: ["5", "7"], 4: ["1", "2"], 5: ["3", "x"]}
    # without a candidate of a sufficient score nothing is split
    monkeypatch.setattr(packed, "LEAST_SCORE", 2.0)
    whole = [r.article for r in split_packed(df.filter("case_ord < 4"), "article_no", "source_file", ["case_ord"]).orderBy("case_ord").collect()]
    assert whole == ["6; 8", "6, 8", "6 and 8", "5  7"]


def test_signs_of_running_text_are_no_delimiters(spark):
    text = "The applicant complained under the provisions named above that the length of his detention was excessive"
    df = spark.createDataFrame([(i, f"{text} {i}, {text}", "prose") for i in range(5)] + [(9, "6, 8", "lists")], "case_ord long, article_no string, source_file string")
    rows = split_packed(df, "article_no", "source_file", ["case_ord"]).groupBy("case_ord").count().collect()
    assert {r.case_ord: r["count"] for r in rows} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 9: 2}
    scores = {(r.source, r.delimiter): r.score for r in packed.delimiters(df, "article_no", "source_file").collect()}
    assert scores["prose", ","] < packed.LEAST_SCORE <= scores["lists", ","]
