"""The automata against plain loops over the same signals, in one piece and in many chunks; and whole decisions."""

import random

import pytest

from assize.operators import structure as M

TEXTS = [
    "12 January 2001 was fine", "Prepared by the Registry", "Smith, President", "ab", "1. Admissibility", "(b) Merits", "General principles apply", "The Court’s assessment follows", "The complaint must be declared admissible.",
    "declared admissible. Merits", "there has been no violation of Article 6", "ALLEGED VIOLATION OF ARTICLE 8", "APPLICATION OF ARTICLE 41 OF THE CONVENTION", "Under Article 46 of the Convention", "applies Article 41 of the Convention",
    "APPLICATION OF ARTICLES 46 and 41; APPLICATION OF ARTICLE 41", "CONCURRING OPINION", "JOINDER OF THE APPLICATION admissible", "an admissible plea", "plain words of the parties", "A. Background", "II. Domestic proceedings",
    "The court heard the appeal and the tribunal gave its decision.", "Facts", "The applicant lives here.",
]


def reference(signals, react):
    state, out = 0, []
    for s in signals:
        state, label = react(state, s)
        out.append(label)
    return out


@pytest.mark.parametrize("chunk", [3, 4096])
def test_law_in_chunks(spark, chunk):
    rng = random.Random(4)
    rows = [(g, i, rng.choice(TEXTS)) for g in range(12) for i in range(rng.randrange(0, 40))]
    df = spark.createDataFrame(rows, "g long, pos int, t string")
    signals = {(r.g, r.pos): r.s for r in df.select("g", "pos", M.law_signals(df.t).alias("s")).collect()}
    got = {(r.g, r.pos): r.label for r in M.label(df, "g", ["pos"], M.law_signals(df.t), M.law_reaction, len(M.LAW_STATES), chunk).collect()}
    want = {}
    for g in range(12):
        own = [i for k, i, _ in rows if k == g]
        want |= dict(zip([(g, i) for i in own], reference([signals[g, i] for i in own], M.law_reaction)))
    assert got == want


CASES = [
    (["1. Admissibility", "argued", "must therefore be declared admissible", "argued", "(b) Merits"], ["admissibility", "admissibility", "admissibility", "merits", "merits"]),
    (["argued", "an admissible plea", "General principles", "there has been a violation", "ALLEGED VIOLATION OF ARTICLE 8", "argued"], ["admissibility", "admissibility", "merits", "merits", "admissibility", "admissibility"]),
    (["APPLICATION OF ARTICLE 41", "1. Admissibility", "Article 46 of the Convention", "argued", "Article 41 of the Convention", "argued"], ["just_satisfaction", "just_satisfaction", "article_46", "article_46", "just_satisfaction", "just_satisfaction"]),
    (["1. Admissibility", "there has been a violation", "DISSENTING OPINION", "Merits of it"], ["admissibility", "merits", "separate_opinion", "separate_opinion"]),
    # a capitalised word alone looks like a judge's name
    (["Admissibility", "there has been a violation", "Merits"], ["header", "admissibility", "header"]),
    (["Prepared by the Registry", "ab", "Article 46 of the Convention, no violation of Article 3", "x y z"], ["header", "header", "merits", "article_46"]),
]


@pytest.mark.parametrize("texts, want", CASES)
def test_law_decisions(spark, texts, want):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g long, pos int, t string")
    assert [r.label for r in M.law_sections(df, "g", ["pos"], "t").orderBy("pos").collect()] == want


def test_facts(spark):
    rows = [(1, 0, "He was born here."), (1, 1, "II. Domestic proceedings"), (1, 2, "Then."), (1, 3, "A. Background"), (1, 4, "The court and the tribunal."), (2, 0, "He lived."), (2, 1, "The court gave a decision."), (2, 2, "Later."), (2, 3, " "), (3, 0, None)]
    df = spark.createDataFrame(rows, "g long, pos int, t string")
    got = {(r.g, r.pos): r.label[6:] for r in M.facts_sections(df, "g", ["pos"], "t").collect()}
    assert got == {(1, 0): "background", (1, 1): "proceedings", (1, 2): "proceedings", (1, 3): "background", (1, 4): "background", (2, 0): "background", (2, 1): "proceedings", (2, 2): "proceedings"}


def test_whole_decision(spark):
    raw = {f.name: None for f in M.RAW_SCHEMA.fields} | {"case_id": "x", "chamber_composed_of": ["A", "B"], "introduction": ["Intro", " "], "facts": ["Facts", "He lived."], "law": ["1. Admissibility", "argued"], "violation": ["6"], "non-violation": ["8", ""]}
    df = spark.createDataFrame([tuple(raw.values())], M.RAW_SCHEMA).selectExpr("1L as case_ord", "*")
    got = [(r.para_idx, r.section, r.text) for r in M.structure_cases(df).orderBy("para_idx").collect()]
    assert got == [
        (0, "header", "Composed of: A, B"), (1, "introduction", "Intro"), (2, "facts_background", "Facts"), (3, "facts_background", "He lived."),
        (4, "admissibility", "1. Admissibility"), (5, "admissibility", "argued"), (6, "operative_part", "Violation: 6"), (7, "operative_part", "No violation: 8"),
    ]
