"""Leaked items, mixtures and garbled text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from assize.llm import leakage, mojibake
from assize.llm.mixing import Mixture

WORDS = "the sailor sold seven goats to a widow near old mill before dawn while two judges from town asked whose burden favours heirs".split()


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(docs, items, size=12):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    out = set()
    for i, item in items:
        w = words(item)
        n = min(size, len(w))
        wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            v = words(text)
            if any(tuple(v[k : k + n]) in wanted for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, " ".join(passage(rng, n))) for i, n in enumerate([30, 12, 11, 3, 1, 60, 25])] + [(90, None), (91, ""), (92, "?!"), (93, "Number 7 of Anna Bell's goats, 12 km from Oldtown, was sold to Karl Horn near Newtown for 5 euros.")]
    items[4] = (4, "Zyx")
    docs = []
    for d in range(120):
        text = passage(rng, rng.randrange(40))
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            text[5:5] = w[a : a + rng.choice([5, 11, 12, 13, 40])]
        docs.append((d, rng.choice([" ", "\n", " - "]).join(rng.choice([w, w.upper(), w.title()]) for w in text)))
    docs += [(900, None), (901, ""), (902, "x" * 200_000), (903, "zyx")]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leakage.found(df, it).collect()}
    assert got == brute(docs, items) and len(got) > 15
    assert leakage.found(df.filter("false"), it).count() == 0 and leakage.found(df, it.filter("false")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(passage(rng, 20))) for i in range(9)]
    docs = [(i, t) for i, t in items] + [(50, "nothing here")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leakage.found(df, it).collect()}
    assert len(whole) >= 9
    monkeypatch.setattr(leakage, "HASH_BYTES", 8 * 20)
    assert len(list(leakage.Items(it, "item_id", "text", 12).blocks())) > 3
    assert {tuple(r) for r in leakage.found(df, it).collect()} == whole
    kinds = {tuple(r) for r in leakage.leaks(df, it).collect()}
    monkeypatch.undo()
    assert {tuple(r) for r in leakage.leaks(df, it).collect()} == kinds


def test_reparameterised(spark):
    item = "A merchant named Anna Bell sold 7 goats to her cousin near Oldtown and asked the judge whether Anna Bell owed 12 euros."
    good = "A merchant named Zoe Horn sold 9 goats to her cousin near Newtown and asked the judge whether Zoe Horn owed 31 euros."
    bad = "A merchant named Zoe Horn sold 9 goats to her cousin near Newtown and asked the judge whether Ida Horn owed 31 euros."
    df = spark.createDataFrame([(1, good), (2, item.upper()), (3, bad)], "doc_id long, text string")
    rows = leakage.leaks(df, spark.createDataFrame([(5, item)], "item_id long, text string"), size=20).collect()
    assert {(r.doc_id, r.kind) for r in rows} == {(1, "reparameterised"), (2, "verbatim")}


def mixture(spark, docs, targets):
    return Mixture(spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_passes int"))


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30))), rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), 0) for i in range(1500)]
    docs += [(5000, docs[0][1], docs[0][2], 0), (5001, None, "a", 0), (5002, "", "a", 0), (5003, "no source", None, 0), (5004, "other", "zz", 0)]
    m = mixture(spark, docs, [("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.25, 2), ("d", 0.05, 3)])
    rows = m.mix().collect()
    total = sum(r.tokens for r in rows)
    report = {r.source: r for r in m.report().collect()}
    assert 0 <= m.budget - total < 200 and len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)
    assert report["c"].passes == 2 and not report["c"].reachable and report["d"].tokens == 0 and not report["d"].reachable
    assert abs(report["a"].actual_share / report["b"].actual_share - 2.5) < 0.1
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert {r.doc_id for r in rows}.isdisjoint({5000, 5001, 5002, 5003, 5004})
    times = [r.finish for r in m.ordered().collect()]
    assert times == sorted(times)
    # brute force: the queue in order, as far as the budget goes
    queue, used = sorted((r.finish, r.source, r.doc_id, r["pass"], r.tokens) for r in m.queue().collect()), 0
    want = set()
    for f, s, d, p, n in queue:
        if used + n > m.budget:
            break
        used += n
        want.add((d, p))
    assert {(r.doc_id, r["pass"]) for r in rows} == want


def test_reachable_shares_are_met(spark):
    docs = [(i, f"text number {i} with words", "a" if i % 2 else "b", 0) for i in range(2000)]
    r = {x.source: x for x in mixture(spark, docs, [("a", 0.6, 2), ("b", 0.4, 1)]).report().collect()}
    assert abs(r["a"].actual_share - 0.6) < 0.002 and r["a"].passes == 2 and r["b"].passes == 1


def test_tiny_share_and_small_spans(spark, monkeypatch):
    """A source of a tiny share stretches the finish times; the span in which the budget ends is narrowed all the same."""
    from assize.llm import mixing

    monkeypatch.setattr(mixing, "EDGE_ROWS", 5)
    monkeypatch.setattr(mixing, "SLOTS", 8)
    docs = [(i, f"text number {i} with words", "a" if i % 2 else "b", 0) for i in range(400)] + [(900, "one text of a rare source", "c", 0), (901, "another text of it", "c", 0)]
    m = mixture(spark, docs, [("a", 0.5, 50), ("b", 0.499999, 3), ("c", 0.000001, 40)])
    low, high, used = m._edge()
    assert low <= high and used <= m.budget and m.queue().filter(f"finish between {low} and {high}").count() <= 5
    got, used, want = {(r.doc_id, r["pass"]) for r in m.mix().collect()}, 0, set()
    for _, _, d, p, n in sorted((r.finish, r.source, r.doc_id, r["pass"], r.tokens) for r in m.queue().collect()):
        if used + n > m.budget:
            break
        used += n
        want.add((d, p))
    assert got == want and 0 <= m.budget - used < 20
    # passes that cannot fall within the budget are not made
    assert m.queue().agg(F.max("pass")).first()[0] <= 2


def test_empty_mix(spark):
    m = mixture(spark, [], [("a", 1.0, 1)])
    assert m.mix().count() == 0 and m.report().first().actual_share == 0.0


CLEAN = ["Суд отметил, что жалоба была рассмотрена без участия защитника и без объяснения причин.", "Le requérant réclame 35 euros à la cour, née en été.", "Sąd oddalił zażalenie i uznał skargę, że świadek był w zakładzie.", "Başvurucu şehrinde yaşamaktadır ve açılan davayı reddetmiştir.", "that’s “how” she put it – plain"]
TRAPS = ["SÃO and DECISÃO Nº 5", "L’ÂGE et l’ÎLE de « Àvelin »", "Þórin Ðarvik, née Âlvar, 20 °C", "ªº § ½ ² µ", "«ТАССР» Рёбра", "", None, "plain"]


def corpus(spark, garbled):
    rows = [t for t in CLEAN for _ in range(12)] + TRAPS + garbled
    return spark.createDataFrame([(i, t, "w") for i, t in enumerate(rows)], "doc_id long, text string, word string"), len(rows) - len(garbled)


def test_mojibake(spark):
    garbled = [
        CLEAN[1].encode().decode("cp1252"), CLEAN[1].encode().decode("latin-1"), CLEAN[1].encode().decode("mac_roman"), CLEAN[1].encode().decode("cp437"), CLEAN[0].encode().decode("cp1251", "ignore"), CLEAN[0].encode("cp1251").decode("cp1252"),
        CLEAN[0].encode("koi8-r").decode("cp1251"), CLEAN[2].encode("cp1250").decode("cp1252"), CLEAN[3].encode("cp1254").decode("cp1252"), CLEAN[1].encode().decode("cp1252").encode().decode("cp1252"), CLEAN[1].encode("cp1252").decode("utf-8", "replace"), "signed by JÃ³rvor today", "signed by JÃƒÂ³rvor today",
    ]
    df, first = corpus(spark, garbled)
    op = mojibake.Mojibake(df)
    assert {r.doc_id for r in op.found().collect()} == set(range(first, first + len(garbled)))
    made = {r.doc_id: r.text for r in op.restored().collect()}
    for i, want in ((0, 1), (1, 1), (2, 1), (3, 1), (5, 0), (6, 0), (7, 2), (8, 3), (9, 1)):
        assert made[first + i] == CLEAN[want], (i, made[first + i])
    # a lost character is restored where only one word fits
    assert made[first + 10] == CLEAN[1].replace("à", "�")
    assert made[first + 11] == made[first + 12] == "signed by Jórvor today"


def test_mojibake_without_any(spark):
    df, _ = corpus(spark, [])
    assert mojibake.Mojibake(df).found().count() == 0
    assert mojibake.Mojibake(df.filter("false")).found().count() == 0


def test_long_words(spark):
    df = spark.createDataFrame([(1, "x" * 500_000), (2, "é" * 100_000 + " " + "Ã©" * 100_000)], "doc_id long, text string")
    assert [r.doc_id for r in mojibake.Mojibake(df).found().collect()] == [2]
    assert mojibake.doc_words(df, "doc_id", "text").agg(F.count("*")).first()[0] == 2
