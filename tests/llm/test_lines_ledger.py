"""Repeated lines and the ledger against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from assize.llm import ledger as L
from assize.llm.repeated_lines import RepeatedLines
from assize.llm.shingles import band_values, jaccard, shingles, window_hashes

SCHEMA = "para_id long, case_ord long, source_file string, text string, source string, k1 long"


def brute(rows, least=6, share=0.02):
    cases, docs, where = defaultdict(set), defaultdict(set), []
    for para, case, source, text in rows:
        if source is None:
            continue
        if case is not None:
            cases[source].add(case)
        for n, line in enumerate(re.split(r"\r?\n", text) if text is not None else [], 1):
            key = re.sub(r"\d+", "0", re.sub(r"[ \t]+", " ", line.strip(" \t")).lower())
            if key:
                where.append((para, n, source, key))
                if case is not None:
                    docs[source, key].add(case)
    return {(p, n) for p, n, s, k in where if len(docs[s, k]) >= least and len(docs[s, k]) >= share * len(cases[s])}


def rows_for(seed):
    rng = random.Random(seed)
    lines = ["Ends", "PAGE 3 of  9", "page 12 of 4 ", "Page 7 of 1", "Printed by Anna Bell", "Printed by Karl Horn", "", " ", "\t", "unique"]
    rows = []
    for i in range(400):
        text = rng.choice(["\n", "\r\n"]).join(rng.choice(lines) if rng.random() < 0.5 else f"the words of line {rng.random()} and more" for _ in range(rng.randrange(5)))
        rows.append((i, rng.randrange(60), rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else text))
    return rows + rows[:20] + [(1000, 5, "c", "x " * 50_000), (1001, None, "a", "Ends")]


def test_found(spark):
    rows = rows_for(1)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    op = RepeatedLines(df, "text", "source_file", "case_ord")
    got = {tuple(r) for r in op.found("para_id").collect()}
    assert got == brute(rows) and len(got) > 50
    clean = {r.para_id: (r.text, r.removed) for r in op.cleaned("para_id").collect()}
    bad = Counter(p for p, _ in got)
    for para, _, _, text in rows:
        assert (clean[para][0] is None) == (text is None)
        assert clean[para][1] == bad.get(para, 0)
        if text is not None and para in bad:
            kept = [line for n, line in enumerate(re.split(r"\r?\n", text), 1) if (para, n) not in got]
            assert clean[para][0] == "\n".join(kept)


def test_near_duplicates_form_one_cluster(spark):
    notice = "this decision was prepared for the readers of the portal by {} and may be copied for study purposes only"
    df = spark.createDataFrame([(i, i, "s", notice.format(["Anna", "Karl Horn", "Zoe", "Ida"][i % 4]) + (" now" if i % 3 == 0 else ""), "", 0) for i in range(40)], SCHEMA)
    report = RepeatedLines(df, "text", "source_file", "case_ord").report().collect()
    assert max(r.docs for r in report) == 40


def test_lines_come_through_the_clusters(spark):
    rows = rows_for(2)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    op = RepeatedLines(df, "text", "source_file", "case_ord")
    assert op.found("para_id").count() == len(brute(rows)) > 50
    off = RepeatedLines(df, "text", "source_file", "case_ord")
    off._made["clusters"] = spark.createDataFrame([], "source string, template string, core string")
    assert off.found("para_id").count() == 0


def test_case_parts_no_line(spark):
    # each spelling alone is in too few documents, and their templates differ
    spellings = ["Printed by Anna Bell", "printed by Anna bell", "printed by anna bell", "Printed By Anna Bell"]
    rows = [(i, i, "s", spellings[i % 4]) for i in range(8)] + [(i, i, "s", f"line of its own words {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(8, 60)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = {tuple(r) for r in RepeatedLines(df, "text", "source_file", "case_ord").found("para_id").collect()}
    assert got == brute(rows) == {(i, 1) for i in range(8)}


def test_near_duplicates_are_removed(spark):
    """Recall and precision of cleaning by clusters against all pairs of templates."""
    rng = random.Random(9)
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))  # noqa: E731  (digits would be masked)
    vocabulary = [word(i) for i in range(400)]
    notices = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 40))] for _ in range(12)]
    lines = []
    for i in range(900):
        words = list(rng.choice(notices)) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))]
        if rng.random() < 0.7:  # one word of the notice is another one
            words[rng.choice([0, 1, -1, -2])] = "v" + word(i)
        lines.append(" ".join(words))
    rows = [(i, i % 300, "s", "\n".join(lines[3 * i : 3 * i + 3])) for i in range(300)] + [(9999, 1, None, lines[0]), (9998, 1, "s", None)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    sets = [shingles(x.split(), 5) for x in lines]
    wanted = set()
    for n, own in enumerate(sets):
        close = {(m // 3) % 300 for m, other in enumerate(sets) if jaccard(own, other) >= 0.8}
        if len(close) >= 6:
            wanted.add(n)
    made = {r.para_id: (r.text, r.removed) for r in RepeatedLines(df, "text", "source_file", "case_ord").cleaned("para_id", near=True).collect()}
    assert len(made) == 302 and made[9999] == (lines[0], 0) and made[9998] == (None, 0)
    gone = {3 * i + k for i in range(300) for k in range(3) if lines[3 * i + k] not in made[i][0].split("\n")}
    assert sum(r for _, r in made.values()) == len(gone)
    assert len(gone & wanted) >= 0.9 * len(wanted) > 200 and len(gone - wanted) <= 0.05 * len(gone)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    op = RepeatedLines(df, "text", "source_file", "case_ord")
    assert op.found("para_id").count() == 0 and op.cleaned("para_id").count() == 0


def test_bands_find_similar_texts():
    rng, hits, n = random.Random(3), 0, 0
    for _ in range(200):
        a = [rng.randrange(10**9) for _ in range(40)]
        b = list(a)
        b[rng.randrange(40)] = 7
        if jaccard(shingles([str(x) for x in a], 5), shingles([str(x) for x in b], 5)) >= 0.74:
            n += 1
            (va, vb), _ = band_values([a, b], 5, 5, 2)
            hits += any(x == y for x, y in zip(va, vb))
    assert hits / n > 0.9
    assert band_values([[], [1]], 5, 2, 2)[0][0] is None


def test_windows():
    value, owner, at = window_hashes([[1, 2, 3], [], [2, 3], [9]], 2)
    assert owner.tolist() == [0, 0, 2, 3] and at.tolist() == [0, 1, 0, 0]
    assert value[1] == value[2] and len(np.unique(value)) == 3


CITES = [
    "A and B v. Poland, no. 12/95, § 7, 1 May 2001", "no 12/95; a AND b V POLAND; 1 may 2001; §7", "(no.) 12/95 | §  7 | 1 MAY 2001 | A and B v. Poland.", "A and B v. Poland, no. 12/95, § 7", "B and A v. Poland, no. 12/95, § 7, 1 May 2001",
    "A and B v. Poland, no. 12/95, § 71 May 2001", "  ", None, "", '"A and B v Poland no: 12/95 § 7 1 May 2001"', "A and B v. Poland, no. 12/95, 1 May 2001", "A and\tB  v. Poland - 1 May 2001 - no. 12/95",
]


def test_citations(spark):
    df = spark.createDataFrame([(i, c, "k") for i, c in enumerate(CITES, 1)], "citation_id long, citation string, key string")
    rows = L.keyed(df, L.citation_key(F.col("citation")), "citation_id")
    ledger = L.collapse(rows, 3)
    got = {tuple(r) for r in L.copies(rows, ledger).collect()}
    assert got == {(1, 2), (1, 3), (1, 10), (11, 12)}
    assert {r.citation_id: r.copies for r in L.collapsed(df, "citation", "citation_id", ledger).collect()} == {1: 4, 4: 1, 5: 1, 6: 1, 11: 2}


def test_ledger_grows_with_batches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 30 + [f"k{j}" for j in range(40)] + [None])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v string")
    folder = f"{L.scratch_folder(spark)}/test-ledger-{rng.random()}"
    ledger = L.Ledger(spark, folder, 16)
    shuffled = rows[300:] + rows[:300]
    for part, small in ((shuffled[:250], False), (shuffled[250:597], False), (shuffled[597:], True)):
        ledger.update(L.keyed(spark.createDataFrame(part, "id long, v string"), F.col("v"), "id"), small)
        # a session that knows nothing of the tables goes on from the manifest
        for t in spark.catalog.listTables():
            if t.name.startswith("ledger_"):
                spark.sql(f"DROP TABLE {t.name}")
        ledger = L.Ledger.open(spark, folder)
    want = defaultdict(list)
    for i, v in rows:
        if v:
            want[v].append(i)
    assert sorted((r.copies, r.first_id) for r in ledger.rows().collect()) == sorted((len(v), min(v)) for v in want.values())
    got = {tuple(r) for r in L.copies(L.keyed(df, F.col("v"), "id"), ledger).collect()}
    assert got == {(min(v), i) for v in want.values() for i in v if i != min(v)}
    # the small batch left most buckets as they were
    assert ledger.state["version"] == 3 and set(ledger.state["parts"]) == {2, 3} and ledger.state["copies"] == sum(map(len, want.values()))


def test_ledger_grows_and_refuses_a_second_writer(spark, monkeypatch):
    monkeypatch.setattr(L.Ledger, "ROWS_PER_BUCKET", 10)
    folder = f"{L.scratch_folder(spark)}/grow-{random.random()}"
    ledger = L.Ledger(spark, folder, 2)
    for start in (0, 100, 200):
        ledger.update(L.keyed(spark.range(start, start + 100), F.col("id").cast("string"), "id"))
    assert ledger.state["buckets"] > 2 and ledger.rows().count() == 300 == ledger.rows().select("k1", "k2").distinct().count()
    late = L.Ledger.open(spark, folder)
    late.state = late.state | {"version": late.state["version"] - 1}
    state = dict(late.state)
    try:
        late._save(late.state | {"version": late.state["version"] + 1})
        raise AssertionError("overwritten")
    except Exception as e:  # noqa: BLE001
        assert "exist" in str(e)
    assert late.state == state


def test_ledger_is_not_shuffled(spark):
    ledger = L.Ledger(spark)
    batch = L.keyed(spark.range(1000), F.col("id").cast("string"), "id")
    ledger.update(batch)
    fresh = batch.groupBy("k1", "k2").agg(F.min("id").alias("low"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.rows().join(fresh, ["k1", "k2"], "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # that of the batch


def test_ledger_empty(spark):
    df = spark.createDataFrame([], "citation_id long, citation string")
    rows = L.keyed(df, L.citation_key(F.col("citation")), "citation_id")
    assert L.copies(rows, L.collapse(rows)).count() == 0
