"""Classification against plain Python; sources, sinks and streams."""

import json
import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assize import runtime as R
from assize.functions import text as X
from assize.operators import classify as C
from assize.operators import grams as G
from assize.sources import jsonl, sinks
from assize.streaming import ingest

DOCS = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "gamma gamma delta"), (4, "delta alpha"), (5, "beta beta"), (6, "gamma delta epsilon"), (7, "beta alpha zeta"), (8, ""), (9, None)]
LABELS = [(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "x"), (5, "y"), (6, "y")]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(DOCS, "doc long, text string"), spark.createDataFrame(LABELS, "doc long, label string")


def test_centroids_and_cosine(spark, data):
    docs, labels = data
    model = C.train(docs, labels)
    texts = dict(DOCS)
    ids = sorted({d for d, _ in LABELS})
    df = Counter(t for d in ids for t in set(texts[d].split()))
    idf = {t: math.log((len(ids) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vec = lambda s: {t: n / len(s.split()) * idf.get(t, 1.0) for t, n in Counter(s.split()).items()}
    cen = {}
    for label in "xy":
        own = [d for d, k in LABELS if k == label]
        c = Counter()
        for d in own:
            for t, w in vec(texts[d]).items():
                c[t] += w / len(own)
        cen[label] = c
    dot = lambda a, b: sum(w * b.get(t, 0) for t, w in a.items())
    got = {(r.doc, r.label): r.score for r in model.scores(docs.filter("doc = 7")).collect()}
    v = vec(texts[7])
    want = {(7, k): dot(v, c) / math.sqrt(dot(v, v) * dot(c, c)) for k, c in cen.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert [r.label for r in model.predict(docs.filter("doc = 7")).collect()] == ["x", "y"]
    assert model.scores(docs.filter("doc > 7")).count() == 0


@pytest.mark.parametrize("method", ["char_ngram_centroid", "keyword_overlap"])
def test_other_methods(spark, data, method):
    docs, labels = data
    assert C.train(docs, labels, method).scores(docs).filter("score < 0 or score > 1.0000001").count() == 0


def test_too_few(data):
    docs, labels = data
    with pytest.raises(ValueError):
        C.train(docs, labels.filter("doc < 3"))


def test_assignments(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc long")
    a = C.toggle_label(C.no_assignments(spark), docs.filter("doc < 3"), "x")
    a = C.exclude(a, docs.filter("doc = 2"))
    predictions = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "y", 1), (3, "y", 1)], "doc long, label string, rank int")
    after = C.apply_predictions(a, docs, predictions)
    rows = {r.doc: (r.manual, r.predicted, r.excluded) for r in after.collect()}
    assert rows == {1: (["x"], ["y"], False), 2: ([], [], True), 3: ([], ["y"], False)}
    assert tuple(C.changes(a, after, docs).first()) == (2, 2, 2, 2)
    assert tuple(C.counters(after).first()) == (1, 0, 2, 1)
    assert {r.doc for r in C.remove_label(after, "y").collect()} == {1, 2}
    assert C.sample(docs, after, 1).first().doc == 3
    assert C.valid_assignments(after, docs.filter("doc = 1"), ["y"]).first().manual == []
    assert C.toggle_label(a, docs.filter("doc = 1"), "x").filter("doc = 1").count() == 0
    assert C.sane_threshold(float("nan")) == 0.22 and C.sane_threshold(3) == 0.8 and C.default_sections(["merits", "x"]) == ["merits"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"case_id": "1", "paragraphs": [{"section": "Merits", "text": "t", "para_idx": 4}], "defendants": ["A"], "keywords": "a;b"}\n\n5\n{bad\n[{"case_id": "2"}]\n"x"\nnull\n')
    rows, counts = jsonl.read_tolerant(spark, str(p))
    assert tuple(counts.first()) == (6, 1, 5)
    r = rows.first()
    assert r.case_id == "1" and r.defendants == '["A"]' and r.paragraphs[0].para_idx == "4"
    assert rows.select(X.list_of(F.col("keywords")).alias("k")).first().k == ["a", "b"]
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p)).collect()
    with pytest.raises(ValueError):
        jsonl.require_rows(rows.filter("false"))
    assert jsonl.resolve([str(p)]) == str(p)
    with pytest.raises(FileNotFoundError):
        jsonl.resolve([str(tmp_path / "none")])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b"'), (1, None)], "case_ord int, t string")
    assert sinks.write_csv_file(df, str(tmp_path / "o.csv")) == 2
    assert (tmp_path / "o.csv").read_bytes() == b'\xef\xbb\xbf"case_ord","t"\n"2","a ""b"""\n"1",""\n'
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).count() == 2
    sinks.write_sample(df, str(tmp_path / "s"), 1)
    assert spark.read.json(str(tmp_path / "s")).first().case_ord == 1
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_payload({"ä": 1}, str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text()) == {"ä": 1} and jsonl.read_payload(spark, str(tmp_path / "p.json")).count() == 1
    sinks.save_state(df, str(tmp_path / "st"), "k")
    assert sinks.load_state(spark, str(tmp_path / "st"), "k").count() == 2
    assert sinks.export_name('a "b" ' + "c" * 50) == "search_a_b_" + "c" * 24 + ".csv"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"case_id": "1", "paragraphs": [{"section": "Merits", "text": "t"}, {"text": " "}]}\n{bad\n')
    rows = ingest.stream_paragraphs(ingest.stream_cases(spark, str(tmp_path / "in")))
    ingest.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.case_id, r.section) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1", "merits")]
    q = ingest.stream_section_counts(rows).writeStream.format("memory").queryName("sections").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sections").first().n == 1


def test_stream_keeps_every_object(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = '{"case_id": "1", "paragraphs": [{"text": "t"}]}'
    deep = '{"case_id": "d", "x": ' + "[" * 5000 + "]" * 5000 + ', "n": ' + "7" * 5000 + ', "violation": "6", "paragraphs": [{"text": "deep"}]}'
    lines = [one, "{bad", "[1]", "null", "5", "", '{"title": "no id", "paragraphs": [{"text": "u"}]}', one, '{"case_id": " ", "paragraphs": [{"text": "v"}]}', deep]
    (tmp_path / "in/a.json").write_text("\n".join(lines) + "\n")
    cases = ingest.stream_cases(spark, str(tmp_path / "in"))
    ingest.write_stream(cases.select("case_ord", "case_id", "title"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 5 == len({r.case_ord for r in rows})
    assert sorted(r.case_id if r.case_id in ("1", "d") else "made" for r in rows) == ["1", "1", "d", "made", "made"]
    assert all(r.case_id == f"case-{r.case_ord}" for r in rows if r.case_id not in ("1", "d"))
    records, counts = jsonl.read_tolerant(spark, str(tmp_path / "in"))
    assert records.count() == 5 and tuple(counts.first()) == (9, 5, 4)


def test_cli_and_records(spark, tmp_path):
    from assize import cli
    from assize.operators import search as S
    from assize.operators.corpus import Corpus

    rows = [
        {"case_id": "a", "title": "A v. B", "judgment_date": "03/04/2020", "keywords": "x; y", "strasbourg_caselaw": ["P  v. Q", "p v. q", "R v. S"], "chamber_composed_of": ["Ana"], "violation": ["6"], "domestic_law": "Act", "rules_of_court": False, "originating_body": ["Section 1"], "paragraphs": [{"section": "Merits", "text": "The court"}]},
        {"case_id": "a", "non-violation": ["8"], "domestic_law": [], "paragraphs": None},
    ]
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    got = cli.run(spark, cli.arguments(["--input", str(p), "--output", str(tmp_path / "s.json"), "--sample-output", str(tmp_path / "sample"), "--sample-size", "1", "--export-data", str(tmp_path / "copy"), "--report"]))
    assert got["summary"]["total_cases"] == 2 and got["summary"]["invalid_lines"] == 1 and got["summary"]["avg_strasbourg_citations_per_case"] == 1.0
    assert json.loads((tmp_path / "s.json").read_text())["summary"] == got["summary"]
    records, _ = jsonl.read_tolerant(spark, str(p))
    c = Corpus.from_records(records)
    assert {r.case_id for r in c.cases.collect()} == {"a", "a-2"}
    assert [r.case_id for r in S.search(c, "", S.Filters(present=("domestic_law",))).collect()] == ["a"]
    assert S.search(c, "", S.Filters(present=("rules_of_court",))).count() == 0
    assert S.search(c, "keyword:y court").count() == 1 and len(c.dataset_key()) > 3


def test_progress_round_trip(spark, data):
    docs, labels = data
    a = C.toggle_label(C.no_assignments(spark), docs.filter("doc < 3"), "x")
    saved = json.loads(json.dumps(C.progress(a, C.train(docs, labels), "k", ["x", " X ", "y", ""], {}, [1, 99, 2], 7, "now")))
    names, back, keys, cursor = C.restore(saved, docs)
    assert names == ["x", "y"] and keys == [1, 2] and cursor == 1
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, a.collect()))
    assert saved["model"]["labels"].keys() == {"x", "y"}
    folder = f"{R.scratch_folder(spark)}/model"
    for method in C.TOKENIZERS:
        model = C.train(docs, labels, method)
        C.save_model(model, folder)
        again = C.load_model(spark, folder, C.progress(a, model, "k", ["x"], {}, [], 0, "now")["model"])
        assert sorted(map(tuple, again.scores(docs).collect())) == sorted(map(tuple, model.scores(docs).collect()))
    with pytest.raises(ValueError):
        C.restore({"version": 2}, docs)


def test_copy_keeps_everything(spark, tmp_path):
    data = b'{"case_id": "1", "other": {"x": [1]}}\n{bad\n\n[1]\r\n\xff'
    (tmp_path / "in.jsonl").write_bytes(data)
    assert sinks.copy_input(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out/copy.jsonl"))
    assert (tmp_path / "out/copy.jsonl").read_bytes() == data
    assert not sinks.copy_input(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "in.jsonl")) and (tmp_path / "in.jsonl").read_bytes() == data


def test_dense_scores(spark):
    rows = [(1, "a", [1.0, 0.0], "u"), (2, "b", [0.0, 2.0], "u"), (3, None, [1.0, 1.0], "u"), (4, "a", [0.0, 0.0], "u"), (5, "b", None, "u")]
    got = {(r.vec_id, r.label): r.score for r in C.dense_scores(spark.createDataFrame(rows, "vec_id long, label string, x array<double>, score string"), "vec_id", "label", "x").collect()}
    assert got[1, "a"] == 1 and got[1, "b"] == 0 and got[3, "b"] == pytest.approx(0.5**0.5) and got[4, "a"] == 0 and got[5, "b"] == 0


def test_paragraphs_of_any_shape(spark, tmp_path):
    lines = ['{"paragraphs": [{"text": "a", "para_idx": 3, "notes": [1]}, null, "bare", 5, {"text": ["x"]}]}', '{"paragraphs": "[{\\"text\\": \\"b\\"}]"}', '{"paragraphs": {"text": "c"}}', '{"paragraphs": "d"}', '{"paragraphs": null}', '{"paragraphs": []}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows, _ = jsonl.read_tolerant(spark, str(tmp_path))
    got = [None if r.paragraphs is None else [p and p.text for p in r.paragraphs] for r in rows.orderBy("line_order").collect()]
    assert got == [["a", None, "bare", "5", '["x"]'], ["b"], ["c"], ["d"], None, []]


GRAM_TEXTS = [
    (1, "The court holds, the court finds.", ["x"]), (2, "A b c - d", ["x", "y"]), (3, "naïve Café  No.\u000b12", ["y"]), (4, "", ["y"]), (5, None, ["x"]),
    (6, "§§ !", ["y"]), (7, "ab\r\n\tab ab", ["x"]), (8, "the court held otherwise", []), (9, "q", []), (10, "zzz unseen 777", []), (11, "İstanbul Kelvin", ["y"]),
]


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_grams_in_batches(spark, monkeypatch, chunk):
    """Batches cut anywhere, within a text too, give the n-grams of the column expression."""
    docs = spark.createDataFrame(GRAM_TEXTS, "doc long, text string, labels array<string>")
    want = {(r.doc, r.token): (r.n, pytest.approx(r.tf)) for r in C.term_frequencies(docs, X.char_ngrams).collect()}
    monkeypatch.setattr(G, "CHUNK", chunk)
    rows = pa.RecordBatch.from_pandas(docs.select("doc", F.lower("text").alias("text")).toPandas())
    got = {}
    for lo, code, text, n, total in G._counted(rows["text"].cast(pa.string()).fill_null("")):
        for t, i, k in zip(G.decode(code).to_pylist(), text, n):
            got[rows["doc"][lo + int(i)].as_py(), t] = (k, k / total[i])
        assert (G.encode(G.decode(code)) == code).all()
    assert got == want
    assert {(r.doc, r.token): (r.n, r.tf) for r in G.frequencies(docs).collect()} == want


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_gram_sums_handed_on_early(monkeypatch, held):
    """Sums per label add up, however early a partition hands them on."""
    batch = pa.RecordBatch.from_pydict({"text": [t and t.lower() for _, t, _ in GRAM_TEXTS], "labels": pa.array([k for *_, k in GRAM_TEXTS], pa.list_(pa.string()))})
    monkeypatch.setattr(G, "HELD", held)
    monkeypatch.setattr(G, "CHUNK", 40)
    got = Counter()
    for made in G._label_sums(iter([batch, batch.slice(0, 0), batch])):
        for r in made.to_pylist():
            got.update({("docs", r["token"]): r["docs"], ("tf", r["token"], r["label"]): r["tf"]})
    assert got["docs", ""] == 16 and got["tf", "", "x"] == 8 and got["tf", "", "y"] == 10
    assert got["docs", "cou"] == 2 and got["docs", " ab"] == 2


def _gram_model_by_rows(docs, labels):
    """(vectors, scores) by the definition: a row per document and n-gram, joined with the labels."""
    tf = C.term_frequencies(docs.join(labels.select("doc").distinct(), "doc"), X.char_ngrams)
    idf = C.inverse_document_frequencies(tf, labels.select("doc").distinct().count())
    vectors = C.centroids(C.weights(tf, idf), labels)
    norms = {r.label: r.norm for r in C.norms(vectors, "label").collect()}
    scores = C.cosines(C.weights(C.term_frequencies(docs, X.char_ngrams), idf), C.by_token(vectors), norms)
    return {(r.label, r.token): r.w for r in vectors.collect()}, {(r.doc, r.label): r.score for r in scores.collect()}


def test_gram_model_without_a_row_per_gram(spark):
    """Training shuffles sums and scoring nothing: no explode, no join and no shuffle in the plan of the scores, and the same model and scores as by rows."""
    docs = spark.createDataFrame(GRAM_TEXTS, "doc long, text string, labels array<string>")
    labels = docs.select("doc", F.explode("labels").alias("label"))
    vectors, want = _gram_model_by_rows(docs, labels)
    model = C.train(docs, labels, "char_ngram_centroid")
    assert {(r.label, r.token): r.w for r in model.vectors.collect()} == pytest.approx(vectors) and model.examples == 8
    scores = model.scores(docs)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Generate", "Join", "Exchange", "Aggregate"))
    assert {(r.doc, r.label): r.score for r in scores.collect()} == pytest.approx(want)
    assert {(r.doc, r.label): r.score for r in model.scores(docs, most=0).collect()} == pytest.approx(want)  # joined where the model is too large to be sent
    assert not {9, 10} & {d for d, _ in want}


def test_grams_labels_in_a_column(spark, tmp_path):
    docs = spark.createDataFrame(GRAM_TEXTS, "doc long, text string, labels array<string>").withColumn("label", F.get("labels", F.lit(0)))
    by_column, by_frame = C.train(docs, "label", "char_ngram_centroid"), C.train(docs, docs.select("doc", "label"), "char_ngram_centroid")
    rows = lambda m: {(r.label, r.token): r.w for r in m.vectors.collect()}
    assert rows(by_column) == pytest.approx(rows(by_frame)) and by_column.examples == by_frame.examples == 8
    words = C.train(docs, "label")
    assert rows(words) == pytest.approx(rows(C.train(docs, docs.select("doc", "label"))))
    with pytest.raises(ValueError):
        C.train(docs.filter("doc < 6"), "label", "char_ngram_centroid")
    C.save_model(by_column, str(tmp_path))
    saved = {"method": by_column.method, "threshold": by_column.threshold, "labels": by_column.labels, "trainingSize": by_column.examples}
    found = lambda m: {(r.doc, r.label): r.score for r in m.scores(docs).collect()}
    assert found(C.load_model(spark, str(tmp_path), saved)) == pytest.approx(found(by_column))
