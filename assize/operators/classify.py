"""Text classification with labels on paragraphs: TF-IDF centroids of words or character n-grams, and keyword profiles.

Everything is long-form rows (document, token, weight). The model has a row per token, with the token's weight for each label. It is broadcast
if its bytes are few; beyond that it is joined on the token, where adaptive execution splits the rows of a hot token over several tasks. Dot products
and norm of a document come out of one sum per document, built up before the shuffle. Tables with a row per label are broadcast: labels are named by hand.

Character n-grams are some three for each character of text. They are counted within Arrow batches (``grams``), so that training shuffles sums per n-gram
and label only, and scoring nothing; only a model that is too large to send to every executor is joined as above.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assize.functions import text as X
from assize.functions.constants import MIN_LABELLED, SAMPLE_SIZE, THRESHOLDS
from assize.operators import grams as G
from assize.runtime import hinted, materialize

TOKENIZERS = {"tfidf_centroid": X.class_words, "char_ngram_centroid": X.char_ngrams, "keyword_overlap": X.class_words}
PROFILE_TOKENS, MAX_LABELS = 120, 5


def term_frequencies(docs: DataFrame, tokenizer, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, token, n, tf) with tf = count / number of tokens; documents without tokens give no rows."""
    tokens = docs.select(F.col(doc).alias("doc"), tokenizer(F.col(text)).alias("tokens"))
    rows = tokens.select("doc", F.size("tokens").alias("len"), F.explode("tokens").alias("token"))
    counts = rows.groupBy("doc", "len", "token").agg(F.count("*").alias("n"))
    return counts.select("doc", "token", "n", (F.col("n") / F.col("len")).alias("tf"))


def inverse_document_frequencies(tf: DataFrame, docs: int) -> DataFrame:
    """(token, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    return tf.groupBy("token").agg(F.count("*").alias("df")).select("token", (F.log(F.lit(docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weights(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc, token, w); a token without idf counts with idf 1."""
    return tf.join(idf, "token", "left").select("doc", "token", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))


def centroids(w: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, token, w): mean vector of each label's documents. ``labels``: (doc, label), several per document allowed."""
    sizes = labels.groupBy("label").agg(F.countDistinct("doc").alias("docs"))
    sums = w.join(labels, "doc").groupBy("label", "token").agg(F.sum("w").alias("w"))
    return sums.join(F.broadcast(sizes), "label").select("label", "token", (F.col("w") / F.col("docs")).alias("w"))


def norms(w: DataFrame, key: str) -> DataFrame:
    return w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def by_token(vectors: DataFrame, value: str = "w") -> DataFrame:
    """(token, per_label): the model with one row per token."""
    return vectors.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("label", value))).alias("per_label"))


def _sums(joined: DataFrame, labels: list[str], term, **others: Column) -> DataFrame:
    """(doc, label, s, *others): per document and label with a token in common the sum of ``term`` of the label's weights, in one aggregation."""
    weight = lambda name: F.try_element_at("per_label", F.lit(name))
    each = [F.struct(F.lit(name).alias("label"), F.sum(term(weight(name))).alias("s")) for name in labels]
    rows = joined.groupBy("doc").agg(F.filter(F.array(*each), lambda x: x["s"].isNotNull()).alias("found"), *[c.alias(n) for n, c in others.items()])
    return rows.select("doc", *others, F.inline("found"))


def cosines(w: DataFrame, model: DataFrame, label_norms: dict[str, float]) -> DataFrame:
    """(doc, label, score) of all pairs with a token in common. ``model``: by token."""
    joined = w.join(model, "token", "left")
    made = _sums(joined, sorted(label_norms), lambda c: F.col("w") * c, norm=F.sqrt(F.sum(F.col("w") * F.col("w"))))
    label_norm = F.element_at(F.create_map(*[F.lit(x) for pair in label_norms.items() for x in pair]), F.col("label"))
    return made.select("doc", "label", F.coalesce(F.try_divide(F.col("s"), F.col("norm") * label_norm), F.lit(0.0)).alias("score"))


def dense_scores(vectors: DataFrame, doc: str, label: str, x: str) -> DataFrame:
    """(doc, label, score): cosine of every dense vector with the mean vector of every label; no row is joined, the means travel as one value."""
    means = vectors.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(x).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("m"))
    # a row per label, of as many numbers as a vector has
    model = means.agg(F.collect_list(F.struct("label", "m")).alias("all"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(dot(a, a))
    score = lambda e: F.coalesce(F.try_divide(dot(F.col("x"), e["m"]), F.col("n") * norm(e["m"])), F.lit(0.0))
    rows = vectors.select(F.col(doc), F.col(x).alias("x"), norm(F.col(x)).alias("n")).withColumn("all", model.scalar())
    return rows.select(doc, F.inline(F.transform("all", lambda e: F.struct(e["label"].alias(label), score(e).alias("score")))))


def keyword_profiles(tf: DataFrame, idf: DataFrame, labels: DataFrame, k: int = PROFILE_TOKENS) -> DataFrame:
    """(label, token, weight, total): the heaviest tokens of each label; weight = share of the label's tokens * idf."""
    counts = tf.join(labels, "doc").groupBy("label", "token").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("all"))
    rows = counts.join(F.broadcast(totals), "label").join(idf, "token").select("label", "token", (F.col("n") / F.col("all") * F.col("idf")).alias("weight"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("weight"), "token"))).filter(F.col("rank") <= k)
    return rows.select("label", "token", "weight", F.sum("weight").over(Window.partitionBy("label")).alias("total"))


def keyword_scores(tokens: DataFrame, model: DataFrame, totals: dict[str, float]) -> DataFrame:
    """(doc, label, score): weight of the profile's tokens that the document has, over the profile's weight. ``tokens`` has each of a document once."""
    made = _sums(tokens.join(model, "token"), sorted(totals), lambda c: c)
    total = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("label"))
    return made.select("doc", "label", X.ratio(F.col("s"), total, 1.0).alias("score"))


def choose(scores: DataFrame, threshold: float, k: int = MAX_LABELS) -> DataFrame:
    """Labels at or above the threshold, the best ``k`` of each document."""
    w = Window.partitionBy("doc").orderBy(F.desc("score"), "label")
    return scores.filter(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass
class Model:
    """A trained model; its tables are written once and carry a broadcast hint if they are small, but for n-grams."""

    method: str
    threshold: float
    idf: DataFrame
    vectors: DataFrame  # centroids or keyword profiles
    tokens: DataFrame  # the same by token; for n-grams with their idf
    labels: dict[str, float]  # norm, or weight of the profile, by label
    examples: int

    def scores(self, docs: DataFrame, doc: str = "doc", text: str = "text", most: int = G.MODEL_BYTES) -> DataFrame:
        """(doc, label, score) of all pairs with a token in common. For n-grams ``doc`` is unique, and a model of at most ``most`` bytes is sent to every executor."""
        if not self.labels:
            return docs.sparkSession.createDataFrame([], "doc bigint, label string, score double")
        if self.method == "keyword_overlap":
            own = docs.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(TOKENIZERS[self.method](F.col(text)))).alias("token"))
            return keyword_scores(own, self.tokens, self.labels)
        if self.method != "char_ngram_centroid":
            tf = term_frequencies(docs, TOKENIZERS[self.method], doc, text)
        elif G.model_bytes(self.tokens.count(), len(self.labels)) <= most:
            norms = {x: self.labels[x] for x in sorted(self.labels)}
            each = [F.coalesce(F.try_element_at("per_label", F.lit(x)), F.lit(0.0)).alias(f"w{i}") for i, x in enumerate(norms)]
            return G.scores(docs, self.tokens.select("token", "idf", *each).toArrow(), norms, doc, text)
        else:
            tf = G.frequencies(docs, doc, text)
        return cosines(weights(tf, self.idf), self.tokens.select("token", "per_label"), self.labels)

    def predict(self, docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
        return choose(self.scores(docs, doc, text), self.threshold)


def sane_threshold(value: float | None, default: float = THRESHOLDS["tfidf_centroid"]) -> float:
    """Within 0.05 and 0.8; the default for what is no finite number."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return default
    return min(0.8, max(0.05, value))


def _enough(n: int) -> None:
    if n < MIN_LABELLED:
        raise ValueError(f"{n} labelled documents; {MIN_LABELLED} are needed")


def _train_grams(training: DataFrame, threshold: float | None) -> Model:
    """``training``: (text, labels), a row per document, each with a label at least."""
    method = "char_ngram_centroid"
    sums = materialize(G.label_sums(training), "gram-sums")
    sizes = {r.label: r for r in sums.filter("token = ''").collect()}  # a row per label
    _enough(n := sum(r.docs for r in sizes.values()))
    size = F.create_map(*[F.lit(x) for label, r in sizes.items() for x in (label, r.tf)])
    rows = sums.filter("token <> ''").groupBy("token").agg((F.log(F.lit(n + 1) / (F.sum("docs") + 1)) + 1).alias("idf"), F.map_from_entries(F.collect_list(F.struct("label", "tf"))).alias("sums"))
    made = materialize(rows.select("token", "idf", F.transform_values("sums", lambda k, v: v * F.col("idf") / F.element_at(size, k)).alias("per_label")), "gram-model")
    vectors = made.select("token", F.explode("per_label").alias("label", "w")).select("label", "token", "w")
    # not hinted: the tables are joined only where the model is too large to be sent
    return Model(method, sane_threshold(threshold, THRESHOLDS[method]), made.select("token", "idf"), vectors, made, {r.label: r.norm for r in norms(vectors, "label").collect()}, n)


def train(docs: DataFrame, labels: DataFrame | str, method: str = "tfidf_centroid", threshold: float | None = None, doc: str = "doc", text: str = "text") -> Model:
    """A model of the labelled documents; ``labels``: (doc, label), or the column of ``docs`` that holds the label. Needs at least MIN_LABELLED of them."""
    if isinstance(labels, str):
        docs = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.col(labels).alias("label")).filter("label is not null and label <> ''")
        if method == "char_ngram_centroid":
            return _train_grams(docs.select("text", F.array("label").alias("labels")), threshold)
        labels, doc, text = docs.select("doc", "label"), "doc", "text"
    labels = labels.filter("label is not null and label <> ''").distinct()
    if method == "char_ngram_centroid":
        own = labels.groupBy("doc").agg(F.collect_list("label").alias("labels"))
        return _train_grams(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(own, "doc").select("text", "labels"), threshold)
    training = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(labels.select("doc").distinct(), "doc", "left_semi")
    _enough(n := training.count())
    tf = materialize(term_frequencies(training, TOKENIZERS[method]), "tf")
    idf = hinted(materialize(inverse_document_frequencies(tf, n), "idf"))
    profile = method == "keyword_overlap"
    vectors = materialize(keyword_profiles(tf, idf, labels) if profile else centroids(weights(tf, idf), labels), "vectors")
    per_label = vectors.groupBy("label").agg(F.max("total") if profile else F.sqrt(F.sum(F.col("w") * F.col("w")))).collect()  # a row per label
    tokens = hinted(materialize(by_token(vectors, "weight" if profile else "w"), "vectors-by-token"))
    return Model(method, sane_threshold(threshold, THRESHOLDS[method]), idf, vectors, tokens, {r[0]: r[1] for r in per_label}, n)


# --- assignments: (doc, manual array<string>, predicted array<string>, excluded boolean)

ASSIGNMENTS = "doc bigint, manual array<string>, predicted array<string>, excluded boolean"


def no_assignments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ASSIGNMENTS)


def label_name(c: Column) -> Column:
    return X.squeeze(c)


def combined_labels() -> Column:
    """Manual labels, then predicted ones that are not manual; none if excluded."""
    return F.when(F.col("excluded"), F.array().cast("array<string>")).otherwise(F.array_union("manual", F.array_except("predicted", "manual")))


def with_change(a: DataFrame, edits: DataFrame) -> DataFrame:
    """Assignments with some rows replaced; rows that say nothing are dropped."""
    out = a.join(edits.select("doc"), "doc", "left_anti").unionByName(edits)
    return out.filter((F.size("manual") > 0) | (F.size("predicted") > 0) | F.col("excluded"))


def _row_of(a: DataFrame, docs: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    rows = docs.select("doc").distinct().join(a, "doc", "left")
    return rows.select("doc", *[F.coalesce(c, empty).alias(c) for c in ("manual", "predicted")], F.coalesce("excluded", F.lit(False)).alias("excluded"))


def toggle_label(a: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """The manual label on or off for ``docs``; on, it ends an exclusion."""
    rows = _row_of(a, docs)
    on = ~F.array_contains("manual", label)
    return with_change(a, rows.select("doc", F.when(on, F.array_append("manual", F.lit(label))).otherwise(F.array_remove("manual", label)).alias("manual"), "predicted", (F.col("excluded") & ~on).alias("excluded")))


def exclude(a: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents out of training and prediction; their labels go."""
    empty = F.array().cast("array<string>")
    return with_change(a, docs.select("doc").distinct().select("doc", empty.alias("manual"), empty.alias("predicted"), F.lit(True).alias("excluded")))


def clear(a: DataFrame, docs: DataFrame) -> DataFrame:
    return a.join(docs.select("doc"), "doc", "left_anti")


def remove_label(a: DataFrame, label: str) -> DataFrame:
    """The label taken from all documents; exclusions stay."""
    out = a.select("doc", F.array_remove("manual", label).alias("manual"), F.array_remove("predicted", label).alias("predicted"), "excluded")
    return out.filter((F.size("manual") > 0) | (F.size("predicted") > 0) | F.col("excluded"))


def apply_predictions(a: DataFrame, docs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted labels of ``docs`` replaced by new ones that are not manual; excluded documents are left alone."""
    empty = F.array().cast("array<string>")
    made = predictions.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("new"))
    rows = _row_of(a, docs).filter(~F.col("excluded")).join(made, "doc", "left")
    return with_change(a, rows.select("doc", "manual", F.array_except(F.coalesce("new", empty), "manual").alias("predicted"), "excluded"))


def changes(before: DataFrame, after: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: evaluated, tagged, labels assigned, and documents whose set of predicted labels changed."""
    empty = F.array().cast("array<string>")
    rows = docs.select("doc").distinct().join(before.select("doc", F.col("predicted").alias("old")), "doc", "left").join(after.select("doc", F.col("predicted").alias("new"), "excluded"), "doc", "left")
    rows = rows.filter(~F.coalesce("excluded", F.lit(False))).select(F.coalesce("old", empty).alias("old"), F.coalesce("new", empty).alias("new"))
    return rows.agg(F.count("*").alias("evaluated"), F.count_if(F.size("new") > 0).alias("tagged"), F.coalesce(F.sum(F.size("new")), F.lit(0)).alias("labels"), F.count_if(F.array_sort("old") != F.array_sort("new")).alias("changed"))


def counters(a: DataFrame, docs: DataFrame | None = None, sections: tuple[str, ...] = ()) -> DataFrame:
    """One row: documents with manual labels, with predicted ones, and excluded ones; with ``docs`` (doc, section) also those with manual labels in some sections."""
    manual = (F.size("manual") > 0) & ~F.col("excluded")
    inside = F.lit(False)
    if docs is not None:
        a = a.join(docs.filter(F.col("section").isin(*sections)).select("doc", F.lit(True).alias("__in")), "doc", "left")
        inside = F.coalesce("__in", F.lit(False))
    return a.agg(F.count_if(manual).alias("manual"), F.count_if(manual & inside).alias("manual_in_sections"), F.count_if((F.size("predicted") > 0) & ~F.col("excluded")).alias("predicted"), F.count_if("excluded").alias("excluded"))


def sample(docs: DataFrame, a: DataFrame, n: int = SAMPLE_SIZE, seed: int = 1) -> DataFrame:
    """``n`` documents to label: unlabelled ones first, each group in seeded random order."""
    done = a.filter((F.size("manual") > 0) | F.col("excluded")).select("doc", F.lit(1).alias("done"))
    return docs.join(done, "doc", "left").orderBy(F.coalesce("done", F.lit(0)), F.xxhash64(F.lit(seed), "doc"), "doc").limit(n).drop("done")


def valid_assignments(a: DataFrame, docs: DataFrame, labels: list[str]) -> DataFrame:
    """Saved assignments cut to known documents and labels."""
    known = F.array(*[F.lit(x) for x in labels]).cast("array<string>")
    out = a.join(docs.select("doc"), "doc", "left_semi").select("doc", *[F.array_intersect(c, known).alias(c) for c in ("manual", "predicted")], "excluded")
    return out.filter((F.size("manual") > 0) | (F.size("predicted") > 0) | F.col("excluded"))


def default_sections(present: list[str]) -> list[str]:
    both = [s for s in ("merits", "admissibility") if s in present]
    return both or sorted(present)


# --- saved progress


def progress(a: DataFrame, model: Model | None, dataset_key: str, labels: list[str], sections: dict[str, list[str]], sample_keys: list[int], cursor: int, saved_at: str) -> dict:
    """Labels, assignments and model as one dictionary. Assignments are made by hand and their predictions; both are of a size that a person handles."""
    out = {
        "version": 1, "datasetKey": dataset_key, "labels": labels, "trainingSections": sections.get("training", []), "predictionSections": sections.get("prediction", []),
        "sampleKeys": sample_keys, "sampleCursor": cursor, "method": model.method if model else "tfidf_centroid", "threshold": model.threshold if model else THRESHOLDS["tfidf_centroid"], "savedAt": saved_at,
        "assignments": [{"key": r.doc, "manual": r.manual, "predicted": r.predicted, "excluded": r.excluded} for r in a.orderBy("doc").toLocalIterator()], "model": None,
    }
    if model:
        out["model"] = {"method": model.method, "trainingSize": model.examples, "threshold": model.threshold, "labels": model.labels}
    return out


def save_model(model: Model, folder: str) -> None:
    """The model's tables below a folder; they stay distributed."""
    model.idf.write.mode("overwrite").parquet(f"{folder}/idf")
    model.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    model.tokens.write.mode("overwrite").parquet(f"{folder}/tokens")


def load_model(spark: SparkSession, folder: str, saved: dict) -> Model:
    """The model of saved progress, with the tables that ``save_model`` wrote."""
    idf, vectors, tokens = (spark.read.parquet(f"{folder}/{name}") for name in ("idf", "vectors", "tokens"))
    return Model(saved["method"], saved["threshold"], hinted(idf), vectors, hinted(tokens), saved["labels"], saved["trainingSize"])


def distinct_labels(labels: list) -> list[str]:
    """Labels with white space levelled; of those that differ in case only the first stays, blanks go."""
    seen: dict[str, str] = {}
    for x in labels:
        name = " ".join(str(x).split())
        if name:
            seen.setdefault(name.lower(), name)
    return list(seen.values())


def restore(payload: dict, docs: DataFrame) -> tuple[list[str], DataFrame, list[int], int]:
    """Labels, assignments, sample keys and cursor of saved progress, cut to known documents and labels."""
    spark = docs.sparkSession
    if payload.get("version") != 1:
        raise ValueError("unknown version of saved progress")
    labels = distinct_labels(payload.get("labels") or [])
    saved = payload.get("assignments") or []
    saved = [{"key": k, **v} for k, v in saved.items()] if isinstance(saved, dict) else saved
    rows = [(int(x["key"]), distinct_labels(x.get("manual") or []), distinct_labels(x.get("predicted") or []), bool(x.get("excluded"))) for x in saved]
    assignments = valid_assignments(spark.createDataFrame(rows, ASSIGNMENTS), docs, labels)
    keys = [int(k) for k in payload.get("sampleKeys") or []]
    known = {r.doc for r in docs.join(spark.createDataFrame([(k,) for k in keys], "doc long"), "doc", "left_semi").select("doc").collect()}  # at most as many as sample keys
    keys = [k for k in keys if k in known]
    return labels, assignments, keys, max(0, min(int(payload.get("sampleCursor") or 0), len(keys) - 1)) if keys else 0
