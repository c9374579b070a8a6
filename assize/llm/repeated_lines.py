"""Problem 1: lines that one source repeats across its documents.

Lines are masked (numbers, dates, names), the masked lines of each source are clustered by MinHash
bands, and the lines of clusters that can occur in many of the source's documents are the candidates. ``found`` and ``cleaned`` count
the candidates exactly, line by line; ``cleaned`` with ``near`` removes whole clusters of near-duplicates by the exact number of their documents.
All grouping is on (source, line) or (source, band, value), never on the source alone, with map-side combination, so
that a source with a third of all rows is spread over all tasks.

Defined results: null texts have no lines; a null source takes part in nothing; empty lines are never
repeated; repeated rows of a document count once for the frequency and are all reported.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.llm.shingles import WordIds, band_values, jaccard, shingles
from assize.runtime import broadcast_if_small, materialize

#: English names of months, masked as parts of dates (fixed values).
MONTHS = "january february march april may june july august september october november december".split()
_MONTHS = frozenset(MONTHS)

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 5, 2


def split_lines(text: Column) -> Column:
    """The lines of ``text``: parted at LF, a CR before it belonging to the line end."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def _level(line: Column) -> Column:
    """The line with runs of blanks and tabs as one blank, none outside, and runs of digits as 0."""
    # most lines have single blanks only, and need no pattern
    uneven = line.contains("  ") | line.contains("\t")
    return F.regexp_replace(F.trim(F.when(uneven, F.regexp_replace(line, "[ \t]{2,}|\t", " ")).otherwise(line)), r"\p{Nd}+", "0")


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: blanks, letter case and digits levelled."""
    return F.lower(_level(line))


def mask_line(line: Column) -> Column:
    """The template of a line: numbers as 0, capitalised words (names, months) as @, the rest in lower case."""
    x = _level(line)
    # a line all in capitals says nothing about names
    named = F.regexp_replace(x, r"(?=\p{Lu})(?<!\p{L})\p{Lu}[\p{L}\p{M}'’-]*+(?: \p{Lu}[\p{L}\p{M}'’-]*+)*+", "@")
    return F.lower(F.when(F.upper(x) == x, x).otherwise(named))


def _line_rows(df: DataFrame, text: str, source: str, doc: str, keep: list[str]) -> DataFrame:
    rows = df.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
        F.col(source).alias("source"),
        F.col(doc).alias("doc"),
        F.posexplode(split_lines(F.col(text))).alias("pos", "line"),
    )
    rows = rows.filter(F.btrim(F.col("line"), F.lit(" \t")) != "")
    key = line_key(F.col("line"))
    # two differently seeded hashes stand for the line
    return rows.select("*", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(11), key).alias("k2"))


def words_of(template: str) -> list[str]:
    """The words of a template, months in small letters masked like those in capitals."""
    return ["@" if w in _MONTHS else w for w in template.split()]


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids = WordIds()
    for b in batches:
        if len(ids) > 500_000:
            ids.clear()
        values, sizes = band_values([[ids[w] for w in words_of(t)] for t in b["template"]], SHINGLE, BANDS, ROWS)
        yield b.assign(values=values, size=sizes)


@functools.lru_cache(maxsize=8_192)
def _core_shingles(core: str) -> set:
    return shingles(words_of(core), SHINGLE)


@F.pandas_udf(T.BooleanType())
def _close(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, own, known = [], None, set(), {}
    for x, core in zip(a, b):
        if x != last:  # the bands of a template stand together and often lead to the same core
            last, own, known = x, shingles(words_of(x), SHINGLE), {}
        if core not in known:
            known[core] = x == core or jaccard(own, _core_shingles(core)) >= SIMILARITY
        out.append(known[core])
    return pd.Series(out, dtype=bool)


class RepeatedLines:
    """Lines of ``text`` that documents (``doc``) of one ``source`` repeat.

    ``min_docs`` and ``min_share`` (of the source's documents) say how often is too often.
    """

    def __init__(self, df: DataFrame, text: str, source: str, doc: str, min_docs: int = 6, min_share: float = 0.02):
        self.df, self.text, self.source, self.doc = df, text, source, doc
        self.min_docs, self.millionths = min_docs, round(min_share * 1_000_000)
        self._made: dict[str, DataFrame] = {}

    def limits(self) -> DataFrame:
        """Per source the least number of documents that is too many."""
        if "limits" not in self._made:
            docs = self.df.select(F.col(self.source).alias("source"), F.col(self.doc).alias("doc")).filter("source is not null and doc is not null").distinct()
            share = F.ceil(F.count("*") * F.lit(self.millionths) / F.lit(1_000_000) - F.lit(1e-9))
            least = F.greatest(F.lit(self.min_docs).cast("long"), share).alias("least")
            self._made["limits"] = broadcast_if_small(docs.groupBy("source").agg(least), label="line-limits")
        return self._made["limits"]

    def keys(self) -> DataFrame:
        """(source, k1, k2, template, most): every distinct line and template with the most documents it can be in.

        ``most`` is exact for lines of one document and counts all occurrences of others; exact numbers are
        made later, for the few lines for which they can matter.
        """
        if "keys" not in self._made:
            rows = _line_rows(self.df, self.text, self.source, self.doc, []).select("source", "k1", "k2", mask_line(F.col("line")).alias("template"), "doc")
            found = rows.groupBy("source", "k1", "k2", "template").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"))
            most = F.when(F.col("low") == F.col("high"), F.lit(1).cast("long")).otherwise(F.col("n"))
            self._made["keys"] = materialize(found.select("source", "k1", "k2", "template", most.alias("most")), "line-keys")
        return self._made["keys"]

    def _heavy(self) -> DataFrame:
        """(source, k1, k2, total, canon): lines that can be in too many documents, with the hash of one of their templates; few, as a document has few lines."""
        if "heavy" not in self._made:
            sums = self.keys().groupBy("source", "k1", "k2").agg(F.sum("most").alias("total"), F.max(F.xxhash64("template")).alias("canon"))
            self._made["heavy"] = broadcast_if_small(sums.join(self.limits(), "source").filter("total >= least").drop("least"), label="heavy-lines")
        return self._made["heavy"]

    def _templates(self) -> DataFrame:
        """(source, template, most, values, size): the distinct templates with their bands.

        Spellings of one line in different case have different templates. One of these stands for all of them, so that
        what the line weighs is not parted between clusters.
        """
        if "templates" not in self._made:
            whole = self.keys().join(self._heavy(), ["source", "k1", "k2"]).filter(F.xxhash64("template") == F.col("canon")).select("source", "template", F.col("total").alias("most"))
            t = self.keys().select("source", "template", "most").unionByName(whole).groupBy("source", "template").agg(F.sum("most").alias("most"))
            self._made["templates"] = materialize(t.mapInPandas(_bands, "source string, template string, most long, values array<long>, size int"), "line-templates")
        return self._made["templates"]

    def clusters(self) -> DataFrame:
        """(source, template, core): the templates of near-duplicate clusters that can be in too many documents.

        The core of a band value is its most frequent template; templates that share the value and have at least SIMILARITY of
        their shingles in common with the core are the cluster. Copies share all bands. A template that resembles none of its
        cores leads a cluster of its own.
        """
        if "clusters" not in self._made:
            t = self._templates()
            # frequency and a short hash in one number, so that the most frequent template is a maximum of numbers
            short = F.xxhash64("template").bitwiseAND(0x7FFFFFFF)
            by_value = t.select("source", "most", (F.shiftleft(F.least("most", F.lit(2**31)), 31) + short).alias("rank"), F.posexplode("values").alias("band", "value"))
            sums = by_value.groupBy("source", "band", "value").agg(F.sum("most").alias("total"), F.max("rank").alias("top"))
            sums = sums.join(self.limits(), "source").withColumn("own", F.shiftright("top", 31)).filter("total > own or own >= least")
            sums = materialize(sums.select("source", "band", "value", "total", "own", "least", F.col("top").bitwiseAND(0x7FFFFFFF).alias("core_id")), "line-buckets")
            # what a cluster can weigh: its core and, over all bands, what shares a value with it
            weight = sums.groupBy("source", "core_id").agg((F.sum(F.col("total") - F.col("own")) + F.max("own")).alias("weight"), F.max("least").alias("least"))
            cores = sums.join(weight.filter("weight >= least").select("source", "core_id"), ["source", "core_id"], "left_semi").select("source", "band", "value", "core_id")
            # two templates with one short hash are two cores
            text = t.select(F.col("source").alias("s2"), short.alias("t2"), F.col("template").alias("core"), F.col("size").alias("core_size"))
            cores = cores.join(text, (F.col("source") == F.col("s2")) & (F.col("core_id") == F.col("t2"))).select("source", "band", "value", "core", "core_size")
            cores = broadcast_if_small(cores, label="line-cores")
            hits = t.select("source", "template", "most", "size", F.posexplode("values").alias("band", "value")).join(cores, ["source", "band", "value"])
            # sets as similar as that differ less in size
            hits = hits.filter(F.least("size", "core_size") >= F.greatest("size", "core_size") * F.lit(SIMILARITY))
            near = materialize(hits.filter(_close("template", "core")).select("source", "template", "core", "most").distinct(), "line-links")
            alone = t.join(self.limits(), "source").filter("most >= least").join(near, ["source", "template"], "left_anti")
            members = near.unionByName(alone.select("source", "template", F.col("template").alias("core"), "most"))
            heavy = members.groupBy("source", "core").agg(F.sum("most").alias("total")).join(self.limits(), "source").filter("total >= least").select("source", "core")
            self._made["clusters"] = members.join(heavy, ["source", "core"], "left_semi").select("source", "template", "core")
        return self._made["clusters"]

    def _candidates(self) -> DataFrame:
        """(source, k1, k2) of the lines of the clusters that can be too frequent themselves."""
        if "candidates" not in self._made:
            lines = self.keys().join(self.clusters().select("source", "template").distinct(), ["source", "template"], "left_semi").select("source", "k1", "k2").distinct()
            self._made["candidates"] = broadcast_if_small(lines.join(self._heavy(), ["source", "k1", "k2"], "left_semi"), label="line-candidates")
        return self._made["candidates"]

    def _exact(self, rows: DataFrame) -> DataFrame:
        """(source, k1, k2) of the candidates in ``rows`` that are, exactly counted, in too many documents."""
        docs = rows.filter("doc is not null").select("source", "k1", "k2", "doc").distinct().groupBy("source", "k1", "k2").agg(F.count("*").alias("docs"))
        return docs.join(self.limits(), "source").filter("docs >= least").select("source", "k1", "k2")

    def frequent(self) -> DataFrame:
        """(source, k1, k2) of the repeated lines."""
        rows = _line_rows(self.df, self.text, self.source, self.doc, []).select("source", "k1", "k2", "doc")
        return self._exact(rows.join(self._candidates(), ["source", "k1", "k2"], "left_semi"))

    def found(self, row_id: str) -> DataFrame:
        """(row id, line_no) of every repeated line."""
        rows = _line_rows(self.df, self.text, self.source, self.doc, [row_id]).select("source", "k1", "k2", "doc", "__k0", "pos")
        rows = materialize(rows.join(self._candidates(), ["source", "k1", "k2"], "left_semi"), "candidate-lines")
        often = broadcast_if_small(self._exact(rows), label="frequent-lines")
        return rows.join(often, ["source", "k1", "k2"], "left_semi").select(F.col("__k0").alias(row_id), (F.col("pos") + 1).cast("int").alias("line_no")).distinct()

    def cleaned(self, row_id: str, near: bool = False) -> DataFrame:
        """(row id, text, removed): every row, without the repeated lines; a null text stays null.

        With ``near`` the lines of whole clusters go, if the documents of a cluster's lines together are too many.
        """
        return self._without_clusters(row_id) if near else self._without_lines(row_id)

    def _without_lines(self, row_id: str) -> DataFrame:
        # a document has few lines, and each of these is in a share of all documents: few per source
        per_source = self.frequent().groupBy("source").agg(F.collect_set(F.struct("k1", "k2")).alias("often"))
        per_source = broadcast_if_small(per_source, label="frequent-by-source")
        lines = split_lines(F.col("__text"))

        def kept(x: Column) -> Column:
            key = line_key(x)
            return ~F.array_contains(F.col("often"), F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(11), key).alias("k2")))

        rows = self.df.select(F.col(row_id).alias("__id"), F.col(self.source).alias("source"), F.col(self.text).alias("__text"))
        rows = rows.join(per_source, "source", "left").withColumn("rest", F.when(F.col("often").isNotNull(), F.filter(lines, kept)))
        text = F.when(F.col("rest").isNull() | (F.size("rest") == F.size(lines)), F.col("__text")).otherwise(F.array_join("rest", "\n"))
        removed = F.when(F.col("rest").isNotNull(), F.size(lines) - F.size("rest")).otherwise(0)
        return rows.select(F.col("__id").alias(row_id), text.alias("text"), removed.alias("removed"))

    def _without_clusters(self, row_id: str) -> DataFrame:
        # the lines of a cluster may be many: their places are joined to the rows
        lines = _line_rows(self.df, self.text, self.source, self.doc, [row_id]).select("source", "k1", "k2", "__k0", "pos")
        bad = broadcast_if_small(self._cluster_lines().select("source", "k1", "k2").distinct(), label="cluster-lines")
        places = lines.join(bad, ["source", "k1", "k2"], "left_semi").groupBy(F.col("source").alias("__s"), F.col("__k0").alias("__i")).agg(F.collect_set("pos").alias("__gone"))
        rows = self.df.select(F.col(row_id).alias("__id"), F.col(self.source).alias("__source"), F.col(self.text).alias("__text"))
        rows = rows.join(places, (F.col("__id") == F.col("__i")) & (F.col("__source") == F.col("__s")), "left")
        kept = F.filter(split_lines(F.col("__text")), lambda x, i: ~F.array_contains("__gone", i))
        text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
        return rows.select(F.col("__id").alias(row_id), text.alias("text"), F.coalesce(F.size("__gone"), F.lit(0)).alias("removed"))

    def _cluster_lines(self) -> DataFrame:
        """(source, k1, k2, template, core, docs): the lines of clusters that are, exactly counted, in too many documents."""
        if "cluster-lines" not in self._made:
            keys = materialize(self.keys().join(self.clusters(), ["source", "template"]).select("source", "k1", "k2", "template", "core"), "cluster-keys")
            rows = _line_rows(self.df, self.text, self.source, self.doc, []).filter("doc is not null").select("source", "k1", "k2", "doc").distinct()
            hits = rows.join(broadcast_if_small(keys.drop("template").distinct(), label="cluster-keys"), ["source", "k1", "k2"])
            docs = hits.select("source", "core", "doc").distinct().groupBy("source", "core").agg(F.count("*").alias("docs"))
            often = docs.join(self.limits(), "source").filter("docs >= least").select("source", "core", "docs")
            self._made["cluster-lines"] = materialize(keys.join(often, ["source", "core"]), "cluster-lines")
        return self._made["cluster-lines"]

    def report(self) -> DataFrame:
        """(source, core, templates, lines, docs): the frequent clusters; docs counts each document once."""
        counts = [F.countDistinct("template").alias("templates"), F.countDistinct("k1", "k2").alias("lines"), F.max("docs").alias("docs")]
        return self._cluster_lines().groupBy("source", "core").agg(*counts)
