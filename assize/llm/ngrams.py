"""Problem 5: frequencies of all distinct values and terms by suffix sorting.

Every sequence of words gives its suffixes, truncated to the longest wanted n-gram. A suffix is routed by its first
term; a term with more than ROWS_PER_GROUP suffixes goes into as many groups as that takes, by a salt made of the record. Each task sorts its suffixes
in reverse lexicographic order and keeps a stack of the prefixes of the current one: as soon as a prefix
can occur no more, its count and its set of records are complete. Salts split the records, so the counts and
set sizes of an n-gram add up over the salts, and no set outgrows a group.

Whole values are counted by the same pass over anchored sequences: the words of the value and an end mark, of which only prefixes that
reach the end mark are given out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.runtime import broadcast_if_small

END = "\x00"


def term_of(value: Column) -> Column:
    """The value without outer blanks, with runs of blanks as one, in lower case."""
    return F.lower(F.trim(F.regexp_replace(value, " +", " ")))


def _stack(whole: bool):
    """Counts of all prefixes of sorted suffixes; with ``whole`` only of those that end in the end mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[str] = []
        counts: list[int] = []
        records: list[set] = []
        group = None
        out: list[tuple] = []

        def pop(to: int) -> None:
            while len(words) > to:
                n, docs = counts.pop(), records.pop()
                if not whole or words[-1] == END:
                    out.append((group, words[: len(words) - whole], n, len(docs)))
                words.pop()
                if words:
                    counts[-1] += n
                    if len(records[-1]) < len(docs):
                        records[-1], docs = docs, records[-1]
                    records[-1] |= docs

        for batch in batches:
            for g, suffix, doc, n in zip(batch["field"], batch["suffix"], batch["doc"], batch["n"]):
                if g != group:
                    pop(0)
                    group = g
                same, most = 0, min(len(words), len(suffix))
                while same < most and words[same] == suffix[same]:
                    same += 1
                pop(same)
                for w in suffix[same:]:
                    words.append(w)
                    counts.append(0)
                    records.append(set())
                counts[-1] += n
                records[-1].add(doc)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["field", "words", "n", "docs"])
                out.clear()
        pop(0)
        yield pd.DataFrame(out, columns=["field", "words", "n", "docs"])

    return run


#: Most suffixes of one first term that one group of a task holds.
ROWS_PER_GROUP = 200_000


def _salts(firsts: DataFrame, rows: int) -> DataFrame:
    """(field, first, salts): the first terms with more than ``rows`` suffixes, and into how many groups these go. ``firsts``: (field, first), one row per suffix."""
    counts = firsts.groupBy("field", "first").agg(F.ceil(F.count("*") / rows).alias("salts"))
    return broadcast_if_small(counts.filter("salts > 1"), label="first-terms")


def _sorted_counts(suffixes: DataFrame, whole: bool, salts: DataFrame) -> DataFrame:
    """(field, words, occurrences, records) from rows (field, suffix, doc, n)."""
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = suffixes.withColumn("first", F.element_at("suffix", 1)).join(salts, ["field", "first"], "left")
    route = F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1)))
    routed = rows.repartition(parts, "field", "first", route).select("field", "suffix", "doc", "n").sortWithinPartitions(F.desc("field"), F.desc("suffix"))
    counted = routed.mapInPandas(_stack(whole), "field string, words array<string>, n long, docs long")
    return counted.groupBy("field", F.array_join("words", " ").alias("term")).agg(F.sum("n").alias("occurrences"), F.sum("docs").alias("records"))


def _rows(df: DataFrame, column: str, doc: str, field_name: str) -> DataFrame:
    return df.select(F.lit(field_name).alias("field"), term_of(F.col(column)).alias("term"), F.col(doc).alias("doc")).filter("term <> '' and doc is not null")


def value_counts(df: DataFrame, column: str, doc: str, field_name: str, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """(field, term, occurrences, records) of every non-blank value; rows without a record id are left out."""
    rows = _rows(df, column, doc, field_name)
    salts = _salts(rows.select("field", F.substring_index("term", " ", 1).alias("first")), rows_per_group)
    once = rows.groupBy("field", "term", "doc").agg(F.count("*").alias("n"))
    return _sorted_counts(once.select("field", F.concat(F.split("term", " "), F.array(F.lit(END))).alias("suffix"), "doc", "n"), True, salts)


def ngram_counts(df: DataFrame, column: str, doc: str, field_name: str, longest: int = 3, least: int = 1, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """(field, term, occurrences, records) of all n-grams of up to ``longest`` words that occur ``least`` times."""
    rows = _rows(df, column, doc, field_name)
    salts = _salts(rows.select("field", F.explode(F.split("term", " ")).alias("first")), rows_per_group)
    words = rows.groupBy("field", "term", "doc").agg(F.count("*").alias("n")).withColumn("w", F.split("term", " "))
    cut = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, longest))
    suffixes = words.select("field", "doc", "n", F.explode(cut).alias("suffix"))
    return _sorted_counts(suffixes.groupBy("field", "suffix", "doc").agg(F.sum("n").alias("n")), False, salts).filter(F.col("occurrences") >= least)


def marked(counts: DataFrame, records: DataFrame, rare_below: int = 3, common_percent: int = 20) -> DataFrame:
    """``counts`` with a mark: `rare`, `common` or null. ``records``: (field, all) of records with any value; one row per field."""
    share = F.col("records") * 100 > F.col("all") * common_percent
    mark = F.when(F.col("records") < rare_below, "rare").when(share, "common")
    return counts.join(F.broadcast(records), "field").withColumn("mark", mark).drop("all")


def record_totals(df: DataFrame, column: str, doc: str, field_name: str) -> DataFrame:
    """(field, all): the number of records with any non-blank value."""
    rows = df.filter((F.trim(F.col(column)) != "") & F.col(doc).isNotNull()).select(F.col(doc).alias("doc")).distinct()
    return rows.agg(F.count("*").alias("all")).select(F.lit(field_name).alias("field"), "all")
