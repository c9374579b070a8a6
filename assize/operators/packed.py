"""Problem 6: several values packed in one text, one row per value with its position.

For each source the delimiters are inferred from all of its values. Candidates are the characters that no value consists of, runs of
blanks, and conjunctions standing alone. A candidate is scored by how consistent the number of pieces is that it makes, and by how regular
the pieces are, with the other candidates out of the way. Those that reach LEAST_SCORE are the source's delimiters, and values are split at them alone:
a sign that parts nothing regular, as in running text, stays within its value.
Quoted pieces are taken whole. Everything is built-in expressions; the only shuffle is that of the scores.

Null gives nothing, and so do empty pieces; repeated values are kept. A null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.runtime import broadcast_if_small, free_name

#: Conjunctions that part two values (fixed values).
CONJUNCTIONS = "and et und or ou oder sowie ve og och oraz și şi és".split()
#: What values consist of, as a Java character class.
ALPHABET = r"\p{L}\p{M}\p{N}\-+()§ "
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"' + "|" + r"'[^']*+(?:''[^']*+)*+'"
CUT = "\x01"
#: The candidate that stands for runs of two blanks and more.
BLANKS = "  "
#: Score from which a candidate is a delimiter, and the longest piece that is regular.
LEAST_SCORE, LONGEST = 0.1, 60


def _alone(words: str) -> str:
    """Pattern of words that stand alone between blanks or cuts."""
    return rf"(?i)(?<![^ {CUT}])(?:{words})(?![^ {CUT}])"


_ALONE = _alone("|".join(CONJUNCTIONS))
_REGULAR = rf"^[{ALPHABET}]{{0,{LONGEST}}}$"


def delimiters(df: DataFrame, value: str, source: str) -> DataFrame:
    """(source, delimiter, rows, pieces, consistency, regularity, score) of all candidates, best first within a source when sorted by score.

    Consistency falls with the variation of the number of pieces, regularity is the share of pieces that look like a value once
    the other candidates are parted as well.
    """
    masked = F.regexp_replace(F.col(value), QUOTED, f"{CUT}Q{CUT}")
    rows = df.filter(F.col(value).isNotNull()).select(F.col(source).alias("source"), masked.alias("m"))
    rows = rows.withColumn("p", F.regexp_replace("m", rf"[^{ALPHABET}{CUT}]|  +", CUT))
    chars = F.regexp_extract_all("m", F.lit(rf"[^{ALPHABET}{CUT}]"), F.lit(0))
    words = F.transform(F.regexp_extract_all("p", F.lit(_ALONE), F.lit(0)), lambda w: F.lower(w))
    blanks = F.when(F.col("m").contains(BLANKS), F.array(F.lit(BLANKS))).otherwise(F.array().cast("array<string>"))
    # what is left when every candidate has parted the text
    regular = F.filter(F.split(F.regexp_replace("p", _ALONE, CUT), CUT, -1), lambda p: F.trim(p) != "")
    rows = rows.select("source", "m", F.concat(chars, words, blanks).alias("c"), F.coalesce(F.try_divide(F.size(F.filter(regular, lambda p: p.rlike(_REGULAR))), F.size(regular)), F.lit(1.0)).alias("regular"))
    each = rows.select("source", "regular", F.explode(F.transform(F.array_distinct("c"), lambda d: F.struct(d.alias("delimiter"), F.size(F.filter("c", lambda x: x == d)).alias("n")))).alias("e"))
    each = each.select("source", "regular", "e.delimiter", (F.col("e.n") + 1).alias("n"))
    scored = each.groupBy("source", "delimiter").agg(
        F.count("*").alias("rows"), F.sum("n").alias("pieces"),
        (1 / (1 + F.coalesce(F.stddev_pop("n"), F.lit(0.0)) / F.avg("n"))).alias("consistency"), F.avg("regular").alias("regularity"),
    )
    return scored.withColumn("score", F.col("consistency") * F.col("regularity"))


def _unquoted(piece: Column) -> Column:
    """The pieces at the delimiters of the row's source: its characters, runs of blanks and conjunctions."""
    cuts = F.call_function("translate", piece, F.col("__signs"), F.repeat(F.lit(CUT), F.length("__signs")))
    cuts = F.when(F.col("__blanks"), F.regexp_replace(cuts, "  +", CUT)).otherwise(cuts)
    # one pattern per source, made of its conjunctions
    return F.split(F.when(F.col("__words") != "", F.regexp_replace(cuts, F.col("__words"), F.lit(CUT))).otherwise(cuts), CUT, -1)


def _quoted(piece: Column) -> Column:
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    mark = F.substring(piece, 1, 1)
    return F.array(F.when(mark == '"', F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.replace(inner, F.lit("''"), F.lit("'"))))


def split_packed(df: DataFrame, value: str, source: str, keep: list[str], out: str = "article") -> DataFrame:
    """One row per packed value: the columns ``keep``, ``pos`` from 1, and the value as ``out``."""
    found = delimiters(df, value, source).filter(F.col("score") >= LEAST_SCORE)
    some = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("delimiter")))), "|")
    signs = F.array_join(F.array_sort(F.collect_set(F.when(F.length("delimiter") == 1, F.col("delimiter")))), "")
    words = some((F.length("delimiter") > 1) & (F.col("delimiter") != BLANKS))
    head, tail = _alone("@").split("@")
    pattern = F.when(words != "", F.concat(F.lit(head), words, F.lit(tail))).otherwise("")
    per_source = found.groupBy("source").agg(signs.alias("signs"), F.max(F.col("delimiter") == BLANKS).alias("blanks"), pattern.alias("words"))
    per_source = broadcast_if_small(per_source, label="delimiters")
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(source).alias("__source"), F.col(value).alias("__value"))
    rows = rows.join(per_source, F.col("__source").eqNullSafe(F.col("source")), "left")
    known = [F.coalesce("signs", F.lit("")).alias("__signs"), F.coalesce("blanks", F.lit(False)).alias("__blanks"), F.coalesce("words", F.lit("")).alias("__words")]
    rows = rows.select(*[f"__k{i}" for i in range(len(keep))], "__value", *known)
    parts = F.regexp_extract_all("__value", F.lit(QUOTED + "|[^'\"]++|['\"]"), F.lit(0))

    def pieces(part: Column) -> Column:
        quoted = (F.length(part) > 1) & F.substring(part, 1, 1).isin("'", '"')
        return F.when(quoted, _quoted(part)).otherwise(_unquoted(part))

    values = F.transform(F.flatten(F.transform(parts, pieces)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    rows = rows.select(*[f"__k{i}" for i in range(len(keep))], F.posexplode(F.filter(values, lambda p: p != "")).alias("__pos", "__item"))
    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], (F.col("__pos") + 1).cast("int").alias(free_name(df.select(*keep), "pos")), F.col("__item").alias(out))
