"""Problem 4: visually identical text stored with different characters.

Two forms are made. The *consistent form* keeps case and meaning: compatibility letters and digits (wide
forms, ligatures) become ordinary ones, accents are composed, ignorable characters go, blanks other than
tab and line ends become a space, and look-alike letters inside words of Latin letters become Latin.
The *comparison key* adds full case folding and levelled blanks on top, so that equal-looking names compare equal.

A text is found inconsistent in two steps: its compatibility form, composed, without ignorable characters and with blanks mapped, must differ from
it (or a word must mix scripts), and then so must its consistent form, which leaves alone signs such as `…` or `²` that the compatibility form dissolves.

Both are computed in Arrow batches, once per distinct value of a batch, and only for values that hold a
character outside printable ASCII; the others are their own consistent form. Nulls stay null.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Look-alike letters of other scripts and the Latin letters they are read as (fixed values).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ё": "ë", "Ё": "Ë",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "η": "n", "ε": "e",
}

#: Not visible: default-ignorable characters, other format characters, and controls other than tab and line ends.
INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]")
#: Blanks other than the ordinary one; tab, line feed, carriage return and the separators of lines are ordinary.
BLANK = regex.compile(r"[\p{Zs}--[ ]]", regex.V1)
#: Characters whose compatibility form consists of ordinary letters or digits and that are wide, narrow or joined.
_FORMS = ("<wide>", "<narrow>", "<compat>")
#: Two steps find words that mix scripts: letters of two scripts in one run of letters and marks.
WORD = regex.compile(r"[\p{L}\p{M}]+")
LATIN = regex.compile(r"\p{Script=Latin}")
FOREIGN = regex.compile(r"[\p{L}--\p{Script=Latin}--\p{Script=Common}--\p{Script=Inherited}]", regex.V1)
_BOTH = regex.compile(r"[\p{L}\p{M}]*(?:\p{Script=Latin}[\p{L}\p{M}]*[\p{L}--\p{Script=Latin}--\p{Script=Common}--\p{Script=Inherited}]|[\p{L}--\p{Script=Latin}--\p{Script=Common}--\p{Script=Inherited}][\p{L}\p{M}]*\p{Script=Latin})[\p{L}\p{M}]*", regex.V1)


@functools.lru_cache(maxsize=1 << 16)
def plain_form(ch: str) -> str:
    """The ordinary letters or digits that a wide, narrow or joined character stands for, else itself."""
    parts = unicodedata.decomposition(ch).split(" ", 1)
    if parts[0] not in _FORMS:
        return ch
    form = unicodedata.normalize("NFKC", ch)
    # signs such as the ellipsis or the numero sign are no letters, nor are letters with a blank in them
    if parts[0] == "<compat>" and not (len(form) > 1 and form.isalpha() and ch.isalpha()):
        return ch
    return form if all(c.isalnum() for c in form) else ch


def _words(m: regex.Match) -> str:
    return "".join(LOOKALIKES.get(c, c) for c in m[0])


class _Plain(dict):
    """Translation table that fills itself: most characters stand for themselves."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        value = "" if INVISIBLE.match(ch) else " " if BLANK.match(ch) else plain_form(ch)
        self[code] = value
        return value


class _Mapped(dict):
    """As _Plain, but only for ignorable characters and blanks."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        value = "" if INVISIBLE.match(ch) else " " if BLANK.match(ch) else ch
        self[code] = value
        return value


_PLAIN, _MAPPED = _Plain(), _Mapped()


def consistent(value: str) -> str:
    """The consistent form of a text."""
    if value.isascii() and value.isprintable():
        return value
    x = value.translate(_PLAIN)
    x = unicodedata.normalize("NFC", x)
    if FOREIGN.search(x) and LATIN.search(x):
        x = _BOTH.sub(_words, x)
    return x


def compatible(value: str) -> str:
    """The full compatibility form, composed, without ignorable characters and with blanks mapped."""
    return unicodedata.normalize("NFKC", value.translate(_MAPPED))


def mixes_scripts(value: str) -> bool:
    """Whether a word of the text has Latin letters and letters of another script."""
    x = value.translate(_PLAIN)
    return bool(FOREIGN.search(x) and LATIN.search(x) and _BOTH.search(x))


def inconsistent(value: str) -> bool:
    """Whether the text is not in the consistent form, or has a word of mixed scripts that no look-alike explains."""
    if value.isascii() and value.isprintable():
        return False
    mixed = mixes_scripts(value)
    return mixed or (compatible(value) != value and consistent(value) != value)


def comparison_key(value: str) -> str:
    """Compatibility form, full case folding, composed, blanks levelled: equal for texts that look alike."""
    x, last = consistent(value), None  # before folding, as capitals and small letters look like different ones
    while x != last:  # folding may open a further step
        last, x = x, consistent(compatible(x).casefold())
    return " ".join(x.split())


def _per_distinct(fn, kind: T.DataType):
    """``fn`` as a vectorised function that runs once per distinct value of a batch."""

    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        made = [fn(v) for v in values] + [None]
        return pd.Series([made[c] for c in codes], dtype=object)

    return F.pandas_udf(run, kind)


def _needed(c: Column) -> Column:
    """Values that may be inconsistent: those with a character outside printable ASCII, tab and line ends."""
    return c.rlike(r"[^\t\n\r -~]")


def consistent_form(c: Column) -> Column:
    """Column of consistent forms; ASCII values never leave the JVM."""
    return F.when(_needed(c), _per_distinct(consistent, T.StringType())(F.when(_needed(c), c))).otherwise(c)


def key_form(c: Column) -> Column:
    """Column of comparison keys."""
    ascii_key = F.trim(F.regexp_replace(F.lower(c), r"[\t\n\r ]+", " "))
    return F.when(_needed(c), _per_distinct(comparison_key, T.StringType())(F.when(_needed(c), c))).otherwise(ascii_key)


def find_inconsistent(df: DataFrame, row_id: str, column: str, field_name: str) -> DataFrame:
    """(field_name, row_id) of the rows whose ``column`` differs from its consistent form."""
    value = F.col(column)
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), value.alias("value")).filter(_needed(F.col("value")))
    rows = rows.filter(_per_distinct(inconsistent, T.BooleanType())(F.col("value")))
    return rows.select(F.lit(field_name).alias("field_name"), "row_id")


def normalized(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row id, value, form, key): every row with its consistent form and comparison key, nulls included."""
    c = F.col(column)
    return df.select(F.col(row_id), c.alias("value"), consistent_form(c).alias("form"), key_form(c).alias("key"))


def same_looking(df: DataFrame, column: str) -> DataFrame:
    """(key, form, variants, uses): spellings that look alike, grouped by comparison key.

    Values are counted first, so each distinct value is normalised once and a frequent one costs one row.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("uses"))
    keyed = values.select("uses", "value", consistent_form(F.col("value")).alias("form"), key_form(F.col("value")).alias("key"))
    return keyed.filter("key <> ''").groupBy("key").agg(F.max_by("form", F.struct("uses", "form")).alias("form"), F.count("*").alias("variants"), F.sum("uses").alias("uses"))
