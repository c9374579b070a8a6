"""Scalar functions on text, lists and dates, as built-in column expressions unless the docstring says otherwise.

Nulls give null, and empty lists where a list is due.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.functions.constants import CHAMBERS, COUNTRIES, GRAND_CHAMBER_BOOST, GROUNDS, KEY_CASE_BOOST, OTHER_GROUND, SECTION_WEIGHTS, STOPWORDS


#: All characters with the Unicode property White_Space.
WHITE = "".join(chr(i) for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none outside (citations, labels). Single blanks are no match, so most text is left as it is."""
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def lookup(mapping: dict, c: Column, default: Column | None = None) -> Column:
    """The value for a key, else ``default``, else the key itself."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, c), c if default is None else default)


# --- dates


def parse_date(c: Column) -> Column:
    """Day/month/year, year-month-day or year/month/day; impossible dates are null."""
    s = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("d/M/yyyy", "yyyy-M-d", "yyyy/M/d")])


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def year_key(d: Column) -> Column:
    return F.date_format(d, "yyyy")


def range_label(low: Column, high: Column) -> Column:
    """`01 Jan 2020 – 31 Dec 2021`, with n/a for a missing end."""
    return F.concat_ws(" – ", *[F.coalesce(F.date_format(x, "dd MMM yyyy"), F.lit("n/a")) for x in (low, high)])


# --- folding


def _base_table() -> tuple[str, str]:
    """All characters that decompose canonically into one base character and marks, and these bases."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0xFB50)]
    pairs = [(c, [x for x in d if not unicodedata.combining(x)]) for c, d in pairs if d != c and not c.isupper()]
    pairs = [(c, b[0]) for c, b in pairs if len(b) == 1 and len(c.encode("utf-16-le")) == 2]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


BASE_FROM, BASE_TO = _base_table()


def fold(c: Column, collapse: bool = True) -> Column:
    """Lower case without accents, for search in metadata; white space levelled unless ``collapse`` is false.

    Covers all letters that decompose canonically, and combining marks; ``fold_exact`` does compatibility forms as well.
    """
    x = F.regexp_replace(F.translate(F.lower(c), BASE_FROM, BASE_TO), r"\p{M}+", "")
    return squeeze(x) if collapse else x


def _fold_values(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        x = unicodedata.normalize("NFKD", v.strip().lower())
        return re.sub(r"\s+", " ", "".join(ch for ch in x if not unicodedata.combining(ch))).strip()

    codes, values = pd.factorize(s)
    made = [one(v) for v in values] + [None]
    return pd.Series([made[i] for i in codes], dtype=object)


def fold_exact(c: Column) -> Column:
    """As ``fold``, by compatibility decomposition of all of Unicode, in Arrow batches once per distinct value."""
    return F.pandas_udf(_fold_values, T.StringType())(c)


# --- presence and lists


def is_present(c: Column, kind: str, loose: bool = False) -> Column:
    """Whether a raw field holds anything. Strict: blank text and empty lists do not, false and 0 do.

    ``loose``: false does not, blank but not empty text does.
    """
    if kind == "string":
        return F.coalesce((c if loose else strip(c)) != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "boolean" and loose:
        return F.coalesce(c, F.lit(False))
    return c.isNotNull()


def list_of(c: Column, pattern: str = "[;,]", distinct: bool = True) -> Column:
    """A list from text that holds a JSON array or values parted by ``pattern``; blanks dropped, first of equal ones kept."""
    parsed = F.when(F.ltrim(c).startswith("["), F.from_json(c, T.ArrayType(T.StringType())))
    values = F.coalesce(parsed, F.split(c, pattern) if pattern else F.array(c), F.array().cast("array<string>"))
    return clean_list(values, distinct)


def clean_list(values: Column, distinct: bool = False) -> Column:
    out = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(out) if distinct else out


def truthy(c: Column) -> Column:
    """true, 1, yes or y in any case; all else, null included, is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "y"), F.lit(False))


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(default))


# --- decisions


def section_key(c: Column) -> Column:
    """Trimmed, small, blanks and hyphens as underscores; `unknown` if empty or missing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "-", " "), r"\s+", "_")
    return F.coalesce(F.when(s != "", s), F.lit("unknown"))


def states_of(respondent: Column, defendants: Column) -> Column:
    """The respondent state if there is one, else the names of the defendants' codes; unknown codes stay."""
    return F.when(strip(respondent) != "", F.array(strip(respondent))).otherwise(F.array_distinct(F.transform(defendants, lambda x: lookup(COUNTRIES, x))))


def chamber_of(doc_types: Column, body: Column) -> Column:
    docs, b = F.upper(F.array_join(doc_types, " ")), F.upper(F.coalesce(body, F.lit("")))
    grand = docs.contains("GRANDCHAMBER") | docs.contains("GRAND CHAMBER") | b.contains("GRAND CHAMBER")
    plain = docs.contains("CHAMBER") | b.contains("SECTION") | b.contains("CHAMBER")
    return F.when(grand, CHAMBERS[0]).when(plain, CHAMBERS[1]).otherwise(CHAMBERS[2])


def chamber_by_type(doc_types: Column) -> Column:
    """By exact membership in the document types alone."""
    return F.when(F.array_contains(doc_types, CHAMBERS[0]), CHAMBERS[0]).when(F.array_contains(doc_types, CHAMBERS[1]), CHAMBERS[1]).otherwise(CHAMBERS[2])


def outcome_of(violation: Column, non_violation: Column) -> Column:
    v, n = F.size(clean_list(violation)) > 0, F.size(clean_list(non_violation)) > 0
    return F.when(v & n, "both").when(v, "violation_only").when(n, "non_violation_only").otherwise("neither")


def conclusion_flags(conclusion: Column) -> dict[str, Column]:
    s = F.coalesce(fold(conclusion), F.lit(""))
    needles = {"has_inadmissibility": "inadmissible", "is_struck_out": "struck out", "has_procedural_aspect": "procedural aspect", "has_substantive_aspect": "substantive aspect"}
    return {name: s.contains(needle) for name, needle in needles.items()}


def inadmissibility_grounds(conclusion: Column) -> Column:
    """Labels of all grounds named, in fixed order; one needle may be part of another."""
    s = F.coalesce(fold(conclusion), F.lit(""))
    named = F.array_compact(F.array(*[F.when(s.contains(n), label) for n, label in GROUNDS]))
    return F.when((F.size(named) == 0) & s.contains("inadmissible"), F.array(F.lit(OTHER_GROUND))).otherwise(named)


def article_token(c: Column) -> Column:
    return F.regexp_replace(fold(c), r"\s+", "")


def has_article(articles: Column, wanted: str) -> Column:
    """Whether any article is ``wanted`` or one of its parts: 8 covers 8-1 and 14+8, not 80."""
    w = re.sub(r"\s+", "", wanted.lower())

    def hit(x: Column) -> Column:
        return (x == w) | x.startswith(w + "-")

    return F.exists(articles, lambda a: hit(article_token(a)) | F.exists(F.split(article_token(a), "[+]"), hit))


def shown_article(c: Column) -> Column:
    """Whether rankings show the article: not of a protocol, and short."""
    return ~c.startswith("P") & (F.length(c) < 10)


def url_parameter(url: Column, name: str = "i") -> Column:
    return strip(F.regexp_extract(url, rf"(?i)[?&]{re.escape(name)}=([^&#]+)", 1))


def state_search_values(states: Column, codes: Column) -> Column:
    """Folded names and codes under which a case is found."""
    code_of = {v: k for k, v in COUNTRIES.items()}
    both = F.concat(states, codes, F.transform(states, lambda s: F.coalesce(lookup(code_of, s), s)), F.transform(codes, lambda s: lookup(COUNTRIES, s)))
    return F.array_distinct(F.transform(both, lambda s: fold(s)))


def citation_distinct(citations: Column) -> Column:
    """Citations with white space levelled; of those that fold alike the first stays."""
    made = F.transform(clean_list(citations), lambda x: squeeze(x))
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.array_contains(acc["keys"], fold(x))
        return F.struct(
            F.when(seen, acc["keys"]).otherwise(F.array_append(acc["keys"], fold(x))).alias("keys"),
            F.when(seen, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"),
        )

    return F.aggregate(made, start, step, lambda acc: acc["kept"])


# --- words


def _not_stopword(x: Column) -> Column:
    return ~x.isin(STOPWORDS)


def search_words(c: Column) -> Column:
    """Words of four and more ASCII letters without stopwords, in small letters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?<![A-Za-z0-9_])[a-z]{4,}(?![A-Za-z0-9_])"), F.lit(0)), _not_stopword)


def class_words(c: Column) -> Column:
    """Runs of three and more ASCII letters and digits without stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)), _not_stopword)


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of the padded text that are not mostly blank."""
    p = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " ")), F.lit(" "))

    def grams(q: Column, n: int) -> Column:
        starts = F.when(F.length(q) >= n, F.sequence(F.lit(1), F.length(q) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: F.substring(q, i, F.lit(n))), lambda g: F.length(F.trim(g)) >= max(2, n - 1))

    # bound to a variable, the padded text is made once and not once per n-gram
    return F.flatten(F.transform(F.array(p), lambda q: F.concat(*[grams(q, n) for n in range(low, high + 1)])))


def highlight(c: Column, terms: list[str]) -> Column:
    """The terms of escaped text wrapped in a mark, in one pass with longer terms first, so that inserted marks are never searched, nor are the names of entities."""
    wanted = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not wanted:
        return c
    pattern = "(?iu)(?<!&[a-z#0-9]{0,5})(" + "|".join(re.escape(t) for t in wanted) + ")"
    return F.regexp_replace(c, pattern, '<mark class="hl">$1</mark>')


def escape_html(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], c)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("..."))).otherwise(c)


# --- numbers


def ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole * scale, 0 where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(scale), F.lit(0.0))


def section_weight(section: Column) -> Column:
    return lookup(SECTION_WEIGHTS, section, F.lit(1.0))


def case_boost(importance: Column, chamber: Column) -> Column:
    key = F.when(F.lower(F.trim(importance)) == "key cases", KEY_CASE_BOOST).otherwise(1.0)
    return key * F.when(chamber == CHAMBERS[0], GRAND_CHAMBER_BOOST).otherwise(1.0)


def small_hash(text: str) -> str:
    """Multiplicative xor hash of UTF-16 units in base 36, for names of saved states; runs on the driver."""
    h = 5381
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h * 33) ^ int.from_bytes(data[i : i + 2], "little")) & 0xFFFFFFFF
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    return out or "0"
