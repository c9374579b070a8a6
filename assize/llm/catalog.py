"""Queries of the training-text operators over the test tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.llm import characters, ledger, leakage, ngrams
from assize.llm.mixing import Mixture
from assize.llm.mojibake import Mojibake
from assize.llm.repeated_lines import RepeatedLines
from assize.runtime import table


def _lines(spark: SparkSession, d: str) -> RepeatedLines:
    return RepeatedLines(table(spark, d, "paragraphs"), "text", "source_file", "case_ord")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).found("para_id")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).cleaned("para_id")


def p1_clean_near(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).cleaned("para_id", near=True)


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).report()


def _keyed(citations: DataFrame) -> DataFrame:
    return ledger.keyed(citations, ledger.citation_key(F.col("citation")), "citation_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _keyed(table(spark, d, "citations"))
    return ledger.copies(rows, ledger.collapse(rows))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations")
    return ledger.collapsed(c, "citation", "citation_id", ledger.collapse(_keyed(c)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    text = characters.find_inconsistent(table(spark, d, "paragraphs"), "para_id", "text", "text")
    return text.unionByName(characters.find_inconsistent(table(spark, d, "judges"), "entry_id", "judge", "judge"))


def p4_normalized(spark: SparkSession, d: str) -> DataFrame:
    text = characters.normalized(table(spark, d, "paragraphs"), "para_id", "text").select(F.lit("text").alias("field_name"), F.col("para_id").alias("row_id"), "form", "key")
    return text.unionByName(characters.normalized(table(spark, d, "judges"), "entry_id", "judge").select(F.lit("judge").alias("field_name"), F.col("entry_id").alias("row_id"), "form", "key"))


def p4_same_looking(spark: SparkSession, d: str) -> DataFrame:
    return characters.same_looking(table(spark, d, "judges"), "judge")


_FIELDS = (("judges", "judge"), ("keywords", "keyword"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = totals = None
    for name, field in _FIELDS:
        t = table(spark, d, name)
        c, n = ngrams.value_counts(t, field, "case_ord", field), ngrams.record_totals(t, field, "case_ord", field)
        counts, totals = (c, n) if counts is None else (counts.unionByName(c), totals.unionByName(n))
    return ngrams.marked(counts, totals).withColumnRenamed("field", "field_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).filter("mark is not null").select("field_name", "term", "mark")


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    out = [ngrams.ngram_counts(table(spark, d, name), field, "case_ord", field) for name, field in _FIELDS]
    return out[0].unionByName(out[1]).withColumnRenamed("field", "field_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).ordered()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return Mojibake(table(spark, d, "documents")).found()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return Mojibake(table(spark, d, "documents")).restored()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_clean, p1_clean_near, p1_clusters, p3_found, p3_collapsed, p4_found, p4_normalized, p4_same_looking, p5_found, p5_terms, p5_ngrams, p7_found, p7_report, p8_mix, p8_report, p9_found, p9_restored]
    return {f.__name__: f for f in own}


_LINES = r"""
cases AS (SELECT source_file, count(DISTINCT case_ord) AS n FROM paragraphs WHERE source_file IS NOT NULL GROUP BY 1),
parts AS (SELECT para_id, case_ord, source_file, text, string_split_regex(text, '\r?\n') AS l FROM paragraphs WHERE text IS NOT NULL AND source_file IS NOT NULL),
raw AS (SELECT para_id, case_ord, source_file, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM parts),
keyed AS (SELECT *, regexp_replace(lower(trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ')), '\p{Nd}+', '0', 'g') AS k FROM raw),
often AS (SELECT source_file, k FROM keyed JOIN cases USING (source_file) WHERE k <> '' GROUP BY source_file, k, n
          HAVING count(DISTINCT case_ord) >= 6 AND count(DISTINCT case_ord) * 100 >= 2 * n)
"""

_CITATION = r"""
a AS (SELECT citation_id, citation, lower(citation) AS s FROM citations WHERE trim(regexp_replace(citation, '\s+', ' ', 'g')) <> ''),
b AS (SELECT citation_id, citation, regexp_extract(s, '{date}', ['d', 'm', 'y']) AS dt, regexp_replace(s, '{date}', '|') AS s FROM a),
c AS (SELECT citation_id, citation, dt, regexp_extract(s, '§[^\p{{L}}\p{{N}}]*(\d+)', 1) AS para, regexp_replace(s, '§[^\p{{L}}\p{{N}}]*(\d+)', '|') AS s FROM b),
e AS (SELECT citation_id, citation, dt, para, regexp_extract(s, '{no}', ['x', 'a', 'b']) AS no, regexp_replace(s, '{no}', '|') AS s FROM c),
keyed AS (SELECT citation_id, citation, concat_ws('|', regexp_replace(s, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), no.a || no.b, para, dt.d || dt.m || dt.y) AS k FROM e),
firsts AS (SELECT k, min(citation_id) AS kept_id, count(*) AS copies FROM keyed GROUP BY k)
""".format(date=r"\b(\d{1,2})[^\p{L}\p{N}]+(" + "|".join(ledger.MONTHS) + r")[^\p{L}\p{N}]+(\d{4})\b", no=r"(^|[^\p{L}\p{N}])no[^\p{L}\p{N}]*(\d+)[^\p{L}\p{N}]*/[^\p{L}\p{N}]*(\d+)")


_INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"
_OTHER = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}\p{Georgian}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"


def _inconsistent(table_name: str, row_id: str, column: str) -> str:
    bare = f"regexp_replace({column}, '{_INVISIBLE}', '', 'g')"
    return rf"""
SELECT '{column}' AS field_name, {row_id} AS row_id FROM {table_name} WHERE {column} IS NOT NULL AND (nfc_normalize({column}) <> {column} OR regexp_matches({column}, '{_INVISIBLE}')
    OR regexp_matches({column}, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}\x{{FB00}}-\x{{FB06}}\x{{132}}\x{{133}}\x{{1C4}}-\x{{1CC}}\x{{1F1}}-\x{{1F3}}]') OR regexp_matches({column}, '[\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]')
    OR regexp_matches({bare}, '\p{{Latin}}[\p{{L}}\p{{M}}]*[{_OTHER}]|[{_OTHER}][\p{{L}}\p{{M}}]*\p{{Latin}}'))"""


def _terms(table_name: str, field: str) -> str:
    return rf"""
SELECT '{field}' AS field_name, term, sum(1)::BIGINT AS occurrences, count(DISTINCT case_ord) AS records,
       CASE WHEN count(DISTINCT case_ord) < 3 THEN 'rare'
            WHEN count(DISTINCT case_ord) * 100 > 20 * (SELECT count(DISTINCT case_ord) FROM {table_name} WHERE trim({field}, ' ') <> '') THEN 'common' END AS mark
FROM (SELECT lower(trim(regexp_replace({field}, ' +', ' ', 'g'), ' ')) AS term, case_ord FROM {table_name})
WHERE term <> '' AND case_ord IS NOT NULL GROUP BY term"""


def _ngrams(table_name: str, field: str) -> str:
    return rf"""
SELECT '{field}' AS field_name, array_to_string(w[i : i + n - 1], ' ') AS term, count(*) AS occurrences, count(DISTINCT case_ord) AS records
FROM (SELECT w, case_ord, n, unnest(generate_series(1, len(w) - n + 1)) AS i
      FROM (SELECT string_split(lower(trim(regexp_replace({field}, ' +', ' ', 'g'), ' ')), ' ') AS w, case_ord, unnest([1, 2, 3]) AS n
            FROM {table_name} WHERE trim({field}, ' ') <> '' AND case_ord IS NOT NULL) WHERE len(w) >= n)
GROUP BY 2"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_LINES} SELECT DISTINCT para_id, line_no::INT AS line_no FROM keyed JOIN often USING (source_file, k)",
        "p1_clean": rf"""WITH {_LINES}, kept AS (SELECT para_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE o.k IS NULL) AS text, count(o.k)::INT AS removed
            FROM keyed t LEFT JOIN often o ON t.source_file = o.source_file AND t.k = o.k GROUP BY para_id)
            SELECT p.para_id, CASE WHEN coalesce(removed, 0) = 0 THEN p.text ELSE coalesce(kept.text, '') END AS text, coalesce(removed, 0)::INT AS removed FROM paragraphs p LEFT JOIN kept USING (para_id)""",
        "p3_found": f"WITH {_CITATION} SELECT kept_id, citation_id AS copy_id FROM keyed JOIN firsts USING (k) WHERE kept_id < citation_id",
        "p3_collapsed": f"WITH {_CITATION} SELECT citation_id, citation, copies FROM keyed JOIN firsts ON keyed.k = firsts.k AND citation_id = kept_id",
        "p4_found": f"{_inconsistent('paragraphs', 'para_id', 'text')} UNION ALL {_inconsistent('judges', 'entry_id', 'judge')}",
        "p5_found": f"SELECT field_name, term, mark FROM ({_terms('judges', 'judge')} UNION ALL {_terms('keywords', 'keyword')}) WHERE mark IS NOT NULL",
        "p5_terms": f"{_terms('judges', 'judge')} UNION ALL {_terms('keywords', 'keyword')}",
        "p5_ngrams": f"{_ngrams('judges', 'judge')} UNION ALL {_ngrams('keywords', 'keyword')}",
        "p7_found": r"""WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
            sized AS (SELECT item_id, w, least(12, len(w)) AS n FROM items WHERE len(w) > 0),
            wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized)),
            docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            windows AS (SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
                        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n))
            SELECT DISTINCT doc_id, item_id FROM windows JOIN wanted USING (n, win)""",
    }
