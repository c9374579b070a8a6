"""Queries of the general data-preparation operators: nested records and packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.operators.nested import DecisionTables
from assize.operators.packed import CONJUNCTIONS, delimiters, split_packed
from assize.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return DecisionTables(table(spark, d, "echr_decisions_sample")).children()


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    t = DecisionTables(table(spark, d, "echr_decisions_sample"))
    return t.paragraphs.select(F.col("record").alias("record_no"), F.col("path").alias("pos_path"), "section", "para_idx", "text")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return DecisionTables(table(spark, d, "echr_decisions_sample")).nodes


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "cases"), "article_no", "source_file", ["case_ord"])


def p6_delimiters(spark: SparkSession, d: str) -> DataFrame:
    numbers = [F.round(c, 6).alias(c) for c in ("consistency", "regularity", "score")]
    return delimiters(table(spark, d, "cases"), "article_no", "source_file").select("source", "delimiter", "rows", "pieces", *numbers)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes of each kind stand under each label, at the top of the records."""
    nodes = DecisionTables(table(spark, d, "echr_decisions_sample")).nodes
    return nodes.filter("parent = 0").groupBy("label", "kind").agg(F.count("*").alias("n"), F.countDistinct("record").alias("records"))


QUERIES = [p2_found, p2_paragraphs, p2_nodes, p2_counts, p6_found, p6_delimiters]



def _entries(value: str) -> str:
    """SQL for the entries of a JSON value where a list is due."""
    text = f"json_extract_string({value}, '$')"
    return f"""CASE WHEN {value} IS NULL OR json_type({value}) = 'NULL' THEN [] WHEN json_type({value}) = 'ARRAY' THEN from_json({value}, '["JSON"]')
        WHEN json_type({value}) = 'VARCHAR' AND json_valid({text}) AND coalesce(json_type(try_cast({text} AS JSON)), '') = 'ARRAY' THEN from_json({text}, '["JSON"]') ELSE [{value}] END"""


def _level(name: str, source: str, value: str, path: str, keep: str) -> str:
    """SQL for one level of children: the non-null entries with their positions."""
    return f"""{name}0 AS (SELECT {keep}, {path} AS up, {_entries(value)} AS l FROM {source}),
{name}1 AS (SELECT * EXCLUDE (l), unnest(l) AS e, generate_subscripts(l, 1) - 1 AS i FROM {name}0),
{name} AS (SELECT *, CASE WHEN up = '' THEN '' ELSE up || '.' END || i AS pos_path FROM {name}1 WHERE e IS NOT NULL AND json_type(e) <> 'NULL')"""


_VIEWS = rf"""WITH r AS (SELECT record_no, try_cast(payload AS JSON) AS j FROM echr_decisions_sample WHERE json_valid(payload) AND payload LIKE '{{%'),
{_level("p", "r", "json_extract(j, '$.paragraphs')", "''", "record_no")},
q AS (SELECT *, coalesce(nullif(regexp_replace(lower(trim(json_extract_string(e, '$.section'))), '[\s-]', '_', 'g'), ''), 'unknown') AS section,
      CASE WHEN json_type(json_extract(e, '$.para_idx')) IN ('BIGINT', 'UBIGINT') OR regexp_full_match(json_extract_string(e, '$.para_idx'), '\s*[+-]?\d+\s*') THEN coalesce(try_cast(trim(json_extract_string(e, '$.para_idx')) AS INT), i) ELSE i END AS para_idx FROM p),
{_level("n", "q", "json_extract(e, '$.notes')", "pos_path", "record_no, section, para_idx")},
{_level("f", "n", "json_extract(e, '$.refs')", "pos_path", "record_no, section, para_idx")},
{_level("c", "r", "json_extract(j, '$.court_assessment_references.case_references')", "''", "record_no")}"""

_SCALARS = ("VARCHAR", "BIGINT", "UBIGINT", "DOUBLE", "BOOLEAN")
_FIRST = f"""CASE WHEN json_type(json_extract(e, '$.text')) = 'ARRAY' THEN json_extract_string(list_filter(from_json(json_extract(e, '$.text'), '["JSON"]'), lambda x: json_type(x) IN {_SCALARS})[1], '$')
    WHEN json_type(json_extract(e, '$.text')) IN {_SCALARS} THEN json_extract_string(e, '$.text') END"""

_WORDS = "|".join(CONJUNCTIONS)
SQL = {
    "p2_found": rf"""
{_VIEWS}SELECT record_no, 'paragraph' AS child, pos_path, section, para_idx::INT AS para_idx FROM q UNION ALL SELECT record_no, 'note', pos_path, section, para_idx FROM n
UNION ALL SELECT record_no, 'ref', pos_path, section, para_idx FROM f UNION ALL SELECT record_no, 'case_reference', pos_path, '', -1 FROM c
""",
    "p2_paragraphs": f"""{_VIEWS} SELECT record_no, pos_path, section, para_idx::INT AS para_idx, CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') ELSE {_FIRST} END AS text FROM q""",
    "p2_counts": r"""
WITH r AS (SELECT record_no, try_cast(payload AS JSON) AS j FROM echr_decisions_sample WHERE json_valid(payload) AND payload LIKE '{%'),
k AS (SELECT record_no, j, unnest(json_keys(j)) AS label FROM r),
v AS (SELECT DISTINCT record_no, label, json_extract(j, '$."' || label || '"') AS v FROM k),
t AS (SELECT record_no, label, CASE WHEN json_type(v) = 'ARRAY' THEN from_json(v, '["JSON"]')
      WHEN label IN ('paragraphs', 'notes', 'refs', 'case_references') AND json_type(v) = 'VARCHAR' AND coalesce(json_type(try_cast(json_extract_string(v, '$') AS JSON)), '') = 'ARRAY' THEN from_json(json_extract_string(v, '$'), '["JSON"]') ELSE [v] END AS l FROM v),
e AS (SELECT record_no, label, unnest(l) AS e FROM t)
SELECT label, CASE json_type(e) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind,
    count(*) AS n, count(DISTINCT record_no) AS records FROM e WHERE e IS NOT NULL AND json_type(e) <> 'NULL' GROUP BY 1, 2
""",
    "p6_delimiters": rf"""
WITH m AS (SELECT case_ord, source_file AS source, regexp_replace(article_no, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''', chr(1) || 'Q' || chr(1), 'g') AS m FROM cases WHERE article_no IS NOT NULL),
p AS (SELECT *, regexp_replace(m, '[^\p{{L}}\p{{M}}\p{{N}}()§+ \x01-]|  +', chr(1), 'g') AS p FROM m),
w AS (SELECT *, regexp_replace(regexp_replace(p, '(^|[ \x01])((?i:{_WORDS}))([ \x01]|$)', '\1' || chr(2) || '\2' || chr(2) || '\3', 'g'), '(^|[ \x01])((?i:{_WORDS}))([ \x01]|$)', '\1' || chr(2) || '\2' || chr(2) || '\3', 'g') AS w FROM p),
c AS (SELECT case_ord, source, list_concat(list_concat(regexp_extract_all(m, '[^\p{{L}}\p{{M}}\p{{N}}()§+ \x01-]'), list_transform(regexp_extract_all(w, '\x02([^\x02\x01 ]+)\x02', 1), lambda x: lower(x))), CASE WHEN contains(m, '  ') THEN ['  '] ELSE [] END) AS c,
      list_filter(list_transform(string_split(regexp_replace(w, '\x02[^\x02\x01 ]+\x02', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS pieces FROM w),
e AS (SELECT source, unnest(list_distinct(c)) AS delimiter, c, CASE WHEN len(pieces) = 0 THEN 1.0 ELSE len(list_filter(pieces, lambda x: length(x) <= 60)) / len(pieces) END AS regular FROM c),
n AS (SELECT source, delimiter, len(list_filter(c, lambda x: x = delimiter)) + 1 AS n, regular FROM e),
s AS (SELECT source, delimiter, count(*) AS rows, sum(n)::BIGINT AS pieces, 1 / (1 + stddev_pop(n) / avg(n)) AS consistency, avg(regular) AS regularity FROM n GROUP BY 1, 2)
SELECT source, delimiter, rows, pieces, round(consistency, 6) AS consistency, round(regularity, 6) AS regularity, round(consistency * regularity, 6) AS score FROM s
""",
    "p6_found": r"""
WITH parts AS (SELECT case_ord, unnest(p) AS part, generate_subscripts(p, 1) AS i
               FROM (SELECT case_ord, regexp_extract_all(article_no, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^''"]+|[''"]') AS p FROM cases WHERE article_no IS NOT NULL)),
pieces AS (SELECT case_ord, i, CASE WHEN length(part) > 1 AND left(part, 1) IN ('"', '''') THEN [replace(part[2:-2], left(part, 1) || left(part, 1), left(part, 1))]
           ELSE string_split(regexp_replace(regexp_replace(regexp_replace(part, '[^\p{L}\p{M}\p{N}()§+ \-]|  +', chr(1), 'g'), '(^|[ \x01])(?i:and|et|und|or|ou|oder|sowie|ve|og|och|oraz|și|şi|és)([ \x01]|$)', '\1' || chr(1) || '\2', 'g'),
                '(^|[ \x01])(?i:and|et|und|or|ou|oder|sowie|ve|og|och|oraz|și|şi|és)([ \x01]|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS l FROM parts),
items AS (SELECT case_ord, i, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM pieces),
kept AS (SELECT case_ord, i, j, regexp_replace(x, '^\s+|\s+$', '', 'g') AS article FROM items)
SELECT case_ord, row_number() OVER (PARTITION BY case_ord ORDER BY i, j)::INT AS pos, article FROM kept WHERE article <> ''
""",
}
