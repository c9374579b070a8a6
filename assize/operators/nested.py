"""Problem 2: deeply nested records as an adjacency table and related flat tables.

``shred`` stores every value of a JSON object as a node: its parent object, the label under which it stands there, its position in an array
(0 for a single value), its kind and, for scalars, its text. Array elements hang on the object that owns the array; an array
within an array is a node of its own. Entity tables are then made with joins: object nodes with their scalar
children, pivoted by label, and with their parent entities.

All joins are on (record, node), so a record of a third of all nodes is spread like any other data.

Defined results: a payload that is null, no valid JSON (NaN and Infinity are none) or no object has no nodes; null entries have no node, but count
for the positions of others; of repeated keys the last one holds; unpaired surrogates become U+FFFD. Records of any depth and integers of any length are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.runtime import materialize

NODES = T.StructType([
    T.StructField("record", T.LongType()), T.StructField("node", T.LongType()), T.StructField("parent", T.LongType()),
    T.StructField("label", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("scalar", T.StringType()),
])


class Digits(str):
    """An integer of more digits than Python turns into a number; kept as its text."""


def _no_constant(name: str) -> None:
    raise json.JSONDecodeError(name, name, 0)


_TOKEN = re.compile(r"[ \t\n\r]*(?:([{}\[\],:])|(\")|(-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)|(true|false|null))")
_WORDS = {"true": True, "false": False, "null": None}


def _parse_steps(text: str):
    """The value of a JSON text, with a stack of its own: of any depth and with integers of any length."""
    at, last = 0, len(text)
    root: list = []
    stack: list = [root]
    keys: list = [None]
    # what may come next: a value, an end of an empty array or object, a separator
    wants = "value"

    def put(value) -> None:
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value

    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            break
        at, sign = m.end(), m[1]
        if sign and sign in "{[" and wants in ("value", "first value"):
            made: dict | list = {} if sign == "{" else []
            put(made)
            stack.append(made)
            keys.append(None)
            wants = "first key" if sign == "{" else "first value"
        elif sign and sign in "}]" and len(stack) > 1 and (wants == "separator" or wants == ("first key" if sign == "}" else "first value")) and isinstance(stack[-1], dict) == (sign == "}"):
            stack.pop()
            keys.pop()
            wants = "separator"
        elif sign == "," and wants == "separator" and len(stack) > 1:
            wants = "key" if isinstance(stack[-1], dict) else "value"
        elif sign == ":" and wants == "colon":
            wants = "value"
        elif m[2] and wants in ("key", "first key"):
            keys[-1], at = scanstring(text, at)
            wants = "colon"
        elif not sign and wants in ("value", "first value"):
            if m[2]:
                value, at = scanstring(text, at)
            elif m[6]:
                value = _WORDS[m[6]]
            elif m[4] or m[5]:
                value = float(m[3])
            else:
                value = int(m[3]) if len(m[3]) <= 4000 else Digits(m[3])
            put(value)
            wants = "separator"
        else:
            raise json.JSONDecodeError("unexpected", text, at)
        if wants == "separator" and len(stack) == 1:
            break
    if wants != "separator" or len(stack) > 1 or text[at:].strip(" \t\n\r"):
        raise json.JSONDecodeError("incomplete", text, min(at, last))
    return root[0]


def parse_json(text: str):
    """The value of a JSON text; JSONDecodeError if it is none (NaN and Infinity are none)."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except json.JSONDecodeError:
        raise
    except (ValueError, RecursionError):  # valid so far, but too many digits or too deep for the usual parser
        return _parse_steps(text)


def _text(s: str) -> str:
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _entries(value, listed: bool) -> list:
    """The entries of a value: of an array its elements; where a list is due, JSON text of an array is one, and anything else one entry."""
    if isinstance(value, str) and listed and value.lstrip()[:1] == "[":
        try:
            parsed = parse_json(value)
        except json.JSONDecodeError:
            parsed = None
        if isinstance(parsed, list):
            return parsed
    return value if isinstance(value, list) else [value]


def nodes_of(payload: str, lists: frozenset[str]) -> list[tuple]:
    """(node, parent, label, ordinal, kind, scalar) of every non-null value; the root object is node 0."""
    try:
        root = parse_json(payload)
    except json.JSONDecodeError:
        return []
    if not isinstance(root, dict):
        return []
    out, todo = [(0, None, None, 0, "object", None)], [(0, root)]
    while todo:
        parent, value = todo.pop()
        pairs = [(_text(k), v) for k, v in value.items()] if isinstance(value, dict) else [("", value)]
        for label, v in pairs:
            for i, e in enumerate(_entries(v, label in lists)):
                if e is None:
                    continue
                node, kind, scalar = len(out), None, None
                if isinstance(e, (dict, list)):
                    kind = "object" if isinstance(e, dict) else "array"
                    todo.append((node, e))
                elif isinstance(e, bool):
                    kind, scalar = "boolean", "true" if e else "false"
                elif isinstance(e, int | Digits):
                    kind, scalar = "integer", str(e)
                elif isinstance(e, float):
                    kind, scalar = "number", repr(e)
                else:
                    kind, scalar = "string", _text(e)
                out.append((node, parent, label, i, kind, scalar))
    return out


def shred(df: DataFrame, record: str, payload: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """The adjacency table of JSON payloads. ``lists``: labels under which a list of entries is due."""
    wanted = frozenset(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records, out = [], []
            for r, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                made = nodes_of(p, wanted)
                records += [r] * len(made)
                out += made
                if len(out) > 50_000:
                    yield _batch(records, out)
                    records, out = [], []
            if out:
                yield _batch(records, out)

    rows = df.select(F.col(record).cast("long").alias("record"), F.col(payload).alias("payload")).filter("record is not null and payload is not null")
    return rows.mapInArrow(run, NODES)


_ARROW = pa.schema([("record", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])


def _batch(records: list[int], nodes: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([records, *zip(*nodes)], _ARROW.types)], schema=_ARROW)


def unshred(nodes: list[tuple]) -> dict:
    """The object of one record's nodes; single-element arrays come back as single values. For round-trip tests."""
    made: dict[int, object] = {}
    kids: dict[int, list] = {}
    for n in nodes:
        kids.setdefault(n[1], []).append(n)

    def build(node: tuple):
        _, _, _, _, kind, scalar = node
        if kind == "object" or kind == "array":
            own: dict[str, list] = {}
            for k in kids.get(node[0], []):
                own.setdefault(k[2], []).append((k[3], build(k)))
            single = {label: v[0][1] if len(v) == 1 and v[0][0] == 0 else [x for _, x in sorted(v, key=lambda p: p[0])] for label, v in own.items()}
            return single if kind == "object" else [x for _, x in sorted(own.get("", []), key=lambda p: p[0])]
        return {"boolean": lambda s: s == "true", "integer": int, "number": float}.get(kind, str)(scalar)

    made[0] = build(next(n for n in nodes if n[1] is None))
    return made[0]


def entity(nodes: DataFrame, label: str, parents: DataFrame, fields: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Flat table of the entries under ``label`` of ``parents`` (record, node, path).

    Columns: record, node, parent, ordinal, path (positions from the outermost, joined by points), kind, scalar,
    and for each field its scalar and ``<field>_kind``; ``carry`` are columns taken over from the parents. Entries that are no objects have null fields.
    """
    own = nodes.filter(F.col("label") == label).select("record", "node", "parent", "ordinal", "kind", "scalar")
    up = parents.select("record", F.col("node").alias("parent"), F.col("path").alias("up"), *carry)
    path = F.when(F.col("up") == "", F.col("ordinal").cast("string")).otherwise(F.concat_ws(".", "up", "ordinal"))
    out = own.join(up, ["record", "parent"]).select("record", "node", "parent", "ordinal", path.alias("path"), "kind", "scalar", *carry)
    if fields:
        values = nodes.filter(F.col("label").isin(*fields) & ~F.col("kind").isin("object", "array"))
        picks = [a for f in fields for a in (F.min_by(F.when(F.col("label") == f, F.col("scalar")), F.when(F.col("label") == f, F.col("ordinal"))).alias(f), F.min_by(F.when(F.col("label") == f, F.col("kind")), F.when(F.col("label") == f, F.col("ordinal"))).alias(f"{f}_kind"))]
        pivot = values.groupBy("record", F.col("parent").alias("node")).agg(*picks)
        out = out.join(pivot, ["record", "node"], "left")
    return out


def section_key(section: Column) -> Column:
    """Trimmed, lower case, blanks and hyphens as ``_``; `unknown` if missing or blank."""
    s = F.regexp_replace(F.lower(F.regexp_replace(section, r"^\s+|\s+$", "")), r"[\s\-]", "_")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def paragraph_number(value: Column, kind: Column, ordinal: Column) -> Column:
    """The value if it is an integer or the text of one, else the position."""
    whole = kind.isin("integer", "string") & value.rlike(r"^\s*[+-]?\d+\s*$")
    return F.coalesce(F.when(whole, F.trim(value).try_cast("int")), ordinal)


class DecisionTables:
    """Related flat tables of decisions: paragraphs, their notes, the notes' refs and the case references."""

    LISTS = ("paragraphs", "notes", "refs", "case_references")

    def __init__(self, df: DataFrame, record: str = "record_no", payload: str = "payload"):
        self.nodes = materialize(shred(df, record, payload, self.LISTS), "nodes")
        rows = self._paragraphs(("section", "text", "para_idx"))
        text = F.when(F.col("kind") == "string", F.col("scalar")).otherwise(F.col("text"))
        self.paragraphs = rows.select("record", "node", "ordinal", "path", "section", text.alias("text"), "para_idx")
        self.notes = entity(self.nodes, "notes", self.paragraphs, ("label", "text"))
        self.refs = entity(self.nodes, "refs", self.notes, ("case_no",))
        holder = self.nodes.filter("label = 'court_assessment_references' and parent = 0 and kind = 'object'").select("record", "node", F.lit("").alias("path"))
        self.case_references = entity(self.nodes, "case_references", holder)

    def _paragraphs(self, fields: tuple[str, ...]) -> DataFrame:
        root = self.nodes.filter("parent is null").select("record", "node", F.lit("").alias("path"))
        rows = entity(self.nodes, "paragraphs", root, fields)
        number = paragraph_number(F.col("para_idx"), F.col("para_idx_kind"), F.col("ordinal"))
        return rows.withColumn("section", section_key(F.col("section"))).withColumn("para_idx", number)

    def children(self) -> DataFrame:
        """(record_no, child, pos_path, section, para_idx) of all four tables."""
        carry = ("section", "para_idx")
        keys = ["record", "node", "path", *carry]
        # each level is joined once, with what it takes from the level above
        paragraphs = materialize(self._paragraphs(("section", "para_idx")).select(*keys), "paragraph-keys")
        notes = materialize(entity(self.nodes, "notes", paragraphs, carry=carry).select(*keys), "note-keys")
        refs = entity(self.nodes, "refs", notes, carry=carry)
        out = self.case_references.select("record", F.lit("case_reference").alias("child"), "path", F.lit("").alias("section"), F.lit(-1).alias("para_idx"))
        for name, rows in (("paragraph", paragraphs), ("note", notes), ("ref", refs)):
            out = out.unionByName(rows.select("record", F.lit(name).alias("child"), "path", *carry))
        return out.select(F.col("record").alias("record_no"), "child", F.col("path").alias("pos_path"), "section", "para_idx").distinct()
