"""Problem 7: evaluation items that leaked into documents.

Items and documents are turned into templates: numbers, units and names become typed placeholders. Windows of
template words are hash-joined; the words in the slots of a hit are then compared. Where all slots
agree the passage is verbatim, where the same word always stands for the same other word it is the
item with other parameters.

Words are the longest runs of letters and digits and compare without case. An item of fewer words than
a window leaks by all of its words in a row. Null and empty texts, and items without words, leak nothing.

The items are a stated query set. Their windows are a table; what every task gets of it are the distinct hashes alone, of HASH_BYTES at most. Documents are read once and give
the windows whose hash is among these, few as a rule, which are then joined with the table by hash. More hashes than that are taken in blocks, one after the other, with a pass over
the documents each, so that never more than one block is broadcast.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.llm.shingles import window_hashes
from assize.runtime import broadcast_if_small, materialize

WORD = re.compile(r"[^\W_]+")
#: Units that fill a slot of their own (fixed values).
UNITS = frozenset("day days week weeks month months year years hour hours minute minutes euro euros pound pounds dollar dollars km metre metres mile miles kg percent acre acres".split())
NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"
#: Bytes of window hashes that are broadcast at a time (eight each).
HASH_BYTES = 64 << 20


def is_number(word: str) -> bool:
    return word.isdigit()


class Templates:
    """Placeholders as the items define them.

    A word is a name if the items write it with a capital in mid-sentence and never without; a capitalised word of a document that no item
    uses can only be a name, too. The rule looks at a word without its case otherwise, so
    that equal words always get equal placeholders.
    """

    def __init__(self, items: Iterable[str]):
        small, capital, all_ = set(), set(), set()
        for text in items:
            last = 0
            for m in WORD.finditer(text):
                inside = not re.search(r"[.?!:\n]|^$", text[last : m.start()]) and last > 0
                w = m[0]
                all_.add(w.lower())
                if w[:1].isupper():
                    if inside and not w.isupper():
                        capital.add(w.lower())
                elif not is_number(w):
                    small.add(w.lower())
                last = m.end()
        self.names = frozenset(capital - small)
        self.ordinary = frozenset(all_) - self.names
        self._known: dict[str, int] = {}

    def of(self, word: str) -> str:
        low = word.lower()
        if is_number(low):
            return NUMBER
        if low in UNITS:
            return UNIT
        if low in self.names or (low not in self.ordinary and word[:1].isupper()):
            return NAME
        return low

    def ids(self, words: list[str]) -> list[int]:
        known = self._known
        out = []
        for w in words:
            v = known.get(w)
            if v is None:
                if len(known) > 1_000_000:
                    known.clear()
                v = known[w] = xxhash.xxh64_intdigest(self.of(w))
            out.append(v)
        return out

    def __getstate__(self):
        return {"names": self.names, "ordinary": self.ordinary, "_known": {}}


def same_slots(templates: Templates, got: list[str], want: list[str]) -> bool:
    """Whether each filler stands for one other throughout, and ordinary words agree."""
    there, back = {}, {}
    for g, w in zip(got, want):
        slot = templates.of(w)
        if slot == w and g != w:
            return False
        if there.setdefault(w, g) != g or back.setdefault(g, w) != w:
            return False
    return True


def _words_and_ids(templates: Templates, texts: list[str]) -> tuple[list[list[str]], list[list[int]]]:
    raw = [WORD.findall(t) for t in texts]
    return raw, [templates.ids(w) for w in raw]


def _windows(ids: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, first word) of all windows of ``n`` words; a text of fewer words has none."""
    hashes, owner, at = window_hashes([d if len(d) >= n else [] for d in ids], n)
    return hashes.view(np.int64), owner, at


_WINDOW = "item_id long, n int, hash long, want array<string>"
_HIT = "doc_id long, n int, hash long, got array<string>"


class Items:
    """The template windows of the evaluation items as a table."""

    def __init__(self, items: DataFrame, item_id: str, text: str, size: int):
        rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("text is not null and item_id is not null")
        # the words of the items, and which of them are names: a vocabulary
        self.templates = rows.sparkSession.sparkContext.broadcast(Templates(r[0] for r in rows.select("text").toLocalIterator()))
        shared = self.templates

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i, t in zip(b["item_id"].tolist(), b["text"].tolist()):
                    raw, ids = _words_and_ids(shared.value, [t])
                    n = min(size, len(raw[0]))
                    if n:
                        hashes, _, at = _windows(ids, n)
                        low = [w.lower() for w in raw[0]]
                        out += [(i, n, h, low[a : a + n]) for h, a in zip(hashes.tolist(), at.tolist())]
                yield pd.DataFrame(out, columns=["item_id", "n", "hash", "want"])

        self.windows = materialize(rows.mapInPandas(cut, _WINDOW), "item-windows")

    def blocks(self) -> Iterator[dict[int, np.ndarray]]:
        """Sorted hashes by length of window, at most HASH_BYTES together; streamed from the table."""
        most, block, held = HASH_BYTES // 8, {}, 0
        for r in self.windows.select("n", "hash").distinct().orderBy("n", "hash").toLocalIterator(prefetchPartitions=True):
            if held == most:
                yield {n: np.frombuffer(h, dtype=np.int64) for n, h in block.items()}
                block, held = {}, 0
            block.setdefault(r.n, array("q")).append(r.hash)
            held += 1
        if held:
            yield {n: np.frombuffer(h, dtype=np.int64) for n, h in block.items()}


def _hits(docs: DataFrame, items: Items) -> DataFrame:
    """(item_id, want, doc_id, got) of every window of a document whose template is that of an item's window."""
    spark, templates = docs.sparkSession, items.templates
    blocks = items.blocks()
    parts, block = [], next(blocks, None)
    while block is not None:
        shared, more = spark.sparkContext.broadcast(block), next(blocks, None)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                docs = b["doc_id"].tolist()
                raw, ids = _words_and_ids(templates.value, b["text"].tolist())
                for n, table in shared.value.items():
                    hashes, owner, at = _windows(ids, n)
                    if len(hashes):
                        place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                        for k in np.flatnonzero(table[place] == hashes).tolist():
                            d, a = int(owner[k]), int(at[k])
                            out.append((docs[d], n, int(hashes[k]), [w.lower() for w in raw[d][a : a + n]]))
                yield pd.DataFrame(out, columns=["doc_id", "n", "hash", "got"])

        part = docs.mapInPandas(find, _HIT)
        if parts or more is not None:  # one block at a time
            part = materialize(part, "leak-hits")
            shared.unpersist()
        parts.append(part)
        block = more
    if not parts:
        return spark.createDataFrame([], "item_id long, want array<string>, doc_id long, got array<string>")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits.join(broadcast_if_small(items.windows, label="item-windows"), ["n", "hash"]).select("item_id", "want", "doc_id", "got")


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null and doc_id is not null")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 12) -> DataFrame:
    """(doc_id, item_id, kind, windows): how many windows of ``size`` words a document shares with an item, by kind (verbatim or reparameterised)."""
    own = Items(items, item_id, item_text, size)
    templates = own.templates

    @F.pandas_udf(T.BooleanType())
    def consistent(got: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([same_slots(templates.value, list(g), list(w)) for g, w in zip(got, want)], dtype=bool)

    hits = _hits(_documents(docs, doc_id, text), own).withColumn("kind", F.when(F.col("got") == F.col("want"), "verbatim"))
    hits = hits.filter(F.col("kind").isNotNull() | consistent("got", "want"))
    return hits.groupBy("doc_id", "item_id", F.coalesce("kind", F.lit("reparameterised")).alias("kind")).agg(F.count("*").alias("windows"))


def found(docs: DataFrame, items: DataFrame, size: int = 12) -> DataFrame:
    """(doc_id, item_id) with a verbatim passage."""
    hits = _hits(_documents(docs, "doc_id", "text"), Items(items, "item_id", "text", size))
    return hits.filter(F.col("got") == F.col("want")).select("doc_id", "item_id").distinct()
