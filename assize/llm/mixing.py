"""Problem 8: a mixture of sources at target weights, by weighted fair queueing.

Equal texts are one text (that of the smallest id). The texts of each source are shuffled by a hash; a text's virtual finish time is
the number of tokens of its source up to and including it, over all passes so far, divided by the target share. Texts
are taken in the order of these times until the budget is full. A source that runs out of passes leaves
the queue and the others share the rest in proportion to their weights.

Running sums never put a source, or the whole mixture, into one task: rows fall into buckets of the
sort order, the buckets' sums are added up, and exact order matters within a bucket only.

Null and empty texts, null sources and sources without a positive share are not used; a source without texts
is reported with a share of 0.
"""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.runtime import broadcast_if_small, materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this family part a text before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows per bucket that are aimed at, and most buckets.
BUCKET_ROWS, MAX_BUCKETS = 4_000, 1 << 16
#: Slots into which a span of finish times is cut, and rows of a span that is cut no further.
SLOTS, EDGE_ROWS = 1024, 50_000


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str):
    """Vectorised number of tokens, once per distinct text of a batch."""

    def count(s: pd.Series) -> pd.Series:
        enc = _encoding(path)
        codes, values = pd.factorize(s)
        made = [len(enc.encode_ordinary(v)) for v in values] + [0]
        return pd.Series([made[c] for c in codes])

    return F.pandas_udf(count, T.LongType())


class Mixture:
    """``docs`` (id, text, source) mixed by ``targets`` (source, target_share, max_passes); targets are a fixed, small table."""

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: str = os.path.join(TOKENIZERS, VOCABULARY), seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
        spark = docs.sparkSession
        targets = targets.filter("source is not null and target_share > 0 and max_passes > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_passes").alias("max_passes"))
        self.targets = materialize(targets, "mix-targets")
        side = broadcast_if_small(self.targets, label="mix-sources")
        used = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
        used = used.filter("doc_id is not null and text <> '' and source is not null").join(side.select("source"), "source", "left_semi")
        counted = used.select("doc_id", "source", token_counter(tokenizer)("text").alias("tokens"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(3), "text").alias("h2"))
        texts = counted.groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "source", "tokens"), "doc_id").alias("d"), F.sum("tokens").alias("all_tokens"))
        order = F.xxhash64(F.lit(seed), F.col("d.doc_id"))
        texts = texts.select("d.*", "all_tokens", order.alias("at"))
        self.texts = materialize(texts, "mix-texts")
        rows, budget = self.texts.agg(F.count("*"), F.coalesce(F.sum("all_tokens"), F.lit(0))).first()
        self.budget, self.buckets = int(budget), int(min(MAX_BUCKETS, max(8, rows // BUCKET_ROWS)))
        self.spark = spark
        self._queue: DataFrame | None = None
        self._mix: DataFrame | None = None

    def _running(self, rows: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
        """``rows`` with the running sum of tokens in ``order`` within ``group``; ``bucket`` must follow the order."""
        sums = rows.groupBy(*group, bucket).agg(F.sum("tokens").alias("__sum"))
        before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = broadcast_if_small(sums.select(*group, bucket, before.alias("__before")), label="mix-sums")
        inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.join(sums, [*group, bucket]).withColumn(out, F.col("__before") + F.sum("tokens").over(inner)).drop("__before")

    def _passes(self, sources: list) -> dict[str, int]:
        """How many passes of each source can fall before the end of the budget.

        By virtual time t a source has given at least its weight times t, less one text, or all of its passes. The least t at which these add up to the
        budget bounds the last use.
        """
        given = lambda t: sum(min(max(0.0, t * r.target_share - r.longest), float(r.whole) * r.max_passes) for r in sources)
        low, high = 0.0, 1.0
        while high < 1e30 and given(high) < self.budget:
            high *= 2
        if given(high) < self.budget:
            return {r.source: r.max_passes for r in sources}
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if given(mid) < self.budget else (low, mid)
        return {r.source: min(r.max_passes, int(high * r.target_share * (1 + 1e-9) / r.whole) + 1) for r in sources}

    def queue(self) -> DataFrame:
        """(doc_id, source, pass, tokens, finish): the uses that the passes allow, as far as they can fall within the budget, with their virtual finish times."""
        if self._queue is None:
            bucket = F.shiftright(F.shiftrightunsigned("at", 40) * self.buckets, 24)
            rows = self._running(self.texts.filter("tokens > 0").withColumn("bucket", bucket), ["source"], "bucket", ["at", "doc_id"], "upto")
            per_source = self.texts.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("whole"), F.max("tokens").alias("longest")).join(self.targets, "source")
            sources = per_source.collect()  # a row per source of the targets
            needed = self._passes(sources)
            made = [(r.source, r.whole, r.target_share, needed[r.source]) for r in sources]
            side = broadcast_if_small(self.spark.createDataFrame(made, "source string, whole long, target_share double, needed int"), label="mix-passes")
            rows = rows.join(side, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("needed") - 1)))
            finish = (F.col("pass") * F.col("whole") + F.col("upto")) / F.col("target_share")
            self._queue = materialize(rows.select("doc_id", "source", "pass", "tokens", finish.alias("finish")), "mix-queue")
        return self._queue

    def _edge(self) -> tuple[float, float, int] | None:
        """(low, high, used): the span of finish times in which the budget ends, and the tokens before it; None if all uses fit.

        The span is cut into SLOTS, of which the one where the budget ends becomes the next span, until it holds at most EDGE_ROWS uses. However
        unevenly finish times lie, few rows are left, as a source finishes at one time once only.
        """
        q, low, high, used = self.queue(), None, None, 0
        while True:
            rows = q if low is None else q.filter((F.col("finish") >= low) & (F.col("finish") <= high))
            if low is None:
                low, high = rows.agg(F.min("finish"), F.max("finish")).first()
                if low is None:
                    return None
            slot = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(max(high - low, 1e-300)) * SLOTS), F.lit(SLOTS - 1))
            sums = rows.groupBy(slot.alias("slot")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high"))
            for r in sorted(sums.collect(), key=lambda r: r.slot):  # at most SLOTS rows
                if used + r.t > self.budget:
                    break
                used += r.t
            else:
                return None
            if r.n <= EDGE_ROWS or r.low == r.high or (r.low, r.high) == (low, high):
                return r.low, r.high, used
            low, high = r.low, r.high

    def mix(self) -> DataFrame:
        """(doc_id, source, pass, tokens, finish) of the uses that fit the budget, in range-sorted order of finish."""
        if self._mix is None:
            q, edge = self.queue(), self._edge()
            if edge is not None:
                low, high, used = edge
                w = Window.orderBy("finish", "source", "doc_id", "pass").rowsBetween(Window.unboundedPreceding, 0)  # at most EDGE_ROWS rows
                part = q.filter((F.col("finish") >= low) & (F.col("finish") <= high)).withColumn("upto", F.sum("tokens").over(w)).filter(F.col("upto") <= self.budget - used)
                q = q.filter(F.col("finish") < low).unionByName(part.drop("upto"))
            self._mix = q
        return self._mix

    def ordered(self) -> DataFrame:
        """The mixture globally range-sorted by virtual finish time."""
        return self.mix().repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id", "pass")

    def report(self) -> DataFrame:
        """Per source: target and actual share of the mixture's tokens, uses, most passes, and whether the target could be reached."""
        used = self.mix().groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("pass") + 1).alias("passes"))
        have = self.texts.groupBy("source").agg(F.sum("tokens").alias("whole"), F.count("*").alias("texts"))
        rows = self.targets.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["tokens", "uses", "passes", "whole", "texts"])
        total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per source of the targets
        actual = F.coalesce(F.try_divide(F.col("tokens").cast("double"), total.cast("double")), F.lit(0.0))
        reach = F.col("whole") * F.col("max_passes") >= F.col("target_share") * self.budget
        return rows.select("source", "target_share", actual.alias("actual_share"), "tokens", "texts", "uses", "passes", "max_passes", reach.alias("reachable"))
