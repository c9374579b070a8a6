"""Character n-grams of texts, counted in Arrow batches: the n-grams of ``text.char_ngrams`` without a row for each of them.

The padded text has 37 symbols, so an n-gram is a whole number. The n-grams of some hundred texts are one array of numbers; sorted by n-gram and text
it gives how often each text has each n-gram, and sums over n-grams or texts are sums over runs. What leaves a batch is no larger than what is asked for:
a row per label and n-gram of a partition (``label_sums``), per text and label (``scores``), or per text and n-gram (``frequencies``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW, HIGH = 3, 5
BLANK, SYMBOLS = 1, " 0123456789abcdefghijklmnopqrstuvwxyz"
#: Symbols count from 1, so that n-grams of different lengths are different numbers.
BASE = len(SYMBOLS) + 1
_SYMBOL_OF = np.full(256, BLANK, np.uint8)
_SYMBOL_OF[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(1, BASE)
_BYTE_OF = np.frombuffer(b"\0" + SYMBOLS.encode(), np.uint8)
#: Bytes of text counted at once, and rows of sums that a partition holds before it hands them on.
CHUNK, HELD = 1 << 20, 1 << 20
LABEL_BITS = 24
#: Largest model, in bytes of its numbers, that is sent to every executor's Python; some 2.8 million n-grams with four labels.
MODEL_BYTES = 128 << 20


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and the last ends, and the bytes of all of them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


def encode(tokens: pa.Array) -> np.ndarray:
    """The numbers of n-grams."""
    offsets, data = _buffers(tokens)
    code = np.zeros(len(tokens), np.int64)
    for j in range(HIGH):
        has = np.flatnonzero(np.diff(offsets) > j)
        code[has] = code[has] * BASE + _SYMBOL_OF[data[offsets[has] + j]]
    return code


def decode(code: np.ndarray) -> pa.Array:
    """The n-grams of numbers; 0 is the empty text."""
    rest, marks = code.astype(np.int32), np.empty((len(code), HIGH), np.uint8)
    for j in reversed(range(HIGH)):
        rest, symbol = np.divmod(rest, np.int32(BASE))
        marks[:, j] = _BYTE_OF[symbol]
    used = marks > 0
    offsets = np.append(0, np.cumsum(used.sum(axis=1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(offsets), pa.py_buffer(marks[used]))


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each between blanks and with one blank for what is no letter or digit, and how many each text has."""
    offsets, data = _buffers(texts)
    first = offsets[:-1] + 2 * np.arange(len(texts))
    inside = np.ones(len(data) + 2 * len(texts), bool)
    inside[first] = inside[first + np.diff(offsets) + 1] = False
    symbols = np.full(len(inside), BLANK, np.uint8)
    symbols[inside] = _SYMBOL_OF[data]
    solid = symbols != BLANK
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[first] = True
    return symbols[keep], np.add.reduceat(keep, first, dtype=np.int64)


def _keys(symbols: np.ndarray, sizes: np.ndarray, bits: int, starts: int) -> np.ndarray:
    """Number and text of every n-gram that starts within the first ``starts`` symbols, as one number each, sorted."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(symbols))
    blank = symbols == BLANK
    code, keys = symbols.astype(np.int64), []
    for n in range(2, HIGH + 1):
        code = code[:-1] * BASE + symbols[n - 1 :]
        if n >= LOW:
            m = min(len(code), starts)
            # blanks are never adjacent: an n-gram is mostly blank if both its ends are
            good = (room[:m] >= n) & ~(blank[:m] & blank[n - 1 : n - 1 + m])
            keys.append(code[:m][good] << bits | of[:m][good])
    keys = np.concatenate(keys)
    keys.sort()
    return keys


def _starts_of_runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = _starts_of_runs(keys)
    return keys[new], np.diff(np.append(new, len(keys)))


def _grouped(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts of (key, *numbers) as one, with the sums of each key."""
    key, *numbers = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    new = _starts_of_runs(key := key[order])
    return (key[new], *(np.add.reduceat(x[order], new) if len(new) else x for x in numbers))


def _counted(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: where the slice begins; number, text within the slice and count of its n-grams, by number and text; n-grams of each text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        symbols, sizes = _padded(texts.slice(lo, hi - lo))
        bits = (hi - lo - 1).bit_length()
        if hi - lo > 1:
            keys, n = _runs(_keys(symbols, sizes, bits, len(symbols)))
        else:  # a text of any length, in windows
            keys, n = held = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i in range(0, len(symbols), CHUNK):
                window = symbols[i : i + CHUNK + HIGH - 1]
                keys, n = held = _grouped([held, _runs(_keys(window, np.array([len(window)]), bits, CHUNK))])
        text = keys & ((1 << bits) - 1)
        yield lo, keys >> bits, text, n, np.bincount(text, n, hi - lo)
        lo = hi


def _label_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []

    def handed_on() -> pa.RecordBatch:
        key, docs, tf = held.pop()
        labels = pa.array(list(names), pa.string()).take(pa.array(key & ((1 << LABEL_BITS) - 1)))
        return pa.RecordBatch.from_arrays([labels, decode(key >> LABEL_BITS), pa.array(docs), pa.array(tf)], ["label", "token", "docs", "tf"])

    for batch in batches:
        of, own = pc.list_parent_indices(batch["labels"]).to_numpy(), pc.list_flatten(batch["labels"]).dictionary_encode()
        if not len(of):
            continue
        ids = np.array([names.setdefault(x, len(names)) for x in own.dictionary.to_pylist()])[own.indices.to_numpy()]
        # a row per text and label, by label: what is ordered by n-gram and row is ordered by n-gram and label
        order = np.argsort(ids, kind="stable")
        ids, first = ids[order], np.append(1, (of[1:] != of[:-1]).astype(np.int64))[order]
        for lo, code, text, n, total in _counted(pc.fill_null(batch["text"], "").take(pa.array(of[order]))):
            every = np.arange(len(total))
            row, share = lo + np.append(every, text), np.append(np.ones(len(total)), n / total[text])
            key = np.append(np.zeros_like(every), code) << LABEL_BITS | ids[row]
            new = _starts_of_runs(key)
            held.append((key[new], np.add.reduceat(first[row], new), np.add.reduceat(share, new)))
            if sum(len(x[0]) for x in held) > HELD:
                held[:] = [_grouped(held)]
                if len(held[0][0]) > HELD // 2:
                    yield handed_on()
    if held:
        held[:] = [_grouped(held)]
        yield handed_on()


def label_sums(training: DataFrame) -> DataFrame:
    """(label, token, docs, tf) of texts (text, labels): the sum of the n-gram's share of the texts with that label, and in how many it occurs, where a text counts
    for its first label only, so that sums over labels are numbers of texts. The empty token stands for the texts themselves: tf is their number."""
    rows = training.select(F.lower("text").alias("text"), "labels").mapInArrow(_label_sums, "label string, token string, docs long, tf double")
    return rows.groupBy("label", "token").agg(F.sum("docs").alias("docs"), F.sum("tf").alias("tf"))


def frequencies(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, token, n, tf) as of ``classify.term_frequencies``, for documents with one row each."""
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), T.StructField("token", T.StringType()), T.StructField("n", T.LongType()), T.StructField("tf", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, code, text, n, total in _counted(pc.fill_null(batch["text"], "")):
                code, times = _runs(code)
                tokens = decode(code).take(pa.array(np.repeat(np.arange(len(code)), times)))
                yield pa.RecordBatch.from_arrays([batch["doc"].take(pa.array(lo + text)), tokens, pa.array(n), pa.array(n / total[text])], ["doc", "token", "n", "tf"])

    return docs.select(F.col(doc).alias("doc"), F.lower(text).alias("text")).mapInArrow(run, schema)


def model_bytes(tokens: int, labels: int) -> int:
    """What the model of ``scores`` takes in memory."""
    return tokens * (16 + 8 * labels)


def scores(docs: DataFrame, model: pa.Table, label_norms: dict[str, float], doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, label, score): as ``classify.cosines``, for documents with one row each. ``model``: (token, idf, a weight for each label in the order of ``label_norms``);
    it is sent to every executor, so it has to be small."""
    code = encode(model["token"].combine_chunks())
    order = np.argsort(code)
    idf, *weights = (c.to_numpy()[order] for c in model.columns[1:])
    names, norms = list(label_norms), np.array(list(label_norms.values()))
    sent = docs.sparkSession.sparkContext.broadcast((code[order], idf, weights))
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, weights = sent.value
        for batch in batches:
            for lo, code, text, n, total in _counted(pc.fill_null(batch["text"], "")):
                code, times = _runs(code)
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                seen = known[at] == code
                w = n / total[text] * np.repeat(np.where(seen, idf[at], 1.0), times)
                norm = np.sqrt(np.bincount(text, w * w, len(total)))
                # all weights are above 0, so a sum is 0 only where no n-gram is in common
                dot = np.array([np.bincount(text, w * np.repeat(np.where(seen, x[at], 0.0), times), len(total)) for x in weights])
                label, row = np.nonzero(dot)
                made = dot[label, row] / (norm[row] * norms[label])
                yield pa.RecordBatch.from_arrays([batch["doc"].take(pa.array(lo + row)), pa.array(names, pa.string()).take(pa.array(label)), pa.array(made)], ["doc", "label", "score"])

    return docs.select(F.col(doc).alias("doc"), F.lower(text).alias("text")).mapInArrow(run, schema)
