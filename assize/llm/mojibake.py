"""Problem 9: text that was decoded with the wrong character encoding.

The distinct clean words of the corpus are put through all encoding chains, and the garbled forms that come out are hash-joined with the
words of the documents. A word that equals a garbled form is evidence of
its chain, and the word behind the form is its verified original (garbling it gives exactly what was found).

There are three kinds of chains. *Multi*: UTF-8 bytes read in a one-byte encoding, once or more often. *Lossy*: bytes
that were replaced by U+FFFD. *Single*: bytes of one one-byte encoding read in another.
A name that occurs nowhere else has no clean word. For it originals are proposed: every unbroken run of non-ASCII characters is read back, as often as that
goes on, and what comes out joins the clean words. Its forms are generated along the same chains as those of words and hash-joined with
the runs of the documents' words, so that here, too, only what garbling gives exactly is evidence. Of a single lost character the form is U+FFFD itself.
Single-byte forms are ordinary letters, so only words tell,
and a document needs two such words of one chain, or one that cannot be a word as it stands. That original and form are not taken for each other is judged by the document's own words,
whatever the number of garbled documents: by how much more plausible its originals look (see ``plausible``) and, where they look alike,
by how many of the words that the chain may have changed it explains. A word whose original is far more frequent counts without that.

Nulls and empty texts hold no words; words are parted at ASCII white space, so very long texts need no more
memory than themselves.
"""

from __future__ import annotations

import functools
import itertools
import string
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.runtime import broadcast_if_small, materialize

#: Encodings as which UTF-8 is misread, and pairs of one-byte encodings that are taken for each other (fixed values).
READERS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1254", "cp1253", "cp1257"]
REPEATED = ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251"]
SINGLE = [
    ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1254", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"),
    ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1253", "cp1252"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("iso8859-5", "cp1251"), ("cp1251", "mac_roman"),
    ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("cp1257", "cp1252"), ("iso8859-16", "cp1252"),
]
LOSSY = ["cp1252", "cp1250", "cp1251", "cp1254", "koi8-r", "iso8859-16", "mac_roman"]

#: Most distinct pairs of characters, and most bytes of words with lost characters, that are broadcast to leave out impossible forms early; beyond, all forms are joined.
MAX_PAIRS, MAX_DAMAGED_BYTES = 200_000, 16 << 20
#: Words of one chain of the third kind that a document needs, and how much more frequent an original must be to need no other evidence.
LEAST_WORDS, TIMES = 2, 3
#: How much more plausible an original must be than a form that is no word, for one word to be enough.
SURE_GAIN = 0.75

LETTERS = regex.compile(r"[\p{L}\p{M}]")
CLEAN = regex.compile(r"[“”„‘’«»‹›\-–—(]*[\p{L}\p{M}]+(?:['’\-–][\p{L}\p{M}]+)*[“”„‘’«»‹›\-–—…)]*")
ODD = regex.compile(r"[ªºµƒˆ˜]|\p{Ll}\p{Lu}")
#: The most frequent Cyrillic letters, of about four fifths of ordinary text (fixed values).
FREQUENT = frozenset("оеаинтсрвлкмдпу")
LATIN, CYRILLIC, GREEK = (regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Cyrillic", "Greek"))


@functools.lru_cache(maxsize=64)
def _decoder(name: str) -> list[str]:
    """The 256 characters of a one-byte encoding; bytes without one stand for the control of the same number."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


def _read(data: bytes, name: str) -> str:
    table = _decoder(name)
    return "".join([table[b] for b in data])


def chains() -> dict[str, tuple]:
    """All chains by name."""
    out: dict[str, tuple] = {f"multi:{r}": ("multi", (r,)) for r in READERS}
    out |= {f"multi:{a}+{b}": ("multi", (a, b)) for a, b in itertools.product(REPEATED, REPEATED)}
    out |= {f"multi:{a}+{a}+{a}": ("multi", (a, a, a)) for a in ("cp1252", "latin-1")}
    out |= {f"single:{a}>{b}": ("single", (a, b)) for a, b in SINGLE}
    out |= {f"lossy:{a}": ("lossy", (a,)) for a in LOSSY}
    return out


CHAINS = chains()


def garble(word: str, chain: str) -> str | None:
    """What the chain makes of the word; None if the word cannot be written in the first encoding."""
    kind, names = CHAINS[chain]
    if kind == "multi":
        for name in names:
            word = _read(word.encode("utf-8", "surrogatepass"), name)
        return word
    try:
        data = word.encode(names[0])
    except UnicodeEncodeError:
        return None
    if kind == "single":
        return _read(data, names[1])
    form = data.decode("utf-8", "replace")
    return form if "�" in form else None  # else nothing was lost, and the word itself is the garbled one


_WORDS = r"(?<![^ \t\r\n])[\x00-\x7F&&[^ \t\r\n]]*+[^\x00-\x7F][^ \t\r\n]*"
_STRIP = string.punctuation


def doc_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, word): the distinct words with a non-ASCII character, without ASCII punctuation around them."""
    words = F.transform(F.regexp_extract_all(F.col(text), F.lit(_WORDS), F.lit(0)), lambda w: F.btrim(w, F.lit(_STRIP)))
    return docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(F.array_distinct(words)).alias("word"))


def looks_clean(word: str) -> bool:
    """Letters of one script, perhaps within quotes or dashes."""
    if not CLEAN.fullmatch(word) or ODD.search(word):
        return False
    return bool(LATIN.search(word)) + bool(CYRILLIC.search(word)) + bool(GREEK.search(word)) == 1


def plausible(word: str) -> float:
    """How ordinary a word looks, from 0 to 1, by fixed values alone: the corpus has no say in it."""
    if not looks_clean(word):
        return 0.0
    letters = [c for c in word.casefold() if LETTERS.match(c)]
    return sum(1.0 if c.isascii() or c in FREQUENT or GREEK.match(c) else 0.5 for c in letters) / len(letters)


#: Chains of the third kind that are not undone by another one: their originals cannot be forms of it.
ONE_WAY = [f"single:{a}>{b}" for a, b in SINGLE if (b, a) not in SINGLE]


@functools.lru_cache(maxsize=64)
def changed_by(chain: str) -> str:
    """A pattern of the characters that a chain of the third kind may have put in the place of others."""
    a, b = (_decoder(n) for n in CHAINS[chain][1])
    return "[" + "".join(f"\\x{{{ord(y):x}}}" for x, y in zip(a, b) if x != y and y > "\x9f") + "]"


_FORMS = T.StructType([T.StructField(n, T.StringType()) for n in ("form", "original", "chain")] + [T.StructField("original_docs", T.LongType()), T.StructField("gain", T.DoubleType())])


class FormMaker:
    """Garbled forms of words, as far as a corpus with these characters and pairs of characters can hold them.

    All chains but the lossy ones work character by character. For each character the chains are kept whose form the
    corpus can hold; a word needs trying only the chains that all of its characters allow.
    """

    def __init__(self, alphabet: list[str], pairs: list[str] | None, damaged: list[str] | None):
        self.alphabet, self.pairs = frozenset(alphabet), None if pairs is None else frozenset(pairs)
        self.damaged = None if damaged is None else frozenset(damaged)
        self.names = [c for c, (kind, _) in CHAINS.items() if kind != "lossy" or "�" in self.alphabet]
        self.lossy = sum(1 << i for i, c in enumerate(self.names) if CHAINS[c][0] == "lossy")

    def possible(self, form: str) -> bool:
        pairs = self.pairs
        if pairs is None:
            return True
        last = form[:1]
        for c in form[1:]:
            if (c > "\x7f" or last > "\x7f") and last + c not in pairs:
                return False
            last = c
        return True

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: list[dict[int, str]] = [{} for _ in self.names]
        masks: dict[str, int] = {}

        def mask(ch: str) -> int:
            bits = self.lossy
            for i, chain in enumerate(self.names):
                if not bits >> i & 1:
                    form = garble(ch, chain)
                    if form is not None and all(c <= "\x7f" or c in self.alphabet for c in form) and self.possible(form):
                        tables[i][ord(ch)] = form
                        bits |= 1 << i
            masks[ch] = bits
            return bits

        for b in batches:
            out = []
            for word, n in zip(b["word"], b["docs"]):
                bits = -1
                for ch in word:
                    if ch > "\x7f":
                        bits &= masks[ch] if ch in masks else mask(ch)
                if not bits or not looks_clean(word):
                    continue
                seen = set()
                for i, chain in enumerate(self.names):
                    if not bits >> i & 1:
                        continue
                    lost = self.lossy >> i & 1
                    form = garble(word, chain) if lost else word.translate(tables[i])
                    if form is None or form == word:
                        continue
                    form = form.strip(_STRIP)
                    single = chain.startswith("single:")
                    key = (form, chain if single else chain[:5])
                    held = form in self.damaged if lost and self.damaged is not None else self.possible(form)
                    if held and form and not form.isascii() and key not in seen:
                        seen.add(key)
                        out.append((form, word, chain, n, round(plausible(word) - plausible(form), 6) if single else 0.0))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=_FORMS.names)
                    out = []
            yield pd.DataFrame(out, columns=_FORMS.names)


def _pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of characters with a non-ASCII one in the words of each batch."""
    for b in batches:
        found = {w[i : i + 2] for w in b["word"] for i in range(len(w) - 1) if w[i] > "\x7f" or w[i + 1] > "\x7f"}
        yield pd.DataFrame({"pair": sorted(found)})


class Originals:
    """Proposes what runs of non-ASCII characters may have been, by the forms of single characters under the chains of the first kind."""

    def __init__(self, characters: list[str]):
        self.chains = [c for c, (kind, _) in CHAINS.items() if kind == "multi"]
        self.forms: list[dict[str, str]] = []
        self.starts: dict[str, list[int]] = {}
        for i, chain in enumerate(self.chains):
            table: dict[str, str] = {}
            for c in characters:
                form = garble(c, chain)
                if len(form) > 1 and not any(ch.isascii() for ch in form):
                    table.setdefault(form, c)
            self.forms.append(table)
            for start in {f[:2] for f in table}:
                self.starts.setdefault(start, []).append(i)
        self.longest = [max(map(len, t), default=0) for t in self.forms]

    def read_back(self, run: str, i: int) -> str | None:
        """The run read back form by form; None unless all of it consists of forms."""
        table, most, out, at = self.forms[i], self.longest[i], [], 0
        while at < len(run):
            for n in range(min(most, len(run) - at), 1, -1):
                c = table.get(run[at : at + n])
                if c is not None:
                    out.append(c)
                    at += n
                    break
            else:
                return None
        return "".join(out)

    def proposals(self, run: str) -> list[tuple[str, str]]:
        """(original, chains that lead to the run, the last one first) of every reading, read back until nothing changes; each step is shorter than the one before."""
        out, seen, todo = [], {run}, [(run, ())]
        while todo:
            text, path = todo.pop()
            ends = True
            for i in self.starts.get(text[:2], ()):
                before = self.read_back(text, i)
                if before is not None:
                    ends = False
                    if before not in seen:
                        seen.add(before)
                        todo.append((before, (*path, self.chains[i])))
            if ends and path:
                out.append((text, "\n".join(path)))
        return out


def _garbled_along(original: str, path: str) -> str:
    for chain in reversed(path.split("\n")):
        original = garble(original, chain)
    return original


_EVIDENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("word", "original", "chain")])
#: Of words of the third kind also how often original and form occur and how much more plausible the original is.
_WEIGHED = ["original_docs", "docs", "gain"]


class Mojibake:
    """Garbled words of a corpus of documents."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.docs, self.doc_id, self.text = docs, doc_id, text
        # written once: the texts are read and parted a single time
        self.pairs = materialize(doc_words(docs, doc_id, text), "document-words")
        self.words = materialize(self.pairs.groupBy("word").agg(F.count("*").alias("docs")).filter("word <> ''"), "words")
        self._evidence: DataFrame | None = None

    def alphabet(self) -> list[str]:
        """The distinct non-ASCII characters of the corpus: a set of single characters, bounded by Unicode whatever the corpus."""
        rows = self.words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c > '\x7f'").distinct().collect()
        return sorted(r.c for r in rows)

    def _pairs(self) -> list[str] | None:
        """The pairs of characters of the corpus if there are at most MAX_PAIRS, else None: then forms are left to the join."""
        rows = self.words.select("word").mapInPandas(_pairs_of, "pair string").distinct().head(MAX_PAIRS + 1)
        return None if len(rows) > MAX_PAIRS else [r.pair for r in rows]

    def _damaged(self) -> list[str] | None:
        """The words with lost characters if they are at most MAX_DAMAGED_BYTES, else None."""
        rows = self.words.select("word").filter(F.col("word").contains("�"))
        size = rows.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0]
        return [r.word for r in rows.collect()] if size <= MAX_DAMAGED_BYTES else None

    def _by_characters(self, alphabet: list[str]) -> DataFrame:
        """(word, original, chain): words with a run of characters that is a garbled form of a proposed original."""
        sc = self.words.sparkSession.sparkContext
        # names may hold letters that the corpus shows garbled only
        written = {c for name in {n for _, names in CHAINS.values() for n in names} for c in _decoder(name) if c > "\x9f"}
        shared = sc.broadcast(Originals(sorted(written.union(alphabet) - {"�"})))
        # forms have two characters and more, but for that of a lost character
        several = F.regexp_extract_all("word", F.lit(r"[^\x00-\x7F]{2,}"), F.lit(0))
        lost = F.when(F.col("word").contains("�"), F.array(F.lit("�"))).otherwise(F.array().cast("array<string>"))
        runs = self.words.filter(F.col("word").rlike("[^\\x00-\\x7F]{2}|�")).select("word", F.explode(F.array_distinct(F.concat(several, lost))).alias("run"))

        def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = {p for run in b["run"] for p in shared.value.proposals(run)}
                yield pd.DataFrame(sorted(made), columns=["original", "path"])

        def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(form=[_garbled_along(o, p) for o, p in zip(b["original"], b["path"])])

        originals = runs.select("run").mapInPandas(propose, "original string, path string").distinct()
        made = originals.mapInPandas(generate, "original string, path string, form string")
        for chain, (kind, _) in CHAINS.items():
            # what a lost character was is not known: the form of any one is its own original
            if kind == "lossy" and any(garble(c, chain) == "�" for c in alphabet):
                made = made.unionByName(made.sparkSession.createDataFrame([("�", chain, "�")], "original string, path string, form string"))
                break
        hit = runs.join(broadcast_if_small(made, label="forms-of-runs"), F.col("run") == F.col("form"))
        order = F.array_position(F.array(*[F.lit(c) for c in CHAINS]), F.split("path", "\n")[0])
        # of several chains the one that explains most of the word
        ways = hit.groupBy("word", "path").agg(F.sum(F.length("run")).alias("explained"), F.collect_list(F.struct("run", "original")).alias("runs"))
        best = ways.groupBy("word").agg(F.max_by(F.struct("path", "runs"), F.struct("explained", -order, "path")).alias("b")).select("word", "b.*")

        @F.pandas_udf(T.StringType())
        def swapped(words: pd.Series, pairs: pd.Series) -> pd.Series:
            run = regex.compile(r"[^\x00-\x7f]+")
            tables = [{p["run"]: p["original"] for p in row} for row in pairs]
            return pd.Series([run.sub(lambda m, t=t: t.get(m[0], m[0]), w) for w, t in zip(words, tables)], dtype=object)

        return best.select("word", swapped("word", "runs").alias("original"), F.split("path", "\n")[0].alias("chain"))

    def evidence(self) -> DataFrame:
        """(word, original, chain, original_docs, docs, gain): every word of the corpus that is a garbled form; of the third kind once for each chain."""
        if self._evidence is None:
            n = int(self.words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            alphabet = self.alphabet()
            maker = self.words.sparkSession.sparkContext.broadcast(FormMaker(alphabet, self._pairs(), self._damaged()))
            forms = self.words.repartition(n, "word").mapInPandas(lambda batches: maker.value.run(batches), _FORMS)
            joined = self.words.join(forms, F.col("word") == F.col("form"))
            single = F.col("chain").startswith("single:")
            joined = materialize(joined, "garbled-forms")
            readings = joined.filter(single).groupBy("word", "chain").agg(F.max_by(F.struct("original", *_WEIGHED), F.struct("original_docs", "original")).alias("b")).select("word", "b.original", "chain", *[f"b.{c}" for c in _WEIGHED])
            kinds = joined.filter(~single | (F.col("original_docs") >= TIMES * F.col("docs"))).groupBy("word", F.substring("chain", 1, 5).alias("kind"))
            by_word = kinds.agg(F.max_by(F.struct("original", "chain"), F.struct("original_docs", "original", "chain")).alias("b"), F.min("original").alias("low"), F.max("original").alias("high"))
            # where characters were lost, only the one word that fits is restored
            unclear = (F.col("kind") == "lossy") & (F.col("low") != F.col("high"))
            by_word = by_word.select("word", F.when(unclear, F.col("word")).otherwise(F.col("b.original")).alias("original"), "b.chain")
            multi = by_word.filter(~F.col("chain").startswith("single:"))
            # words of the corpus come first; proposed originals fill in what no word explains
            both = multi.withColumn("rank", F.lit(0)).unionByName(self._by_characters(alphabet).withColumn("rank", F.lit(1)))
            best = both.groupBy("word").agg(F.min_by(F.struct("original", "chain"), F.struct("rank", "chain")).alias("b")).select("word", "b.*")
            singles = by_word.filter(F.col("chain").startswith("single:"))
            direct = materialize(best.unionByName(singles), "garbled-words-once")
            # an original that is garbled itself leads on to its own
            further = direct.select(F.col("word").alias("w2"), F.col("original").alias("o2")).filter("w2 <> o2")
            further = further.groupBy("w2").agg(F.min("o2").alias("o2"))
            rows = direct.filter(~F.col("chain").startswith("single:")).unionByName(readings, allowMissingColumns=True)
            step = rows.join(further, F.col("original") == F.col("w2"), "left").select("word", F.coalesce("o2", "original").alias("original"), "chain", *_WEIGHED)
            self._evidence = materialize(step, "garbled-words")
        return self._evidence

    def hits(self) -> DataFrame:
        """(doc_id, word, original, chain) in documents with enough evidence."""
        found = materialize(self.pairs.join(broadcast_if_small(self.evidence(), label="garbled"), "word"), "garbled-pairs")
        columns = ["doc_id", "word", "original", "chain"]
        sure = found.filter(~F.col("chain").startswith("single:")).select(*columns)
        single = found.filter(F.col("chain").startswith("single:")).withColumn("frequent", F.col("original_docs") >= TIMES * F.col("docs"))
        counts = [F.count("*").alias("n"), F.count_if("frequent").alias("frequent"), F.count_if(F.col("gain") > 0).alias("better"), F.sum("gain").alias("gain"), (F.sum("original_docs") > F.sum("docs")).alias("more"), F.max("gain").alias("most")]
        chains = materialize(single.groupBy("doc_id", "chain").agg(*counts).filter((F.col("n") >= LEAST_WORDS) | (F.col("most") >= SURE_GAIN)), "garbled-chains")
        # a form of no gain at all is no word: letters of two scripts, or signs among letters
        known = (F.col("most") >= SURE_GAIN) | (F.col("frequent") >= LEAST_WORDS) | ((F.col("better") >= LEAST_WORDS) & (F.round("gain", 4) > 0))
        # originals and forms look alike: the chain must not be the other way round, and explain half of the words that it may have changed
        alike = chains.filter(~known & (F.round("gain", 4) >= 0) & (F.col("chain").isin(ONE_WAY) | F.col("more")))
        pattern = functools.reduce(lambda c, name: c.when(F.col("chain") == name, F.col("word").rlike(changed_by(name))), [k for k, (kind, _) in CHAINS.items() if kind == "single"], F.when(F.lit(False), False))
        changed = self.pairs.join(alike.select("doc_id", "chain", "n"), "doc_id").filter(pattern).groupBy("doc_id", "chain").agg(F.count("*").alias("changed"), F.first("n").alias("n"))
        enough = chains.filter(known).select("doc_id", "chain", "n").unionByName(changed.filter(F.col("n") * 2 >= F.col("changed")).select("doc_id", "chain", "n"))
        # a passage in another language may hold such words rightly decoded: there the original is the rarer one
        meant = F.col("frequent") | (F.col("gain") > 0) | (F.col("original_docs") >= F.col("docs")) | ((F.col("gain") == 0) & F.col("chain").isin(ONE_WAY))
        # of several chains the one that explains most of the document
        words = single.filter(meant).join(enough, ["doc_id", "chain"]).groupBy("doc_id", "word").agg(F.max_by(F.struct("original", "chain"), F.struct("n", "original_docs", "original", "chain")).alias("b"))
        return sure.unionByName(words.select("doc_id", "word", "b.original", "b.chain"))

    def found(self) -> DataFrame:
        """(doc_id) of every document with garbled text."""
        return self.hits().select("doc_id").distinct()

    def restored(self) -> DataFrame:
        """(doc_id, text, garbled_words, lost): the affected documents, words replaced by their originals; lost counts words that cannot be restored."""
        per_doc = self.hits().groupBy("doc_id").agg(F.collect_set(F.struct("word", "original")).alias("pairs"), F.count_if(F.col("original").contains("�")).alias("lost"))
        rows = self.docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).alias("text")).join(per_doc, "doc_id")
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("garbled_words", T.LongType()), T.StructField("lost", T.LongType())])

        def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for d, text, pairs, lost in zip(b["doc_id"], b["text"], b["pairs"], b["lost"]):
                    table = {p["word"]: p["original"] for p in pairs}
                    word = regex.compile(r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*+")

                    def swap(m, table=table):
                        core = m[0].strip(_STRIP)
                        at = m[0].find(core)
                        return m[0][:at] + table.get(core, core) + m[0][at + len(core) :]

                    out.append((d, word.sub(swap, text), len(table), lost))
                yield pd.DataFrame(out, columns=schema.names)

        return rows.mapInPandas(fix, schema)
