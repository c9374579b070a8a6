"""Splitting decisions into labelled sections with small automata.

A paragraph is reduced to a number of signals by regular expressions in the JVM. An automaton of few states reads the
signals in order. As it is finite, it runs in pieces: each chunk of a long decision is mapped from every possible start state to
its end state, the chunks' maps are chained, and then every chunk is labelled from its true start. So one decision of
any length is spread over many tasks, and no paragraph text is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.functions import text as X
from assize.runtime import materialize

CHUNK = 4096
React = Callable[[int, int], tuple[int, str]]

#: Patterns of the paragraphs that move the law automaton (fixed values); all without case, white space of any kind.
LAW_PATTERNS = {
    "fragment": r"^(Prepared\s+by\s+the\s+Registry|STRASBOURG$|^\d{1,2}\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+20|^This\s+judgment\s+will\s+become\s+final|^In\s+the\s+case\s+of\s+|^The\s+European\s+Court\s+of\s+Human\s+Rights\s+\(|^Having\s+regard\s+to:|^the\s+application|^the\s+decision\s+to\s+give|^the\s+parties['’]\s+observations;?$|^Having\s+deliberated|^Delivers\s+the\s+following)",
    "opinion": r"(CONCURRING|DISSENTING|SEPARATE)\s+OPINION",
    "article_41": r"APPLICATION\s+OF\s+ARTICLE\s*41",
    "article_46": r"(APPLICATION\s+OF\s+ARTICLE.*46|Article\s+46\s+of\s+the\s+Convention)",
    "article_46_first": r"46\s+(and|&)\s+41",
    "names_violation": r"(violation|no\s+violation)\s+of\s+Article",
    "mentions_41": r"Article\s+41\s+of\s+the\s+Convention",
    "admissibility": r"(\(a\)\s*Admissibility|^\d+\.\s*Admissibility|^Admissibility)",
    "merits": r"(\(b\)\s*Merits|\bMerits\b\s*(The\s+parties|$))",
    "principles": r"General\s+principles",
    "assessment": r"The\s+Court['’]s\s+assessment",
    "declared": r"(declared\s+admissible|must\s+therefore\s+be\s+declared\s+admissible|not\s+inadmissible\s+on\s+any\s+other\s+grounds)",
    "then_merits": r"(?s)admissible.*Merits",
    "finding": r"(there\s+has(\s+accordingly)?\s+been\s+(a\s+)?violation|there\s+has\s+been\s+no\s+violation|finds?\s+that\s+there\s+(has\s+been|was)\s+(a\s+)?violation)",
    "alleged": r"ALLEGED\s+VIOLATION\s+OF\s+ARTICLE",
    "joinder": r"(JOINDER\s+OF\s+THE\s+APPLICATION|PRELIMINARY\s+OBJECTION)",
    "admissible": r"admissibl",
}
#: Small-letter text without which a pattern cannot match; looked for first.
NEEDLES = {
    "opinion": "opinion", "article_41": "application", "article_46": "46", "article_46_first": "46", "names_violation": "violation", "mentions_41": "41", "admissibility": "admissibility", "merits": "merits",
    "principles": "principles", "assessment": "assessment", "declared": "admissible", "then_merits": "merits", "finding": "violation", "alleged": "alleged", "admissible": "admissibl",
}
#: A judge's name alone, with case (a fixed value).
JUDGE_NAME = r"^[A-ZÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ][a-záàâãéèêíïóôõöúçñ]+\s*,?\s*(President|Registrar|judge|ad\s+hoc)?$"
_MULTILINE = {"admissibility", "merits"}
SIGNALS = ["header", *[k for k in LAW_PATTERNS if k != "fragment"]]
_BIT = {name: 1 << i for i, name in enumerate(SIGNALS)}
LAW_STATES = ["start", "admissibility", "pending", "merits", "satisfaction", "execution", "opinion"]
START, ADMISSIBILITY, PENDING, MERITS, SATISFACTION, EXECUTION, OPINION = range(7)
_MODE = {SATISFACTION: "just_satisfaction", EXECUTION: "article_46"}

#: Words of headings and of running text about proceedings, and of headings about the background (fixed values).
PROCEEDINGS_HEADING = r"(proceedings|appeal|judicial|court|tribunal|constitutional|supreme|cassation|disciplinary|criminal\s+(investigation|case)|detention|remand|arrest|investigat)"
BACKGROUND_HEADING = r"(background|context|circumstances|events|facts|history|incident|report|assessment|information|declaration|vetting|inspection|applicant.{0,20}posts?|legislation|reform|domestic\s+law)"
PROCEEDINGS_WORDS = r"(proceedings|lodged|appealed|judgment|court|tribunal|decision|hearing|complaint|sentenced|convicted|acquitted|remand|detention|arrested|charged)"
QUIET, TO_BACKGROUND, TO_PROCEEDINGS, BUSY = range(4)
FACTS = ["facts_background", "facts_proceedings"]


def _matches(c: Column, pattern: str, flags: str = "iud") -> Column:
    return c.rlike(f"(?{flags}U)" + pattern)


def law_signals(text: Column) -> Column:
    """Bit set of the signals of a stripped paragraph."""
    n = F.length(text)
    header = (_matches(text, LAW_PATTERNS["fragment"]) & (n < 200)) | (_matches(text, JUDGE_NAME, "d") & (n < 60)) | (n <= 3)
    out, low = F.when(header, _BIT["header"]).otherwise(0), F.lower(text)
    for name in SIGNALS[1:]:
        hit = _matches(text, LAW_PATTERNS[name], "iudm" if name in _MULTILINE else "iud")
        out = out + F.when(low.contains(NEEDLES[name]) & hit if name in NEEDLES else hit, _BIT[name]).otherwise(0)
    return out.cast("int")


def law_reaction(state: int, signals: int) -> tuple[int, str]:
    """Next state and section of a paragraph."""
    has = lambda name: bool(signals & _BIT[name])
    if has("header"):
        return state, "header"
    if has("opinion") or state == OPINION:
        return OPINION, "separate_opinion"
    if has("article_41") or has("article_46"):
        mode = EXECUTION if has("article_46") and (has("article_46_first") or not has("article_41")) else SATISFACTION
        return mode, "merits" if has("names_violation") else _MODE[mode]
    if state in _MODE:
        # the way back to execution is a mention of Article 46, seen above
        mode = SATISFACTION if has("mentions_41") else state
        return mode, _MODE[mode]
    for name, target in (("admissibility", ADMISSIBILITY), ("merits", MERITS), ("principles", MERITS), ("assessment", MERITS)):
        state = target if has(name) else state
    if state == ADMISSIBILITY and has("declared"):
        return (MERITS if has("then_merits") else PENDING), "admissibility"
    if state in (ADMISSIBILITY, MERITS) and has("finding"):
        return state, "admissibility" if state == ADMISSIBILITY and has("admissibility") else "merits"
    if has("alleged"):
        return ADMISSIBILITY, "admissibility"
    if state in (PENDING, MERITS):
        return MERITS, "merits"
    opens = state == START and has("admissible") and not has("joinder")
    return (ADMISSIBILITY if opens else state), "admissibility"


def facts_signal(text: Column) -> Column:
    """Whether a stripped paragraph is a heading, and of what, or speaks of proceedings repeatedly."""
    clean = F.regexp_replace(text, r"(?U)^\d+\.\s*", "")
    heading = (F.length(text) < 100) & ~text.endswith(".") & (F.length(clean) > 2) & clean.rlike(r"^\p{Lu}")
    roman = text.rlike(r"(?U)^[IVX]+\.\s+[A-Z]") & (F.length(text) < 120)
    body = F.regexp_replace(text, r"(?U)^[IVX]+\.\s*", "")

    def kind(c: Column) -> Column:
        return F.when(_matches(c, PROCEEDINGS_HEADING), TO_PROCEEDINGS).when(_matches(c, BACKGROUND_HEADING), TO_BACKGROUND)

    busy = F.lower(text).rlike(f"(?s){PROCEEDINGS_WORDS}.*?{PROCEEDINGS_WORDS}")
    return F.coalesce(F.when(roman, kind(body)), F.when(heading, kind(clean)), F.when(busy, BUSY), F.lit(QUIET)).cast("int")


def facts_reaction(state: int, signal: int) -> tuple[int, str]:
    if signal in (TO_BACKGROUND, TO_PROCEEDINGS):
        state = signal - TO_BACKGROUND
    elif signal == BUSY:
        state = 1
    return state, FACTS[state]


def _end_states(react: React, states: int) -> Callable:
    """Over sorted rows (g, c, ..., signal): for each chunk the end state of every start state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, now, out = None, [], []
        for b in batches:
            for g, c, signal in zip(b["g"].tolist(), b["c"].tolist(), b["signal"].tolist()):
                if (g, c) != current:
                    if current is not None:
                        out.append((*current, now))
                    current, now = (g, c), list(range(states))
                now = [react(s, signal)[0] for s in now]
            yield pd.DataFrame(out, columns=["g", "c", "ends"])
            out = []
        yield pd.DataFrame([(*current, now)] if current is not None else [], columns=["g", "c", "ends"])

    return run


def _labels(react: React) -> Callable:
    """Over sorted rows (g, c, ..., signal, start): the rows with their labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple[int, int], tuple[int, str]] = {}
        current, state = None, 0
        for b in batches:
            labels = []
            for g, c, signal, start in zip(b["g"].tolist(), b["c"].tolist(), b["signal"].tolist(), b["start"].tolist()):
                if (g, c) != current:
                    current, state = (g, c), start
                step = memo.get((state, signal))
                if step is None:
                    step = memo[state, signal] = react(state, signal)
                state = step[0]
                labels.append(step[1])
            yield b.drop(columns=["c", "signal", "start"]).assign(label=labels)

    return run


def label(rows: DataFrame, group: str, order: list[str], signal: Column, react: React, states: int, chunk: int = CHUNK) -> DataFrame:
    """(group, order..., label): the automaton's output in the given order within each group.

    ``order[0]`` is a position that counts up from 0; the order must be total. State 0 is the start.
    """
    place = [F.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    keys = [f"o{i}" for i in range(len(order))]
    base = rows.select(F.col(group).cast("long").alias("g"), F.floor(F.col(order[0]) / chunk).alias("c"), *place, signal.alias("signal"))
    long = base.filter("c > 0").select("g").distinct()
    ready = base.withColumn("start", F.lit(0))
    if not long.isEmpty():  # only decisions of several chunks need their chunks' maps
        several = base.join(long, "g", "left_semi").repartition("g", "c").sortWithinPartitions("g", "c", *keys)
        maps = several.mapInPandas(_end_states(react, states), "g long, c long, ends array<int>")
        before = F.collect_list("ends").over(Window.partitionBy("g").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
        starts = maps.select("g", "c", F.aggregate(before, F.lit(0), lambda s, ends: F.get(ends, s)).alias("from"))
        ready = base.join(starts, ["g", "c"], "left").withColumn("start", F.coalesce("from", F.lit(0))).drop("from")
    ready = ready.repartition("g", "c").sortWithinPartitions("g", "c", *keys)
    schema = T.StructType([ready.schema["g"], *[ready.schema[k] for k in keys], T.StructField("label", T.StringType())])
    labelled = ready.select("g", "c", *keys, "signal", "start").mapInPandas(_labels(react), schema)
    return labelled.select(F.col("g").alias(group), *[F.col(k).alias(o) for k, o in zip(keys, order)], "label")


def law_sections(rows: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """(group, order..., label): sections of the law part; blank paragraphs are left out."""
    kept = rows.withColumn("__t", X.strip(F.col(text))).filter("__t <> ''")
    return label(kept, group, order, law_signals(F.col("__t")), law_reaction, len(LAW_STATES))


def facts_sections(rows: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """(group, order..., label): background and proceedings. Headings decide where a decision has any, else repeated words of proceedings."""
    kept = rows.withColumn("__t", X.strip(F.col(text))).filter("__t <> ''").select(group, *order, facts_signal(F.col("__t")).alias("__s"))
    kept = materialize(kept, "facts-signals")  # read twice; the texts are looked at once
    headed = kept.filter(F.col("__s").isin(TO_BACKGROUND, TO_PROCEEDINGS)).select(F.col(group).alias("__g")).distinct().withColumn("__h", F.lit(True))
    kept = kept.join(headed, F.col(group) == F.col("__g"), "left")
    signal = F.when(F.col("__h") & (F.col("__s") == BUSY), QUIET).otherwise(F.col("__s"))
    return label(kept, group, order, signal, facts_reaction, len(FACTS))


#: Parts of a raw decision in the order in which they are joined, with their section; facts and law are labelled by automata.
PARTS = [("introduction", "introduction"), ("legal_context", "introduction"), ("facts", None), ("relevant_legal_framework_practice", "legal_framework"), ("law", None), ("reasons_the_court_unanimously", "operative_part"), ("separate_opinions", "separate_opinion")]
RAW_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("case_id", "case_no", "title", "judgment_date", "article_no")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("defendants", "court", "originating_body", "chamber_composed_of", "document_type", "organisation", *[p for p, _ in PARTS], "violation", "non-violation")]
    + [T.StructField("court_assessment_references", T.StructType([T.StructField("case_references", T.ArrayType(T.StringType()))]))]
)


def structure_cases(raw: DataFrame, order: str = "case_ord") -> DataFrame:
    """(case_ord, para_idx, section, text) of raw decisions: header lines, parts in order, outcomes as operative part."""

    def rows(values: Column, rank: int, section: str | None) -> DataFrame:
        clean = F.filter(F.transform(values, lambda x: X.strip(x)), lambda x: x != "")
        return raw.select(order, F.lit(rank).alias("rank"), F.posexplode(clean).alias("pos", "text")).withColumn("section", F.lit(section))

    def prefixed(name: str, prefix: str) -> Column:
        return F.transform(F.filter(F.col(f"`{name}`"), lambda x: X.strip(x) != ""), lambda x: F.concat(F.lit(prefix), X.strip(x)))

    heads = [("chamber_composed_of", "Composed of: "), ("originating_body", "Originating body: "), ("document_type", "Document type: ")]
    header = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.concat(F.lit(p), F.array_join(n, ", "))) for n, p in heads]))
    out = rows(header, 0, "header")
    for i, (part, section) in enumerate(PARTS, 1):
        made = rows(F.col(part), i, section)
        if section is None:
            labels = (facts_sections if part == "facts" else law_sections)(made, order, ["pos"], "text")
            made = made.drop("section").join(labels.withColumnRenamed("label", "section"), [order, "pos"]).select(order, "rank", "pos", "text", "section")
        out = out.unionByName(made)
    out = out.unionByName(rows(prefixed("violation", "Violation: "), len(PARTS) + 1, "operative_part")).unionByName(rows(prefixed("non-violation", "No violation: "), len(PARTS) + 2, "operative_part"))
    # numbers: positions within a part plus the sizes of the parts before, so that no window holds a whole decision
    sizes = out.groupBy(order, "rank").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(order).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.join(sizes.select(order, "rank", before.alias("before")), [order, "rank"]).select(order, (F.col("before") + F.col("pos")).cast("int").alias("para_idx"), "section", "text")
