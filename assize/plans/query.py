"""The search language: text to a small tree on the driver, the tree to column predicates.

Double quotes hold a phrase. What is left is parted at OR: several parts are the alternatives of one group, a single part is words
that must all occur. Phrases must occur in any case. ``prefix:value`` and ``prefix:"several words"`` address metadata.
Terms match as parts of words, without case but with their accents; metadata is folded.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assize.functions.constants import PREFIXES

_PREFIXED = re.compile(rf'\b({"|".join(PREFIXES)}):(?:"([^"]*)"|(\S+))', re.IGNORECASE)
_PHRASE = re.compile(r'"([^"]*)"')
_OR = re.compile(r"\s+OR\s+", re.IGNORECASE)


@dataclass(frozen=True)
class TextQuery:
    """All of ``every``, and of each group at least one."""

    every: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()

    @property
    def blank(self) -> bool:
        return not self.every and not self.groups

    @property
    def terms(self) -> list[str]:
        return [*self.every, *(t for g in self.groups for t in g)]

    def predicate(self, text_lower: Column) -> Column:
        """A blank query matches everything."""
        parts = [text_lower.contains(t) for t in self.every]
        parts += [reduce(lambda a, b: a | b, [text_lower.contains(t) for t in g]) for g in self.groups]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class Query:
    text: TextQuery
    meta: dict[str, tuple[str, ...]] = field(default_factory=dict)


def parse_text(query: str) -> TextQuery:
    phrases = [p.strip().lower() for p in _PHRASE.findall(query or "")]
    # a quote parts words; an OR next to it has no white space before it and is a word like any other
    rest = _PHRASE.sub(" ", query or "").strip()
    parts = [p.strip().lower() for p in _OR.split(rest) if p.strip()]
    every = tuple(p for p in phrases if p)
    if len(parts) > 1:
        return TextQuery(every, (tuple(parts),))
    return TextQuery((*rest.lower().split(), *every))


def fold_term(value: str) -> str:
    x = unicodedata.normalize("NFKD", value.strip().lower())
    return re.sub(r"\s+", " ", "".join(c for c in x if not unicodedata.combining(c))).strip()


def parse(query: str) -> Query:
    """Prefixed values are taken out and folded, the rest is the text query."""
    meta: dict[str, list[str]] = {}

    def take(m: re.Match) -> str:
        key, value = m[1].lower(), fold_term(m[2] if m[2] is not None else m[3])
        if key == "article":
            value = value.replace(" ", "")
        if value:
            meta.setdefault(key, []).append(value)
        return " "

    rest = _PREFIXED.sub(take, query or "")
    return Query(parse_text(rest), {k: tuple(v) for k, v in meta.items()})
