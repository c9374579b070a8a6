"""Garbled text where a large part of a language is garbled."""

import pytest

from assize.llm import mojibake
from tests.llm.test_leak_mix_mojibake import CLEAN, TRAPS

#: Text, encoding, and the encoding it was read in.
CASES = [(2, "cp1250", "cp1252"), (2, "iso8859-2", "cp1252"), (3, "cp1254", "cp1252"), (0, "cp1251", "cp1252"), (0, "koi8-r", "cp1251"), (0, "cp866", "cp1251"), (1, "cp1252", "cp1251")]


def rows(clean, garbled):
    """Each text as often as given clean and misread; the ids of the misread ones, and what they are to become."""
    out = [t for t in TRAPS]
    wanted = {}
    for at, a, b in CASES:
        # words of its own, so that every case has its own frequencies
        mark = "xyzwvut" if at else "абвгдежзи"
        text = " ".join(w.strip(".,") + mark[CASES.index((at, a, b))] for w in CLEAN[at].split())
        out += [text] * clean
        for _ in range(garbled):
            wanted[len(out)] = text
            out.append("".join(mojibake._read(text.encode(a), b)))
    return out, wanted


@pytest.mark.parametrize("clean, garbled", [(12, 6), (1, 1)])
def test_large_part_garbled(spark, clean, garbled):
    texts, wanted = rows(clean, garbled)
    op = mojibake.Mojibake(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in op.found().collect()} == set(wanted)
    made = {r.doc_id: r.text for r in op.restored().collect()}
    assert [i for i in wanted if made[i] != wanted[i]] == []


def misread(text, reader, times=1):
    for _ in range(times):
        text = mojibake._read(text.encode(), reader)
    return text


def test_many_layers_and_single_words(spark):
    texts = [t for t in CLEAN for _ in range(3)] + TRAPS
    first = len(texts)
    name = "signed by Jórvorsen and née Ëlwyn"
    texts += [misread(name, "cp1252", 5), misread(name, "latin-1", 6), "Le requйrant said", "the cоurt and the mark¹ of 5ª", "lost � here", "signed by JÃ³rvor–’ today"]
    op = mojibake.Mojibake(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in op.found().collect()} == {first + i for i in (0, 1, 2, 4, 5)}
    made = {r.doc_id - first: r.text for r in op.restored().collect()}
    assert made[0] == made[1] == name and made[2] == "Le requérant said" and made[4] == "lost � here"


@pytest.mark.parametrize("words, characters", [(False, True), (True, False), (False, False)])
def test_rows_come_from_generated_forms(spark, monkeypatch, words, characters):
    """Without the garbled forms of words, or of proposed originals, what they explain is not found."""
    make, propose = mojibake.FormMaker.__init__, mojibake.Originals.__init__

    def no_forms(self, *a):
        make(self, *a)
        self.names = self.names if words else []

    def no_proposals(self, *a):
        propose(self, *a)
        self.starts = self.starts if characters else {}

    monkeypatch.setattr(mojibake.FormMaker, "__init__", no_forms)
    monkeypatch.setattr(mojibake.Originals, "__init__", no_proposals)
    texts = [t for t in CLEAN for _ in range(3)]
    first = len(texts)
    texts += [CLEAN[0].encode("cp1251").decode("cp1252"), misread("signed by Jórvorsen", "cp1252"), misread(CLEAN[1], "cp1252")]
    op = mojibake.Mojibake(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id - first for r in op.found().collect()} == ({0, 2} if words else set()) | ({1, 2} if characters else set())
