"""The search language."""

from assize.plans.query import parse, parse_text


def test_words_and_phrases():
    q = parse_text('right "private  life" Court')
    assert q.every == ("right", "court", "private  life") and q.groups == ()


def test_or_makes_one_group_of_phrases():
    q = parse_text("a b OR c d or e")
    assert q.groups == (("a b", "c d", "e"),) and q.every == ()


def test_quoted_first_part_is_no_alternative():
    q = parse_text('"x y" OR z')
    assert q.every == ("or", "z", "x y") and q.groups == ()


def test_blank():
    assert parse_text("").blank and parse_text('""').blank and parse(None).text.blank


def test_prefixes():
    q = parse('Article:"8 - 1" state:TÜR court judge:"Anna  B" case:')
    assert q.meta == {"article": ("8-1",), "state": ("tur",), "judge": ("anna b",)}
    assert q.text.every == ("court", "case:")
