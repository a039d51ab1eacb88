"""Texts that look the same: what is and isn't one form, pairs against brute force, and hostile texts."""

from __future__ import annotations

import itertools
import random
import unicodedata

import duckdb
import pytest

from tallyweave.llm import lookalike

BASE = "Le café n° 2 costs 5-7 € at Zoë's."
SAME = [
    "Le caf\u00e9 n\u00b0\u00a02 costs 5-7\u202f\u20ac at Zo\u00eb's.",
    "Le cafe\u0301 n\u00b0 2 costs 5-7 \u20ac at Zoe\u0308's.",
    "Le caf\u00e9 n\u00b0 2 c\u200bosts 5\u2060-7 \u20ac at Zo\u00eb's\ufeff.",
    "L\u0435 caf\u00e9 n\u00b0 2 c\u043ests 5\u20117 \u20ac at Zo\u0451's.",
    "\uff2c\uff45\u3000\uff43\uff41\uff46\u00e9 n\u00b0 \uff12 costs 5\uff0d7 \u20ac at \u0396o\u00eb's\uff0e",
    "Le caf\u00ade\u0301 n\u00b0 2 \u03f2osts 5-7 \u20ac at Zo\u00eb's.",
]
OTHER = ["le café n° 2 costs 5-7 € at Zoë's.", "Le cafe n° 2 costs 5-7 € at Zoë's.", "Le café n° ² costs 5-7 € at Zoë's.", "Le café n° 2 costs 5–7 € at Zoë's.", "Le café n° 2 costs 5—7 € at Zoë's.", "Le  café n° 2 costs 5-7 € at Zoë's.", "Le café\nn° 2 costs 5-7 € at Zoë's.", "Le café nº 2 costs 5-7 € at Zoë's."]


def _form(text):
    return duckdb.execute(f"SELECT {lookalike.form_sql('t')} FROM (SELECT CAST(? AS VARCHAR) AS t)", [text]).fetchone()[0]


@pytest.mark.parametrize("text", SAME)
def test_same(text):
    assert _form(text) == _form(BASE) == BASE


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert _form(text) != _form(BASE)


def test_forms_are_stable():
    rng = random.Random(1)
    chars = [*lookalike.mapping(), "a", "\u00e9", " ", "\u0301", "\u200b", "\u8a9e", "\n", "\u00b2"]
    for _ in range(200):
        t = "".join(rng.choice(chars) for _ in range(20))
        assert _form(_form(t)) == _form(t) and unicodedata.is_normalized("NFC", _form(t))


def test_every_look_alike_is_one_letter():
    for latin, drawn in lookalike.DRAWN_LIKE.items():
        assert all(_form(c) == latin for c in drawn)
    assert len({c for d in lookalike.DRAWN_LIKE.values() for c in d}) == sum(map(len, lookalike.DRAWN_LIKE.values()))


def _pairs(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, doc_a string")
    return sorted(tuple(r) for r in lookalike.same_look(df).collect())


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = ["rent", "café", "Zoë", "5-7"]
    swap = {"e": "е", "o": "о", " ": " ", "é": "é", "-": "‑"}
    texts = []
    for k in range(120):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 2)))
        texts.append((k, "".join(swap.get(c, c) if rng.random() < 0.15 else c for c in t)))
    want = sorted((a, b) for (a, x), (b, y) in itertools.combinations(texts, 2) if x != y and _form(x) == _form(y))
    assert want and _pairs(spark, texts) == want


def test_copies_blanks_and_repeats(spark):
    texts = [(1, "a-b"), (2, "a-b"), (3, "a\u2011b"), (3, "a\u2011b"), (4, " "), (5, "\u00a0"), (6, "\u200b"), (7, ""), (8, None), (9, "c"), (10, "\n"), (11, "\u3000\n")]
    assert _pairs(spark, texts) == [(1, 3), (2, 3)]


def test_hot_group_and_long_texts(spark):
    texts = [(k, "same text") for k in range(400)] + [(1000, "same\u00a0text"), (1001, "x" * 300_000), (1002, "x" * 299_999 + "\u0445")]
    assert _pairs(spark, texts) == [(k, 1000) for k in range(400)] + [(1001, 1002)]


def test_forms_of_tables(spark, rows):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(lookalike.one_form(df), "doc_id", "form") == [(1, "a b"), (2, None), (3, "")]
    assert lookalike.one_form(df.limit(0)).count() == 0 and lookalike.same_look(df.limit(0)).count() == 0


def test_classes_agree_with_pairs(spark):
    texts = ["abc", "аbс", "abc", "ABC", None, "", "\u200b", "ａｂｃ", "x\u00a0y", "x y", "x y"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, look_id string")
    got = {r.doc_id: (r.look_id, r.text_id, r.spellings) for r in lookalike.look_classes(df).collect()}
    assert got == {0: (0, 0, 3), 1: (0, 1, 3), 2: (0, 0, 3), 7: (0, 7, 3), 3: (3, 3, 1), 8: (8, 8, 2), 9: (8, 9, 2), 10: (8, 9, 2)}
    pairs = {(a, b) for a in got for b in got if a < b and got[a][0] == got[b][0] and got[a][1] != got[b][1]}
    assert pairs == {tuple(r) for r in lookalike.same_look(df).collect()}
    assert lookalike.look_classes(df.limit(0)).count() == 0
