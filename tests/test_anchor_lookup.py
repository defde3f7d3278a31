"""The anchors a text holds, looked up word by word, are those of the column expression; token forms stand alone."""

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import match as M

TEXTS = ["", None, "in the red house by Lake", "xred house﻿by\x85lake", "a bb ccc dd e", "abcdefghijklmnopqrstuv wx", "ΟΔΟΣ then Then athens then_x then"]
FORMS = ["the red house by", "red house", "bb ccc dd", "cdefghijklmnopqrst", "then", "ΟΔΟΣ", "e"]


@pytest.mark.parametrize("most", [M.MOST_KEYS, 0])
@pytest.mark.parametrize("inline", [M.INLINE_FORMS, 0])
def test_ways_agree(spark, monkeypatch, most, inline):
    monkeypatch.setattr(M, "MOST_KEYS", most)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    d = M.Dictionary(spark.createDataFrame([(f,) for f in FORMS], "value string"), inline_forms=inline)
    assert (d.lookup is None) == (most == 0)
    got = {(r.i, r.value, r.start) for r in d.occurrences(docs, ["i"], "text").collect()}
    assert got == {(2, "the red house by", 3), (2, "red house", 7), (3, "red house", 1), (4, "bb ccc dd", 2), (5, "cdefghijklmnopqrst", 2),
                   (6, "ΟΔΟΣ", 0), (6, "then", 5), (6, "then", 10), (6, "then", 16), (6, "then", 22), (6, "then", 29),
                   *{(i, "e", at) for i, t in enumerate(TEXTS) if t for at, c in enumerate(t.lower()) if c == "e"}}


def test_a_token_form_costs_no_span_inside_longer_words(spark):
    forms = spark.createDataFrame([("then", "token"), ("a-b", "token")], "value string, boundary string")
    docs = spark.createDataFrame([(0, "then athens Then, then_x éthen THEN a-b a-bc xa-b"), (1, "thena " * 20_000 + "then")], "i int, text string")
    got = {(r.i, r.surface, r.start) for r in M.Dictionary(forms).occurrences(docs, ["i"], "text").collect()}
    assert got == {(0, "then", 0), (0, "Then", 12), (0, "THEN", 31), (0, "a-b", 36), (1, "then", 120_000)}
