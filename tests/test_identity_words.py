"""Rules that compare the findings of one document."""

import io
from contextlib import redirect_stdout

from cloakwork.operators import identity as I

SCHEMA = "doc long, start int, end int, value string, rule string"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "organization") for r in rows], SCHEMA)


def test_linked_single_words_without_joins(spark):
    full = _rows(spark, [(1, 0, 16, "Blue Lantern Ltd"), (1, 38, 49, "The Red Oak Inc"), (1, 51, 62, "Red Elm Inc"), (2, 5, 9, "Ltd Inc")])
    single = _rows(spark, [
        (1, 0, 4, "Blue"), (1, 23, 27, "Blue"), (1, 23, 27, "blue"), (1, 32, 36, "BLUE."), (1, 64, 67, "Red"), (1, 71, 74, "Red"),
        (1, 80, 84, "Elm"), (2, 0, 4, "Blue"), (2, 11, 15, "Blue"), (None, 0, 4, "Blue")])
    out = I.linked_single_words(single, full, ["doc"])
    shown = io.StringIO()
    with redirect_stdout(shown):
        out.explain()
    # words and full names are dealt once and meet in windows, never in pairs
    plan = shown.getvalue()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 23, 27, "blue"), (1, 32, 36, "blue")]


def test_designator_organizations_in_one_arrow_pass(spark):
    texts = ["Paid by Blue Star Holdings Ltd, on time", "Ltd", "the notice by Silver Oak Capital", "A B C D E F G H I Ltd", "x²Ltd Élan Bank’ (Red) Group",
             "lower case group", "of the ǅa Trust", "ⅧLtd Inc", "O'Neil-Smith of Acme LLP.\nInc", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    out = I.designator_organizations(docs, ["doc"])
    shown = io.StringIO()
    with redirect_stdout(shown):
        out.explain()
    assert "ArrowEvalPython" in shown.getvalue() and "lambda" not in shown.getvalue()
    got = {(r.doc, texts[r.doc][r.start:r.end]) for r in out.collect()}
    assert got == {(0, "Blue Star Holdings"), (0, "Blue Star Holdings Ltd"), (2, "Silver Oak Capital"), (3, "C D E F G H I Ltd"),
                   (4, "Élan Bank’"), (7, "Ltd Inc"), (8, "Acme LLP.")}
