"""Dictionary match against brute force, on both physical ways."""

import random
import re

from pyspark.sql import functions as F

from cloakwork.operators import match as M

GAP = r"(?:[^\S\r\n]+|[^\S\r\n]*(?:\r\n|\r|\n)[^\S\r\n]*)"


def brute(texts, forms):
    out = set()
    for i, t in texts:
        for v in forms:
            loose = not re.search(r"\d", v) and len(re.findall("[A-Za-z]", v)) >= 2
            p = GAP.join(re.escape(w) for w in re.split(r"\s+", v))
            for m in re.finditer(p, t, re.I if loose else 0):
                out.add((i, v, m.start(), m.end()))
    return out


def test_inline_and_join_equal_brute_force(spark):
    rnd = random.Random(11)
    words = ["acme", "Corp", "of", "x", "blue", "Lantern", "Z9", "a-b", "日本", "naïve", "Jo", "Li", "q"]
    gaps = [" ", "  ", "\n", " \n ", "\n\n", "\t", "", "-"]
    texts = [(i, "".join(rnd.choice([w, w.upper(), w.lower()]) + rnd.choice(gaps) for w in rnd.choices(words, k=40))) for i in range(60)]
    forms = {" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(60)} | {"q", "Li", "日本", "a-b"}
    docs = spark.createDataFrame(texts, "id int, text string")
    reg = spark.createDataFrame([(v,) for v in sorted(forms)], "value string")
    want = brute(texts, forms)
    assert len(want) > 100
    for limit in (4000, 0):
        d = M.Dictionary(reg, inline_forms=limit)
        assert d.inline == (limit > 0)
        got = {(r.id, r.value, r.start, r.end) for r in d.occurrences(docs, ["id"], "text").collect()}
        assert got == want


def test_token_forms_and_detected_guard(spark):
    docs = spark.createDataFrame([(1, "Blue blues Blue. blue ÜBlue")], "id int, text string")
    token = spark.createDataFrame([("Blue", "token", "registry"), ("Mark", "substring", "detected")], "value string, boundary string, authority string")
    got = M.Dictionary(token).occurrences(docs, ["id"], "text").orderBy("start").collect()
    assert [(r.surface, r.start) for r in got] == [("Blue", 0), ("Blue", 11), ("blue", 17)]
    det = spark.createDataFrame([(1, "Mark mark MARK my mark")], "id int, text string")
    got = M.Dictionary(token).occurrences(det, ["id"], "text").orderBy("start").collect()
    assert [r.surface for r in got] == ["Mark", "MARK"]


def test_scoped_values_never_cross_scopes(spark):
    turns = spark.createDataFrame([(1, 0, "hello alphabet"), (1, 1, "alphabet again"), (2, 0, "alphabet here"), (1, 2, "none")], "s int, turn int, text string")
    known = spark.createDataFrame([(1, "alphabet", 1)], "s int, value string, first_turn int")
    got = M.match_scoped(turns, ["s", "turn"], "text", known, ["s"], ["turn"], F.col("turn") >= F.col("first_turn")).collect()
    assert [(r.s, r.turn, r.surface) for r in got] == [(1, 1, "alphabet")]


def test_linking(spark):
    orgs = spark.createDataFrame([("a", "The Acme Ltd"), ("b", "Twin One"), ("c", "Twin Two Inc")], "entity_id string, value string").selectExpr(
        "*", "'entity' as protection_kind", "'organization' as entity_type")
    m = spark.createDataFrame([("ACME", "ORGANIZATION", "high"), ("Twin", "organization", "exact"), ("Acme", "organization", "probabilistic")],
                              "value string, rule string, confidence string")
    got = {(r.value, r.linked_id, r.ambiguous) for r in M.link_entities(m, orgs).collect()}
    assert got == {("ACME", "a", False), ("Twin", None, True), ("Acme", None, False)}
