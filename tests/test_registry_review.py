"""Review of names: the same by names as by values, and no value travels for it."""

import io
from contextlib import redirect_stdout

from cloakwork.operators import registry as R


def test_review_by_names_equals_review_by_values(spark):
    pairs = [("PWD", "/work/dir"), ("PWD", "./x"), ("URL", "https://a.test/x"), ("KEY", "ghp_" + "a1B2" * 9), ("MODE", "debug"),
             ("MODE", "Zz9-" * 8), ("TOKEN", "short"), ("X", "off"), ("Y", "https://u:p@h/")]
    values = spark.createDataFrame(
        [(7 * i % 27, n, s, v) for i, (n, v, s) in enumerate((n, v, s) for n, v in pairs for s in ("b", "a", "c"))],
        "id long, name string, source string, value string")
    rules = spark.createDataFrame(
        [("X", "r1", "other", True, 2), ("X", "r0", R.USER_PLUGIN, True, 1), ("Y", "r1", "other", True, 1), ("KEY", "r2", "other", False, 0)],
        "name string, rule_id string, plugin string, trusted boolean, rank int")
    names = spark.createDataFrame([("GONE", True), ("GONE", True), ("PWD", True), ("b-d", False)], "name string, valid boolean")
    by_value = R.review_candidates(*R.apply_policy(values, rules, ["id"]), names, ["id"])
    by_name = R.review_values(values, rules, names, ["id"])
    rows = sorted(map(str, by_value.collect()))
    assert rows == sorted(map(str, by_name.select(by_value.columns).collect())) and len(rows) == 8
    out = R.next_exclude_names(by_name, by_name.filter("selected"), names)
    shown = io.StringIO()
    with redirect_stdout(shown):
        out.explain()
    assert "LeftAnti" not in shown.getvalue() and "LeftSemi" not in shown.getvalue()
    on = {r.name for r in by_value.filter("selected").collect()}
    shut = {r.name for r in by_value.filter("state <> 'plugin-excluded'").collect()}
    assert sorted(r.name for r in out.collect()) == sorted(({"GONE", "PWD", "b-d"} - (shut & on)) | (shut - on))
