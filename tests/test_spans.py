"""Span operators against plain-Python rules on seeded random inputs."""

import random

from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.operators import spans as SP

AUTH, CONF = SP.AUTHORITY, SP.CONFIDENCE


def resolve_plain(text, claims):
    """Reference rule: per character the best claim owns it; runs of one owner are segments."""
    def key(c):
        return (-AUTH[c[2]], -CONF[c[3]], c[0] - c[1], c[0], c[4])
    owner = {}
    for c in sorted(set(claims), key=key):
        for p in range(c[0], c[1]):
            owner.setdefault(p, c)
    out, p = set(), 0
    while p < len(text):
        c = owner.get(p)
        q = p
        while q < len(text) and owner.get(q) == c:
            q += 1
        if c:
            s, e = p, q
            if (s, e) != (c[0], c[1]):
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
            if s < e:
                out.add((s, e, c[4], (p, q) != (c[0], c[1])))
        p = q
    return out


def random_claims(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("abc  ") for _ in range(60))
    claims = []
    for i in range(rnd.randint(1, 14)):
        s = rnd.randint(0, 55)
        e = min(60, s + rnd.randint(1, 15))
        claims.append((s, e, rnd.choice(["registry", "detected"]), rnd.choice(list(CONF)), f"e{i % 5}"))
    return text, claims


def test_resolvers_agree_with_plain_rule(spark):
    cases = {i: random_claims(i) for i in range(120)}
    rows = [(i, s, e, t[s:e], a, c, ent) for i, (t, cl) in cases.items() for s, e, a, c, ent in cl]
    df = spark.createDataFrame(rows, "doc int, start int, end int, value string, authority string, confidence string, entity_id string")
    want = {(i, *x) for i, (t, cl) in cases.items() for x in resolve_plain(t, cl)}
    by_rows = {(r.doc, r.start, r.end, r.entity_id, r.clipped) for r in SP.resolve_rows(df, ["doc"]).collect()}
    assert by_rows == want
    full = df
    for name, default in SP.CLAIM_DEFAULTS.items():
        if name not in full.columns:
            full = full.withColumn(name, F.lit(default))
    claim = F.struct(SP.priority(F.col("start"), F.col("end"), F.col("value"), F.col).alias("pri"), "start", "end", "value",
                     F.struct("entity_id").alias("info"))
    arr = full.groupBy("doc").agg(F.collect_list(claim).alias("c")).select("doc", F.explode(SP.resolve_array(F.col("c"))).alias("r"))
    assert {(r.doc, r.r.start, r.r.end, r.r.info.entity_id, r.r.clipped) for r in arr.collect()} == want


def test_scan_offsets_with_wide_characters_and_many_matches(spark):
    texts = ["x😀 a@b.cc \u0001 c@d.ee", "a@b.cc " * 900, "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", "text", SP.scan(SP.mark_safe(F.col("text")), fixed.EMAIL).alias("s")).collect()
    assert [len(r.s) for r in got] == [2, 900, 0]
    for r in got:
        assert all(r.text[x.start:x.end] == x.value for x in r.s)


def test_splice_both_ways(spark):
    texts = ["1 a 22 b 😀3", " ".join(str(i) for i in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    s = SP.scan(F.col("text"), "([0-9]+)")
    out = df.select("text", s.alias("s")).select(SP.splice(F.col("text"), F.col("s"), lambda x: F.concat(F.lit("<"), x.value, F.lit(">"))).alias("o"))
    import re
    assert [r.o for r in out.collect()] == [re.sub("([0-9]+)", r"<\1>", t) for t in texts]


def test_longest_first_drops_whole(spark):
    spans = [(0, 5, "abcde"), (4, 12, "efghijkl"), (12, 14, "mn"), (0, 2, "ab")]
    df = spark.createDataFrame([([(s, e, v, v) for s, e, v in spans],)], "s array<struct<start:int,end:int,value:string,pattern_value:string>>")
    got = df.select(SP.longest_first(F.col("s")).alias("o")).first().o
    assert [(x.start, x.end) for x in got] == [(0, 2), (4, 12), (12, 14)]


def test_overlap_join_pairs_once(spark):
    rnd = random.Random(3)
    a = [(rnd.randint(0, 2), i, s, s + rnd.randint(1, 300)) for i in range(80) for s in [rnd.randint(0, 900)]]
    b = [(rnd.randint(0, 2), i, s, s + rnd.randint(1, 300)) for i in range(80) for s in [rnd.randint(0, 900)]]
    da = spark.createDataFrame(a, "k int, a int, start int, end int")
    db = spark.createDataFrame(b, "k int, b int, start int, end int")
    got = sorted((r.a, r.b) for r in SP.span_overlap_join(da, db, ["k"]).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def island(n):
    """One island of n claims: long ones of low rank over short ones of every rank."""
    rnd = random.Random(n)
    text = "".join(rnd.choice("abc  ") for _ in range(3 * n))
    claims = []
    for i in range(n):
        s = rnd.randint(0, 3 * n - 2)
        e = min(3 * n, s + (rnd.randint(2, 12) if i % 10 else rnd.randint(n // 2, n)))
        claims.append((s, e, rnd.choice(["registry", "detected"]) if i % 10 else "detected", rnd.choice(list(CONF)), f"e{i % 5}"))
    return text, claims


def test_large_islands_are_resolved_without_pairs(spark):
    import time

    text, claims = island(1500)
    schema = "doc int, start int, end int, value string, authority string, confidence string, entity_id string"
    table = lambda t, cl: spark.createDataFrame([(1, s, e, t[s:e], a, c, ent) for s, e, a, c, ent in cl], schema)
    want = resolve_plain(text, claims)
    assert {(r.start, r.end, r.entity_id, r.clipped) for r in SP.resolve_rows(table(text, claims), ["doc"]).collect()} == want
    full = table(text, claims)
    for name, default in SP.CLAIM_DEFAULTS.items():
        if name not in full.columns:
            full = full.withColumn(name, F.lit(default))
    claim = F.struct(SP.priority(F.col("start"), F.col("end"), F.col("value"), F.col).alias("pri"), "start", "end", "value", F.struct("entity_id").alias("info"))
    rows = full.groupBy("doc").agg(F.collect_list(claim).alias("c")).select(F.explode(SP.resolve_array(F.col("c"))).alias("r")).select("r.*").collect()
    assert {(r.start, r.end, r["info"]["entity_id"], r.clipped) for r in rows} == want
    text, claims = island(20000)
    start = time.perf_counter()
    got = SP.resolve_rows(table(text, claims), ["doc"]).collect()
    assert time.perf_counter() - start < 90
    assert {(r.start, r.end, r.entity_id, r.clipped) for r in got} == resolve_plain(text, claims)


def test_dyadic_cover_is_the_interval(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 21)] + [(0, 1 << 20), (5, 99999)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for r in df.select("a", "b", SP.dyadic_cover(F.col("a"), F.col("b")).alias("d")).collect():
        runs = sorted((d["node"] << d["level"], (d["node"] + 1) << d["level"]) for d in r["d"])
        assert runs[0][0] == r["a"] and runs[-1][1] == r["b"] and all(x[1] == y[0] for x, y in zip(runs, runs[1:]))
        assert len(runs) <= 2 * max(1, (r["b"]).bit_length())
