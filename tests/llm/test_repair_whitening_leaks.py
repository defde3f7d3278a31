"""Conversation repair, whitening and benchmark passages against brute force, with every odd case."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, turn_repair, whitening

SPACE = "\t\n\v\f\r "


# ----------------------------------------------------------------------------- conversation repair
def cheapest(rows):
    """Dijkstra over (row, role state) with (cost, audit) as the order: rows are (initial, must go, truncated)."""
    heap, done = [((0, ""), 0, 0)], set()
    while heap:
        (cost, audit), i, s = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return cost, audit
        if (i, s, audit) in done:
            continue
        done.add((i, s, audit))
        if len(audit) > 3 * len(rows) + 3:
            continue
        nxt = 3 if s == 2 else 2
        heapq.heappush(heap, ((cost + 3, audit + "I"), i, nxt))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, ((cost + 4, audit + "D"), i + 1, s))
            if not gone:
                more = 3 if cut else 0
                heapq.heappush(heap, ((cost + 3 + more, audit + "R"), i + 1, nxt))
                if initial == "s" and s == 0:
                    heapq.heappush(heap, ((cost + more, audit + "K"), i + 1, 1))
                if initial == ("a" if s == 2 else "u"):
                    heapq.heappush(heap, ((cost + more, audit + "K"), i + 1, nxt))


def repaired(table):
    """The contract row by row, in plain Python."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        kept = convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, rows, count = set(), [], Counter()
        for _, role, text in kept:
            core = text.rstrip(SPACE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = cheapest(rows)
        lines, source, state = [], iter(kept), 0
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(source)
            if letter == "D":
                continue
            state = 1 if letter == "K" and role[:1] == "s" else 3 if state == 2 else 2
            lines.append(f"{role if letter == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, conv string, copies string, gone string, digest string, part string, audit string"


def conversations():
    rnd = random.Random(5)
    say = ["Yes.", "No!", "so", "Well?  ", " \t", "", None, "é.", "Good\nday.", "a: b."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "unicorn"]
    table = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 9)):
            at = None if rnd.random() < 0.08 else turn * rnd.choice((1, 1, 2))
            table.append((conv, at, rnd.choice(roles[:4] if rnd.random() < 0.7 else roles), rnd.choice(say) if rnd.random() < 0.6 else f"Line {rnd.random()}."))
    table += [table[3], table[3], table[10]]
    return [(*r, *["clash"] * 6) for r in table]


def test_turn_repair_equals_the_plain_rule(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, CONV)
    want = repaired([r[:4] for r in rows])
    for block in (1, 2, 3, turn_repair.BLOCK):
        got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damaged(table), block).collect()}
        assert got == want
    assert turn_repair.repair(turn_repair.damaged(table.limit(0))).count() == 0


def test_turn_repair_writes_the_turns_it_hashes(spark):
    table = spark.createDataFrame(conversations(), CONV)
    rows = turn_repair.damaged(table)
    turns = turn_repair.repaired_turns(rows)
    lines = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: r["position"]):
        lines[r["conv"]].append((r["role"], r["text"]))
    for r in turn_repair.repair(rows).collect():
        own = lines[r["conv"]]
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in own))
    again = turns.select(F.col("conv").alias("conv_id"), F.col("position").alias("turn"), "role", "text").filter("text <> ''")
    assert turn_repair.audits(turn_repair.as_rows(again)).filter("gaps < 0").count() == 0


def test_a_long_conversation_is_cut_into_pieces_without_a_change(spark):
    rnd = random.Random(1)
    rows = [(1, i, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b", f"t{i}.", f"u{i}"])) for i in range(3000)]
    table = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    small, large = (turn_repair.repair(table, block).collect() for block in (100, 4000))
    assert small == large


def test_piece_weights_compose():
    rnd = random.Random(3)
    for _ in range(200):
        rows = [(rnd.choice("suat"), rnd.random() < 0.25, rnd.random() < 0.3) for _ in range(rnd.randint(0, 7))]
        k = rnd.randint(0, len(rows))
        best = turn_repair.FINAL
        for piece in (rows[k:], rows[:k]):
            best = turn_repair.in_front(turn_repair.piece_weights(piece), best) if piece else best
        assert best[0] == cheapest([(i, g, c and not g) for i, g, c in rows]) or any(g and c for _, g, c in rows)


# ----------------------------------------------------------------------------- whitening
VECS = "vec_id long, embedding array<float>, x string, v string, component string, n string"


def vectors(n=300, d=20):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((n, d)) @ np.diag(np.linspace(3, 0.2, d))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (3, rows[7][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, [None] * d), (2002, [float("nan")] * d), (2003, [float("inf")] * d), (2004, []), (2005, [1.0] * (d + 1)), (2006, [1e30] * d)]
    return [(*r, *["clash"] * 4) for r in rows]


def plain(rows, d=20, k=16):
    kept = [r for r in rows if r[1] and len(r[1]) == d and all(c is not None and np.isfinite(c) and abs(c) < 1e20 for c in r[1])]
    x = np.floor(64 * np.array([r[1] for r in kept], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return kept, n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes / np.sqrt(values), values / np.trace(z.T @ z / n)


def test_whitening_equals_a_plain_decomposition(spark):
    rows = vectors()
    got = whitening.whiten(spark.createDataFrame(rows, VECS)).collect()
    kept, n, deviation, white, explained = plain(rows)
    assert Counter(r["vec_id"] for r in got) == Counter({i: 16 * c for i, c in Counter(r[0] for r in kept).items()})
    assert {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got) and len({r["identity_error"] for r in got}) == 1
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(16):
        column = np.array([by[r[0], j + 1]["whitened"] for r in kept[:300] if r[0] != 3])
        ref = white[[i for i in range(300) if kept[i][0] != 3], j]
        assert min(np.abs(column - ref).max(), np.abs(column + ref).max()) < 1e-8
        assert abs(by[0, j + 1]["explained"] / explained[j] - 1) < 1e-9
    assert all(by[kept[i][0], 1]["deviation"] == deviation[i] for i in range(300) if kept[i][0] != 3)


def test_whitening_of_little_or_nothing(spark):
    table = spark.createDataFrame(vectors(), VECS)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.filter("vec_id in (2000, 2002)")).count() == 0
    assert whitening.whiten(table.filter("vec_id = 5")).count() == 0            # one vector has no direction with variance
    assert {r["component"] for r in whitening.whiten(table.filter("vec_id in (5, 6, 8)")).collect()} == {1, 2}


@pytest.mark.parametrize("spectrum", ["spread", "equal", "close", "few"])
def test_spectrum_slicing(spectrum):
    rng = np.random.default_rng(4)
    d = 40
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"spread": np.geomspace(1e-6, 1e3, d), "equal": np.repeat([5.0, 2.0], d // 2), "close": 7 + np.arange(d) * 1e-10, "few": np.r_[np.ones(3), np.zeros(d - 3)]}[spectrum]
    a = q @ np.diag(e) @ q.T
    s = whitening.Slicer(a)
    pairs = s.leading(16, s.tiny * 16)
    assert len(pairs) == min(16, int((e > 1e-9).sum()))
    assert np.allclose([v for v, _ in pairs], np.sort(e)[::-1][:len(pairs)], atol=1e-10)
    axes = np.array([v for _, v in pairs])
    assert np.abs(axes @ axes.T - np.eye(len(pairs))).max() < 1e-12
    assert whitening.inertia(a - 3 * np.eye(d)) == int((e < 3).sum())


def test_deviation_is_exact_or_null():
    far = whitening.Centre(3, [3 * 10**6 + 1, 5])
    x = np.array([[10**6, 2], [2**40, -(2**40)], [2**61, 0]])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, (3 * 10**6 + 1, 5))) for row in x]
    assert far.deviation(x) == [w if w < 2**63 else None for w in want] and far.deviation(x[:1]) == want[:1]


# ----------------------------------------------------------------------------- benchmark passages
DOCS = "doc_id long, text string, n_words string, spans string, items string, pattern string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(t):
    return WORD.findall((t or "").translate(LOWER))


def leak_tables():
    rnd = random.Random(8)
    pool = [f"{a}{b}" for a in ("Ba", "ke", "Éli", "no9", "ŭr") for b in ("n", "st", "R", "d", "ZO", "")]
    say = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((40, 25, 10, 11, 9, 3, 1))]
    items += [(7, None), (8, " ?! "), (None, say(12)), (1, say(14)), (20, items[2][1]), (21, items[0][1][:60])]
    texts = [None, "", " - ", "x", items[5][1], items[4][1] + ".", say(30)]
    texts += [say(8) + "… " + items[k][1].upper().replace(" ", rnd.choice([" ", "-", ",\n", "\x00"])) + "! " + say(5) for k in (0, 1, 2, 3, 9, 10)]
    texts += [" ".join(items[0][1].split()[3:22]) + " " + " ".join(items[1][1].split()[2:9]), say(3000) + " " + items[1][1] + " " + say(3000), "z" * 4000]
    docs = [(i, t) for i, t in enumerate(texts)]
    return [(*r, *["clash"] * 4) for r in [*docs, docs[8], (None, texts[9])]], items


def contaminated(docs, items):
    grams = defaultdict(set)
    for item, text in items:
        w = normal(text)
        for p in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[p:p + 10])].add("" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w, hit, found = normal(text), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if tuple(w[p:p + k]) in grams:
                    hit |= set(range(p, p + k))
                    found |= grams[tuple(w[p:p + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("pattern_bytes", [decontaminate.PATTERN_BYTES, 900])
def test_leaks_equal_brute_force(spark, pattern_bytes):
    docs, items = leak_tables()
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.verdicts(table, bench, pattern_bytes=pattern_bytes)
    assert Counter(tuple(r)[:6] for r in out.collect()) == contaminated(docs, items)
    for r in decontaminate.leaks(table, bench, pattern_bytes=pattern_bytes).collect():
        w = normal(r["text"])
        for s in r["spans"]:
            assert normal(r["text"][s["start"]:s["end"]]) == w[s["first_word"]:s["first_word"] + s["words"]]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_leaks_of_empty_tables(spark):
    docs, items = leak_tables()
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.verdicts(table.limit(0), bench).count() == 0
    clean = decontaminate.verdicts(table, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)
    assert Counter(r["n_words"] for r in clean) == Counter(len(normal(t)) for _, t, *_ in docs)


def test_cut_texts_hold_no_window(spark):
    docs, items = leak_tables()
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items[:4], "item_id long, text string")
    cut = decontaminate.without_leaks(table, bench)
    assert decontaminate.verdicts(cut, bench).filter("contaminated").count() == 0
    assert {r["text"] for r in cut.filter("doc_id = 6").collect()} == {docs[6][1]}
