"""The corpus operators against brute force, on a small corpus with every odd case in it."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import ann, bpe, jaccard_join, line_dedup, mixing, quality_rules, substring_dedup, suffix_tree_lm, toxicity, url_filter
from cloakwork.llm.common import shared_folder
from cloakwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string, h long"


def corpus() -> list[tuple]:
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "no", "ru", "Éa") for b in ("n", "st", "r.", "d,", "zo")]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared, line = say(20), say(9)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "one", "a b c d", "a b c d"]
    texts += [say(rnd.randint(5, 60)) for _ in range(20)]
    texts += [say(12) + " " + shared + "\n" + say(rnd.randint(3, 30)) for _ in range(6)]
    texts += [line + "\n" + say(15) + f"\n{line[:-1]}\n" + line + "x" for _ in range(3)]
    long = say(4000)
    copy = say(60)
    texts += [long, long, copy, copy, copy + " end", "new " + copy, copy.replace("ban", "bun", 1), "x" * 5000, "\u00a0no-break\u3000 wide", "###  $$$ |"]
    rows = [(i, t, "en", rnd.choice(["b", "a", None, "c"]), 0, "clash", "clash", i) for i, t in enumerate(texts)]
    return rows + [rows[-1], rows[9]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -5")


def words(t):
    return WORD.findall(t or "")


def test_substring_dedup(docs, none, rows):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - 12):
            g = tuple(w[p:p + 13])
            first[g] = min(first.get(g, i), i)
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p:p + 13])] < i for k in range(13)}
        want[(i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, slice_rows=7).collect())
    assert got == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeat_levels_double_until_nothing_repeats(docs):
    got = {r["words"]: r["windows"] for r in substring_dedup.repeat_levels(docs, slice_rows=9).collect()}
    assert list(got) == [13 * 2**k for k in range(len(got))]
    assert max(got) <= 4000 < 2 * max(got) and got[max(got)] >= 1


def test_null_ids_are_last(spark):
    t = " ".join(map(str, range(20)))
    d = spark.createDataFrame([(None, t), (3, t)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(d).collect()} == {(None, 20), (3, 0)}


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Net/", "http://a.NET/x", "https://example.net/en/1", "http://x.example.net/de/1?q#f", "http://www.example.com/de/",
            "http://fr.org/fr/x", "http://org", "http://notnet/", "http://net", "http://a..b.org/fr/", "x://y://net/", "http://net/#a"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block")]

    def judge(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r for r, _ in rules if r and (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fit, key=len, default=None)
        return host, path, best, dict(rules)[best] if best else "allow"

    table = spark.createDataFrame(rules, "rule string, action string")
    want = sorted((i, *map(str, judge(u))) for i, u in enumerate(urls + urls[:3]))
    for most_bits in (url_filter.MOST_BITS, 1):  # the second goes by the join
        got = sorted((r["page_id"], *map(str, (r["host"], r["path"], r["rule"], r["verdict"]))) for r in url_filter.judge(pages, table, most_bits=most_bits).collect())
        assert got == want
    assert url_filter.judge(pages.limit(0), table).count() == 0


def test_cascade_is_exact_with_many_false_positives(spark):
    universe = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("cast(key as long) % 7 = 0")
    c = url_filter.cascade(listed, universe, bits_per_key=3)
    assert len(c.levels) > 2
    assert universe.filter(c.listed(F.col("key")) != (F.col("key").cast("long") % 7 == 0)).count() == 0


def test_bpe(docs, none, rows):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r[0], tuple(r[2]), bytes(r[3])) for r in bpe.round_trip(docs, ranks, tokenizers.PATTERN).collect())
    assert got == Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)
    twice = bpe.decode(bpe.encode(docs, ranks, tokenizers.PATTERN), ranks)
    assert Counter((r[0], tuple(r[2]), bytes(r[3])) for r in twice.collect()) == got
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("aaab  \néZ09<|>'s") for _ in range(rnd.randint(0, 200))) for _ in range(200)] + ["a" * 3000, "ab" * 2001]
    assert [x.tolist() for x in bpe.Encoder(ranks, tokenizers.PATTERN)(odd)] == [own.encode_ordinary(t) for t in odd]
    assert bpe.encode_whole(none, ranks, tokenizers.PATTERN).count() == 0


def grams(t):
    w = words(t)
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_join(docs, none, rows):
    sets = [(i, grams(t)) for i, t, *_ in rows]
    label, links = {i: i for i, _ in sets}, Counter()
    find = lambda x: x if label[x] == x else find(label[x])
    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets):
            if a != b and s and t and len(s & t) >= 0.8 * len(s | t):
                links[a] += 1
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    want = Counter((i, find(i), links[a]) for a, (i, _) in enumerate(sets))
    for block in (jaccard_join.BLOCK, 2):
        assert Counter(tuple(r) for r in jaccard_join.near_duplicates(docs, block=block).collect()) == want
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _, _ in want if find(i) == i})
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_tells_rows_that_share_an_id_apart(spark):
    rnd = random.Random(8)
    say = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (say() for _ in range(5))
    rows = [(5, a), (None, a + " end"), (None, b), (None, c), (None, c + " end"), (7, d), (7, e), (8, d + " end"), (9, e + " end"), (9, e)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(t).collect())
    assert got == Counter({(5, 5, 1): 1, (None, 5, 1): 1, (None, None, 0): 1, (None, None, 1): 2, (7, 7, 1): 1, (7, 7, 2): 1, (8, 7, 1): 1, (9, 7, 2): 2})
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(t).collect())
    one_c = next(x for i, x in kept if i is None and x.startswith(c))
    assert kept == Counter({(5, a): 1, (None, b): 1, (None, one_c): 1, (7, d): 1, (7, e): 1})


def test_mix_takes_rows_that_share_an_id_by_source(spark):
    rows = [(None, f"{s}{i} x y z", s) for s in "abc" for i in range(10)] + [(None, f"{s} one two", s) for s in "cab"]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(t).collect():
        want[r["source"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(t).collect():
        got[r["source"]] += len(words(r["text"]))
    assert got == +want


def test_prefix_length_keeps_the_recall():
    d = jaccard_join.prefix_length(0.8)
    assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard_join.TREES


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)]
    label = {x: x for e in edges for x in e}
    find = lambda x: x if label[x] == x else find(label[x])
    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def fill(sizes: dict, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, still, out = share * sum(sizes.values()), set(names), {}
    while still:
        total = sum(w[s] for s in still)
        over = {s for s in still if left * w[s] / total >= 2 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in still}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        still -= over
    return out


def test_mixing(docs, none, rows):
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    want = fill(sizes)
    got = mixing.mix(docs, range_rows=5).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs, range_rows=1000).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    per = Counter()
    for r in mixed.collect():
        per[r["source"]] += len(words(r["text"]))
    assert per == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:160] = x[100]  # many equal vectors
    vectors = [(i, v.astype(np.float32).tolist(), "vec") for i, v in enumerate(x)]
    odd = [(1000, None, ""), (1020, [0.0] * 16, ""), (1040, [float("nan")] * 16, ""), (1060, [None] * 16, ""), (1080, [1.0] * 3, ""), (None, vectors[0][1], ""), vectors[7]]
    t = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, u string")
    got = defaultdict(list)
    for r in ann.nearest(t).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    m = np.array([v for _, v, _ in vectors])
    hits = 0
    assert sorted(got) == list(range(0, 900, 20))
    for q, found in got.items():
        found.sort()
        s = m @ m[q]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(math.isclose(s[v], x, rel_tol=1e-9, abs_tol=1e-9) for _, v, x in found)
        assert [(v, x) for _, v, x in found] == sorted(((v, x) for _, v, x in found), key=lambda p: (-p[1], p[0]))
        s[q] = -np.inf
        hits += sum(x >= np.sort(s)[-20] - 1e-9 for _, _, x in found)
    assert hits >= 0.9 * 20 * len(got)
    few = {(r["query_id"], r["vec_id"]) for r in ann.nearest(t.filter("vec_id < 5")).collect()}
    assert few == {(0, i) for i in range(1, 5)}
    assert ann.nearest(t.limit(0)).count() == 0


def test_nearest_unequal_lengths(spark):
    """Recall against brute force with log-normal lengths, and with one vector a million times as long as the others."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 24))
    one = x.copy()
    one[601] *= 1e6
    for m in (x * rng.lognormal(0, 1.5, (1200, 1)), one):
        t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in ann.nearest(t).collect():
            got[r["query_id"]].append(r["score"])
        hits = 0
        for q, found in got.items():
            s = m @ m[q]
            s[q] = -np.inf
            last = np.sort(s)[-20]
            hits += sum(v >= last - 1e-9 * abs(last) for v in found)
        assert len(got) == 60 and hits >= 0.95 * 20 * 60


def test_quality_rules(docs, none, rows):
    def measure(t):
        w, t = words(t), t or ""
        seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(lines)

    book = quality_rules.ledger(docs)
    got = book.collect()
    assert Counter((r["doc_id"], *[r[c] for c in quality_rules.MEASUREMENTS]) for r in got) == Counter((i, *measure(t)) for i, t, *_ in rows)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["fail_bits"] == 0 for r in got)
    mask = quality_rules.mask_of("v2")
    for r in quality_rules.ablations(book, "v2").collect():
        bit = next(1 << x.bit for x in quality_rules.RULES if x.name == r["rule"])
        assert r["kept_without"] == sum(x["fail_bits"] & mask & ~bit == 0 for x in got)
    assert quality_rules.ledger(none).count() == 0


def test_suffix_tree(spark, docs, none, rows):
    tokens = {}
    for i, t, *_ in rows:
        tokens[i] = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    train = Counter(x for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in tokens[i])
    n, v = sum(train.values()), len(train)
    for r in suffix_tree_lm.score(docs, slice_rows=10, least=0.001, g_least=1).collect():
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] <= 0
    assert suffix_tree_lm.score(none).count() == 0


def test_suffix_tree_probabilities_sum_to_one(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") + rnd.choice("xy") for _ in range(30)) + " a b c d" for _ in range(60)]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    seen = Counter(x for t_ in texts for x in [*t_.split(), None])
    n, v = sum(seen.values()), len(seen)
    h, of, _ = suffix_tree_lm.symbols(__import__("pyarrow").array([" ".join(x for x in seen if x)]))
    hashes = dict(zip([*[x for x in seen if x], None], h.tolist(), strict=True))
    tree = suffix_tree_lm.Tree(suffix_tree_lm.grow(t, n, {int(np.uint64(hashes[x]).view(np.int64)): c for x, c in seen.items()}, least=0.001, g_least=1))
    assert tree.levels
    for before in (["ax"], ["a", "b"], ["cy", "a", "b"]):
        p = 0
        for x in [*seen, "unknown"]:
            s = [hashes[b] for b in before] + [hashes.get(x, 12345)]
            root = np.array([0.1] * len(before) + [(seen[x] + 1) / (n + v + 1)])
            p += tree.probabilities(np.array(s, np.uint64), np.zeros(len(s), np.int64), root)[-1]
        assert math.isclose(p, 1, rel_tol=1e-9)


def test_suffix_tree_keeps_what_is_attested_however_large_the_corpus(spark):
    phrase = [(7 * i, "zeta eta theta") for i in range(12)]
    base = lambda r: r["score"] - r["base_score"]
    for filler in (20, 1400):
        rows = phrase + [(1_000_000 + i, " ".join(["alpha beta gamma"] * 350)) for i in range(filler)]
        got = suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), slice_rows=200).filter("doc_id < 1000000").collect()
        assert len(got) == 12 and all(base(r) > 8 for r in got), filler


def brute_scores(rows, least, g_least):
    """Score of each row by plain counting of word tuples."""
    tokens = [words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for _, t, *_ in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, *_ in rows]
    counts = Counter(tuple(w[j - d:j + 1]) for w, k in zip(tokens, train, strict=True) if k for j in range(len(w)) for d in range(min(j, 3) + 1))
    n, v = sum(c for k, c in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)
    tree = {k: c for k, c in counts.items() if c >= least}
    below = {}
    for k in tree:
        if len(k) > 1:
            below.setdefault(k[:-1], []).append(k)
    kept = set()
    for context in sorted(below, key=len, reverse=True):
        of = lambda k: counts[k] if k else n
        gain = sum(2 * counts[k] * math.log(counts[k] / counts[context] / (counts[k[1:]] / of(context[1:]))) for k in below[context])
        if abs(gain) >= g_least or any(len(k) == len(context) + 1 and k[1:] == context for k in kept):
            kept.add(context)

    def p(before, x):
        out = (counts[x,] + 1) / (n + v + 1)
        for d in range(1, min(len(before), 3) + 1):
            context = tuple(before[-d:])
            if context not in kept:
                break
            kinds, held = len(below[context]), sum(counts[k] for k in below[context])
            out = (tree.get((*context, x), 0) + (counts[context] + kinds - held) * out) / (counts[context] + kinds)
        return out

    return [sum(math.log10(p(w[:j], x)) for j, x in enumerate(w)) for w in tokens]


def test_suffix_tree_scores_as_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    names = [f"w{i}" for i in range(60)]
    rows = [(None if i % 50 == 3 else i, None if i == 7 else " ".join(rnd.choice(names[:1 + rnd.randrange(60)]) for _ in range(rnd.randrange(90)))) for i in range(160)]
    monkeypatch.setattr(suffix_tree_lm, "BUCKET_SYMBOLS", 500)  # several ranges of hashes
    want = brute_scores(rows, 2, 30)
    assert len({round(x, 6) for x in want}) > 100
    for slice_rows in (1, 13):
        got = suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), slice_rows=slice_rows).collect()
        key = lambda i, s: (-1 if i is None else i, s)
        for a, b in zip(sorted(key(r["doc_id"], r["score"]) for r in got), sorted(key(i, s) for (i, _), s in zip(rows, want, strict=True)), strict=True):
            assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9)


def test_suffix_tree_writes_no_row_for_a_single_pair(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{int(300 * rnd.random() ** 2)}" for _ in range(400))) for i in range(500)]
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).count() == 500
    new = [x for x in folder.iterdir() if x not in before]
    assert new and sum(spark.read.parquet(str(x)).count() for x in new) < 500
    assert sum(f.stat().st_size for x in new for f in x.rglob("*.parquet")) < sum(len(t) for _, t in rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance(spark):
    rnd = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 20)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, len(b))
            b[i:i + rnd.randint(0, 1)] = rnd.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    t = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        for r in t.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect():
            assert r["w"] == (distance(r["a"], r["b"]) <= edits), (edits, r)


def test_line_dedup(docs, none, rows):
    unique = {i: t for i, t, *_ in rows if t is not None and sum(r[0] == i for r in rows) == 1}
    order = sorted(unique)
    seen, want = [], {}
    for i in order:
        kept = []
        for x in unique[i].split("\n"):
            if not WORD.search(x):
                kept.append(x)
                continue
            short = lambda y: min(len(x), len(y)) < line_dedup.SHORTEST  # noqa: B023, E731
            if all(x != y and (short(y) or abs(len(x) - len(y)) > 2 or distance(x, y) > 2) for y in seen):
                kept.append(x)
            seen.append(x)
        want[i] = "\n".join(kept)
    some = docs.filter(F.col("doc_id").isin(order))
    assert {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(some).collect()} == want
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert sum(r["text"] is None for r in out.collect()) == 1
    assert line_dedup.dedup_lines(none).count() == 0


def test_pipeline_removes_equal_lines_of_any_length(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    long = "a line of some length here"
    rows = [(1, f"Les.\n\n{long}\nLes!\n--", "a"), (2, f"Les.\nx\n\n{long}s\n--", "b"), (3, "x\nLes.\nLes", "c"), (4, None, "d"), (5, "x", "e")]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in pipeline.lines(spark, t, "").collect()}
    assert got == {1: f"Les.\n\n{long}\nLes!\n--", 2: "x\n", 3: "Les", 4: None, 5: ""}
    assert {r["doc_id"]: (r["n_equal"], r["n_near"]) for r in line_dedup.dedup_lines(t).collect()} == {1: (0, 0), 2: (2, 1), 3: (2, 0), 4: (0, 0), 5: (1, 0)}


def test_line_families(spark):
    """Many different lines from one template share segments and differ in digits: against brute force."""
    rng = np.random.default_rng(8)
    lines = [f"request number {n:012d} finished at noon" for n in rng.integers(0, 10**12, 70)]
    lines += [lines[7].replace("noon", "moon"), lines[9][:-1], lines[11].replace("number ", "number"), "x" * 40, "x" * 41]
    t = spark.createDataFrame([(i, "\n".join(lines[i * 15:(i + 1) * 15])) for i in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(t).collect()}
    gone = {j for j, x in enumerate(lines) if any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in lines[:j])}
    assert {70, 71, 72, 74} <= gone
    assert got == {i: "\n".join(lines[j] for j in range(i * 15, (i + 1) * 15) if j not in gone) for i in range(5)}


def test_toxicity(spark, docs, none):
    rnd = random.Random(4)
    mild, foul = ["tree", "river", "stone", "cloud", "quiet"], ["idiot", "worthless", "zorblax"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 7 == 0
        w = [rnd.choice(mild) for _ in range(30)] + ([rnd.choice(foul), rnd.choice(foul), "zorblax"] if bad else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    t = spark.createDataFrame(rows + [(600, None), (601, ""), (None, "idiot"), rows[0]], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(t, known).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held) >= 0.98 * len(held)
    assert toxicity.score(docs, known.limit(0)).count() == docs.count()
    assert toxicity.score(none, known).count() == 0


def test_pipeline_matches_its_stages(spark):
    import os

    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = table
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == table.columns
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in pipeline.run(spark, sf).collect()) == want
