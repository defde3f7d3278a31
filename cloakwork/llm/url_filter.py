"""URL rules by a Bloom filter cascade.

Level 0 encodes the listed keys.  Level 1 encodes the keys of the corpus that level 0 takes for
listed, level 2 the listed keys that level 1 takes for such, and so on until a level has no false
positive.  Over the corpus's complete key universe the walk through the levels is exact, and a
page needs no join: it tests its few candidate keys against bit arrays that reach the tasks as
scalar values.  Their size is checked before (``most_bits``); a longer list goes by an equi-join.

A key is host (or parent domain) followed by path, such as ``example.com/de/``.  A rule fits its
host and all subdomains if the page's path starts with the rule's; the longest rule wins.

Cases: a null url, or one without ``://``, has empty host and path and fits no rule; repeated
pages give repeated rows; null rules are ignored, a rule in both lists blocks; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import written

BITS_PER_KEY = 12
MOST_BITS = 1 << 27  # 16 MB of bits in a task
HASHES = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path: from the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def rule_forms(rules: DataFrame, rule_col: str = "rule") -> list[tuple[int, int]]:
    """The (number of host labels, path length) forms that rules have: a page has a candidate key for each."""
    host = F.regexp_extract(rule_col, r"(?s)^[^/]*+", 0)
    forms = rules.filter(F.col(rule_col).isNotNull()).select(
        F.size(F.split(host, r"\.")).alias("labels"), (F.length(rule_col) - F.length(host)).alias("path")).distinct()
    return sorted((r["labels"], r["path"]) for r in forms.collect())


def candidate_keys(host: Column, path: Column, forms: list[tuple[int, int]]) -> list[Column]:
    """A page's key of each form, or null."""
    return [F.when((F.length(path) >= n) & (host != ""), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n)))
            for labels, n in forms]


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key: two hashes, stepped."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    first, step = F.pmod(a, F.lit(bits)), F.pmod(b, F.lit(bits - 1)) + 1
    return [F.pmod(first + step * i, F.lit(bits)).cast("int") for i in range(HASHES)]


class Cascade:
    """Bit arrays of alternate levels; build with :func:`cascade`."""

    def __init__(self, levels: list[tuple[int, DataFrame]]) -> None:
        self.levels = levels

    def hit(self, level: int, key: Column) -> Column:
        bits, filter_ = self.levels[level]
        array = filter_.scalar()
        word = lambda p: F.element_at(array, F.shiftright(p, 6) + 1)
        out = F.lit(True)
        for p in _positions(key, level, bits):
            out = out & (F.call_function("shiftrightunsigned", word(p), p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1)
        return out

    def listed(self, key: Column) -> Column:
        """Exact membership for keys of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self.hit(level, key), F.lit(level % 2 == 1)).otherwise(out)
        return out


def _filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the bit array of a set of keys."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).cast("long").alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("w"))
    all_words = keys.sparkSession.range(-(-bits // 64)).join(words, "id", "left")
    return all_words.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("a")).select(
        F.transform("a", lambda x: x["w"]).alias("a"))


def bits_for(n: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(64, 1 << math.ceil(math.log2(max(1, n) * bits_per_key)))


def cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY) -> Cascade:
    """Cascade of the listed keys (column ``key``, distinct) over the distinct keys of the corpus."""
    levels: list[tuple[int, DataFrame]] = []
    inside, rivals = listed, universe.join(listed, "key", "left_anti")
    n = inside.count()
    while n:
        bits, level = bits_for(n, bits_per_key), len(levels)
        levels.append((bits, written(_filter(inside, level, bits), "cascade")))
        taken = written(rivals.filter(Cascade(levels).hit(level, F.col("key"))), "cascade")
        inside, rivals, n = taken, inside, taken.count()
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          bits_per_key: int = BITS_PER_KEY, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict.

    ``rules`` has ``rule`` and ``action`` (allow or block).  A page without a rule is in no list: ``default``.
    """
    named = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), rule_forms(rules))
    all_keys = F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *keys)))
    lists = written(rules.filter("rule IS NOT NULL").groupBy(F.col("rule").alias("key")).agg(F.max("action").alias("action")), "rules")
    if bits_for(lists.count(), bits_per_key) > most_bits:
        return _judge_by_join(named.withColumn("keys", all_keys), lists, default)
    universe = written(named.select(F.explode(all_keys).alias("key")).distinct(), "universe")
    by_action = {a: cascade(lists.filter(F.col("action") == a).select("key"), universe, bits_per_key) for a in ("block", "allow")}
    fits = [F.when(by_action[a].listed(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(a).alias("action")))
            for k in keys for a in by_action]
    first = F.array_max(F.array(F.lit(None).cast("struct<n:int,rule:string,action:string>"), *fits))
    return named.withColumn("first", first).select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.action", F.lit(default)).alias("verdict"))


def _judge_by_join(keyed: DataFrame, lists: DataFrame, default: str) -> DataFrame:
    """For lists too long for bit arrays in a task: distinct (host, path) keys meet the list in an equi-join."""
    shapes = keyed.select("host", "path", "keys").distinct()
    hits = shapes.select("host", "path", F.explode("keys").alias("key")).join(lists, "key").groupBy("host", "path").agg(
        F.max_by(F.struct("key", "action"), F.length("key")).alias("first"))
    return keyed.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("first.key").alias("rule"), F.coalesce("first.action", F.lit(default)).alias("verdict"))
