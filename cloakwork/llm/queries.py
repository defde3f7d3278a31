"""Registered queries of the corpus operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import (
    ann, bpe, decontaminate, jaccard_join, line_dedup, mixing, quality_rules, substring_dedup, suffix_tree_lm, toxicity, turn_repair, url_filter,
    whitening,
)

Call = Callable[[SparkSession, str], DataFrame]
WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ----------------------------------------------------------------------------- substrings
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL1 = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS key, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, key, p, array_to_string(w[p:p+12], ' ') AS g FROM (SELECT doc_id, key, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT g, min(key) AS lo FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, p + k AS i FROM (SELECT g.doc_id, g.p FROM g JOIN f USING (g) WHERE f.lo < g.key), range(13) r(k)),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)"""


# ----------------------------------------------------------------------------- URL rules
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, action string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def _sql2() -> str:
    hits = []
    for rule, action in URL_RULES:
        host, path = rule.split("/", 1)
        hits.append(f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') "
                    f"THEN {{'n': {len(rule)}, 'rule': '{rule}', 'action': '{action}'}} END")
    return f"""
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT page_id, host, path, list_max(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM r"""


# ----------------------------------------------------------------------------- tokens
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_whole(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


# ----------------------------------------------------------------------------- near duplicates
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


# ----------------------------------------------------------------------------- mixing
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def sql_mix(docs: str = "documents") -> str:
    """doc_id, source, text, size, source_size, target, taken of a documents table."""
    return f"""
SELECT *, CAST(epochs * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken FROM (
  SELECT *, CAST(floor(target - epochs * source_size) AS BIGINT) AS rest,
    CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM (
    SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
    FROM (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {docs}) d
    JOIN (
      SELECT source, source_size, CASE WHEN top IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), top * weight) END AS target FROM (
        SELECT *, (min(CASE WHEN cap / weight > level THEN {{'at': cap / weight, 'level': level}} END) OVER ()).level AS top FROM (
          SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM (
            SELECT source, source_size, 2 * source_size AS cap,
              [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
            FROM (SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS BIGINT) AS source_size FROM {docs} GROUP BY source))))
    ) t ON d.source IS NOT DISTINCT FROM t.source)) """


SQL5 = f"SELECT doc_id, size, source_size, target, taken FROM ({sql_mix()})"


# ----------------------------------------------------------------------------- quality rules
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    book = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.failed(F.col("fail_bits"), "base").alias("base_failed"),
        (~quality_rules.failed(F.col("fail_bits"), "v2")).alias("kept"), "n_lines", "fail_bits")


def sql_quality(docs: str = "documents") -> str:
    """The ledger of a documents table, with the text."""
    return f"""
SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words * 100 > n_words * 30 THEN 2 ELSE 0 END
    + CASE WHEN n_symbols * 100 > n_words * 15 THEN 4 ELSE 0 END + CASE WHEN word_chars * 10 < n_words * 20 THEN 8 ELSE 0 END
    + CASE WHEN word_chars > n_words * 25 THEN 16 ELSE 0 END + CASE WHEN n_dup_lines * 100 > n_lines * 50 THEN 32 ELSE 0 END)::BIGINT AS fail_bits
FROM (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM {docs}) d
  LEFT JOIN (
    SELECT doc_id, count(DISTINCT p + k) AS n FROM (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
        SELECT doc_id, p, w[p:p+7] AS g FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {docs}))))
    , range(8) k(k) WHERE c > 1 GROUP BY doc_id) r USING (doc_id))"""


SQL7 = f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
  fail_bits = 0 AS kept, n_lines, fail_bits FROM ({sql_quality()})"""

# ----------------------------------------------------------------------------- lines
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2("kept", 256).alias("kept_sha256"))


def sql_lines(docs: str = "documents", edits: int = line_dedup.EDITS, shortest: int = line_dedup.SHORTEST) -> str:
    """doc_id, n_lines, n_equal, n_near, kept_text, text ... of a documents table with distinct ids.

    Only lines that share a third (a segment) can be within two edits: the rest is never compared.
    """
    cut = lambda k: f"substr(a.line, 1 + CAST(floor(length(a.line) * {k} / {edits + 1}) AS INTEGER), CAST(floor(length(a.line) / {edits + 1}) AS INTEGER))"
    share = " OR ".join(f"contains(b.line, {cut(k)})" for k in range(edits + 1))
    return f"""
WITH l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {docs}))
  WHERE regexp_matches(x[i], '{WORD}')),
f AS (SELECT line, min({{'d': doc_id, 'i': i}}) AS at FROM l GROUP BY line),
n AS (SELECT DISTINCT greatest(a.at, b.at) AS at FROM f a JOIN f b
  ON length(b.line) BETWEEN length(a.line) AND length(a.line) + {edits} AND a.line <> b.line AND length(a.line) >= {shortest}
  WHERE ({share}) AND levenshtein(a.line, b.line) <= {edits}),
g AS (SELECT l.doc_id, l.i, f.at <> {{'d': l.doc_id, 'i': l.i}} AS equal FROM l JOIN f USING (line) LEFT JOIN n ON f.at = n.at
  WHERE f.at <> {{'d': l.doc_id, 'i': l.i}} OR n.at IS NOT NULL),
r AS (SELECT doc_id, list(i) AS gone, count(*) FILTER (equal) AS n_equal, count(*) FILTER (NOT equal) AS n_near FROM g GROUP BY doc_id)
SELECT d.*, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), chr(10)) AS kept_text
FROM {docs} d LEFT JOIN r USING (doc_id)"""


SQL9 = f"SELECT doc_id, n_lines, n_equal, n_near, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM ({sql_lines()})"

# ----------------------------------------------------------------------------- toxicity
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


# ----------------------------------------------------------------------------- nearest neighbours
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


# ----------------------------------------------------------------------------- language model
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(_table(spark, sf_dir, "documents"))


# ----------------------------------------------------------------------------- conversation repair
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII text."""
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda y: ord(y)::BIGINT)), lambda c, b: {step}), 4294967295)"""


def _sql11() -> str:
    after = {"s0": "s2", "s1": "s2", "s2": "s3", "s3": "s2"}
    way = lambda v, cost, letter: f"{{'c': {v}.c + {cost}, 'a': '{letter}' || {v}.a}}"
    rows, ins = [], []
    for s, t in after.items():
        stay = f"CASE WHEN initial = 'a' THEN {way('s3', 'more', 'K')} END" if s == "s2" else f"CASE WHEN initial = 'u' THEN {way('s2', 'more', 'K')} END"
        if s == "s0":
            stay = f"CASE initial WHEN 's' THEN {way('s1', 'more', 'K')} WHEN 'u' THEN {way('s2', 'more', 'K')} END"
        rows.append(f"list_min([{way(s, 4, 'D')}, CASE WHEN NOT must_go THEN {stay} END, CASE WHEN NOT must_go THEN {way(t, '3 + more', 'R')} END]) AS {s}")
        ins.append(f"list_min([{s}, {way(t, 3, 'I')}, {way(after[t], 6, 'II')}]) AS {s}")
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, {sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '{WORD}') AS blank,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS cut FROM d),
f AS (SELECT *, blank OR again AS must_go, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS more,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, count(*) OVER (PARTITION BY conv_id) AS rows FROM n),
p AS (SELECT conv_id, rows + 1 AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 6, 'a': 'II'}} AS s1, {{'c': 3, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM f WHERE i = 1
  UNION ALL SELECT conv_id, i, {', '.join(ins)} FROM (SELECT f.conv_id, f.i, {', '.join(rows)} FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i + 1)),
b AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM p WHERE i = 1),
l AS (SELECT conv_id, at, letter, CASE WHEN letter <> 'I' THEN count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY at) END AS i
  FROM (SELECT conv_id, at, audit[at] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS at FROM b))),
o AS (SELECT l.conv_id, at, letter, f.role, coalesce(f.text, '') AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY at) AS j,
    first_value(letter = 'K' AND f.initial = 's') OVER (PARTITION BY l.conv_id ORDER BY at) AS led
  FROM l LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i WHERE letter <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j % 2 = 1) <> led THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY at) AS turns
  FROM o GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (more = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(turns, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""


# ----------------------------------------------------------------------------- whitening
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


# ----------------------------------------------------------------------------- benchmark passages
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def _sql13(width: int = decontaminate.WINDOW) -> str:
    split = (f"list_filter(string_split_regex(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), "
             "'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), {width}) AS k, array_to_string(w[p:p + {width - 1}], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id, {split} AS w FROM documents)),
h AS (SELECT r, p, k, item FROM (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)) JOIN g USING (k, g)),
n AS (SELECT r, count(DISTINCT p + q) AS n_hit FROM h, range({width}) t(q) WHERE q < k GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""


QUERIES: dict[str, Call] = {
    "op1_substring_dedup": op1,
    "op2_url_filter": op2,
    "op3_byte_bpe": op3,
    "op4_jaccard_join": op4,
    "op5_source_mix": op5,
    "op6_nearest": op6,
    "op7_quality_rules": op7,
    "op8_suffix_tree": op8,
    "op9_line_dedup": op9,
    "op10_toxicity": op10,
    "op11_turn_repair": op11,
    "op12_whitening": op12,
    "op13_decontaminate": op13,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": SQL1,
    "op2_url_filter": _sql2(),
    "op5_source_mix": SQL5,
    "op7_quality_rules": SQL7,
    "op9_line_dedup": SQL9,
    "op11_turn_repair": _sql11(),
    "op13_decontaminate": _sql13(),
}
