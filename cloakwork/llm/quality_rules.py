"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per
failed rule; policies are masks over these bits, so a new policy version, a what-if, or an
ablation never reads a text again.

Cases: a null text counts as empty (no words, every count 0); very long texts are handled in
their row, in O(n log n); repeated rows give repeated ledger rows; empty tables give empty
ledgers; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import WORD, let, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """``fails`` maps the measurement columns to a boolean that is never null."""

    bit: int
    name: str
    fails: Callable[[dict[str, Column]], Column]


RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30),
    Rule(2, "symbols_per_word", lambda m: m["n_symbols"] * 100 > m["n_words"] * 15),
    Rule(3, "short_words", lambda m: m["word_chars"] * 10 < m["n_words"] * 20),
    Rule(4, "long_words", lambda m: m["word_chars"] > m["n_words"] * 25),
    Rule(5, "repeated_lines", lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 50),
)
#: Policy versions name the rules that reject; "base" is the contract's floor.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols_per_word"),
    "v2": tuple(r.name for r in RULES),
}


def mask_of(version: str, without: tuple[str, ...] = ()) -> int:
    """Bits of a policy, less the rules named in ``without``."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in POLICIES[version] if n not in without)


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    def cover(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["p"])), start, step, lambda a: a["n"])

    return let(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), cover)


def _repeats(w: Column) -> Column:
    windows = lambda: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    some = let(windows(), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))
    return F.when(F.size(w) > WINDOW, some).otherwise(0)


def measured(text: Column) -> Column:
    """Struct of :data:`MEASUREMENTS` (long) of a text column."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.concat_ws("", w)).alias("word_chars"), _repeats(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    both = lambda w: let(of_lines, lambda x: F.struct(
        w["n_words"].cast("long").alias("n_words"), w["word_chars"].cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (x["n"] - x["d"]).cast("long").alias("n_dup_lines"), w["n_repeat_words"].cast("long").alias("n_repeat_words"),
        x["n"].cast("long").alias("n_lines")))
    return let(of_words, both)


def fail_bits(m: dict[str, Column]) -> Column:
    """One bit per failed rule."""
    out = F.lit(0).cast("long")
    for r in RULES:
        out = out + F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(0)
    return out.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``fail_bits``."""
    m = docs.select(F.col(id_col), measured(F.col(text_col)).alias("m")).select(id_col, "m.*")
    return m.withColumn("fail_bits", fail_bits({c: F.col(c) for c in MEASUREMENTS}))


def failed(bits: Column, version: str, without: tuple[str, ...] = ()) -> Column:
    """True where a policy rejects."""
    return bits.bitwiseAND(F.lit(mask_of(version, without))) != 0


def ablations(book: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (kept without it), and how many are kept without it."""
    mask = mask_of(version)
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask))
    rules = [r for r in RULES if r.name in POLICIES[version]]
    sums = [F.struct(F.lit(r.name).alias("rule"), F.count_if(hit.bitwiseAND(F.lit(1 << r.bit)) != 0).alias("failed"),
                     F.count_if(hit == (1 << r.bit)).alias("failed_alone"),
                     F.count_if(hit.bitwiseAND(F.lit(mask & ~(1 << r.bit))) == 0).alias("kept_without")) for r in rules]
    return book.agg(F.array(*sums).alias("rules")).select(F.explode("rules").alias("r")).select("r.*")


def keep_good(docs: DataFrame, version: str = "v2", text_col: str = "text") -> DataFrame:
    """The documents a policy keeps, with their columns."""
    verdict = let(measured(F.col(text_col)), lambda m: failed(fail_bits({c: m[c] for c in MEASUREMENTS}), version))
    return docs.filter(~verdict)
