"""A blocked Bloom filter over 64-bit keys, probed inside the row.

Arrays of hashes lose the keys that are certainly not in a key table before they are exploded, so
the rows that meet the table in a join are in proportion to the hits, not to the text.  The filter is
a value of bounded size: beyond the bound it only lets more keys through, the join behind it decides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import let

BITS_PER_KEY = 16
MOST_WORDS = 1 << 18          # 64-bit words: 2 MB in a task
_PROBES = (0, 6, 12)          # bits of the key that pick a bit of its word
_WORD_BITS = 18               # the bits above them pick the word


def _mask(key: Column) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, p).bitwiseAND(F.lit(63)).cast("int")) for p in _PROBES]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _word(key: Column, words: int) -> Column:
    return F.shiftright(key, _WORD_BITS).bitwiseAND(F.lit(words - 1)).cast("int")


class KeyFilter:
    """Filter over the ``key_col`` (bigint) of a table."""

    def __init__(self, keys: DataFrame, key_col: str, n: int) -> None:
        wanted = 1 << max(0, math.ceil(math.log2(max(n, 1) * BITS_PER_KEY / 64)))
        self.words = min(wanted, MOST_WORDS)
        key = F.col(key_col)
        filled = keys.groupBy(_word(key, self.words).alias("at")).agg(F.bit_or(_mask(key)).alias("bits"))
        # one array of `words` numbers, at most MOST_WORDS: words nobody filled are zero
        self._bits = filled.agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m")).select(
            F.transform(F.sequence(F.lit(0), F.lit(self.words - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits")
        ) if self.words <= 64 else self._dense(filled)

    def _dense(self, filled: DataFrame) -> DataFrame:
        every = filled.sparkSession.range(self.words).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
        ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        return every.agg(ordered.alias("o")).select(F.transform("o", lambda x: x["bits"]).alias("bits"))

    def keep(self, df: DataFrame, hashes: Column, out: str) -> DataFrame:
        """Add ``out``: the hashes of an array that may be keys of the table."""
        kept = let(F.struct(F.col("_bits").alias("bits"), hashes.alias("hashes")), lambda b: F.filter(
            b["hashes"], lambda h: let(_mask(h), lambda m: F.get(b["bits"], _word(h, self.words)).bitwiseAND(m) == m)))
        # the two projections collapse into one, so the filter is a value of the plan and rides on no row
        return df.withColumn("_bits", self._bits.scalar()).withColumn(out, kept).drop("_bits")
