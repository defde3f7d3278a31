"""Line deduplication within an edit distance, by segments.

Rule: a line goes if a line that stands earlier (smaller document id, then place) is equal or at
most ``edits`` insertions, deletions or substitutions away.  Lines shorter than ``shortest``
characters are near to none, for two edits are much of them, but go if they are equal.  Lines without a word always stay.

Method: equal lines are reduced to their first occurrence.  A distinct line is cut into edits + 1
segments; of two lines within the distance, one segment of the shorter occurs unchanged in the
longer, moved by a bounded shift.  So each line stores its segments under (length, segment number,
content), and looks up its own substrings under the lengths it can be near to, at the shifts that
leave enough edits for the rest.  What meets, with letter counts that allow it, is verified with a banded bit-parallel edit distance:
a band of 2 edits + 1 cells is one machine word.  Texts are shuffled once, by document.

Cases: null texts have no lines and stay null; rows that share an id or have none come after all
others, in the order of a hash of their texts, and equal ones among them keep the same lines; ids are
below 2 ** 62; a line of any length is one line; empty tables give empty results; only the named columns are read, other columns ride along in :func:`without_repeats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import WORD, let, row_key, written

EDITS = 2
SHORTEST = 16


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` apart; their lengths may differ by no more than that.

    Bit r of the state is row i - edits + r of the matrix at step i; the score follows the lowest
    diagonal of the band to the last row and then that row.
    """
    full, top = (1 << 2 * edits + 1) - 1, 1 << 2 * edits
    bit = lambda x, m: x.bitwiseAND(m) != 0
    inverse = lambda x: x.bitwiseXOR(F.lit(full))

    def run(chars: Column) -> Column:
        long, short = chars["a"], chars["b"]
        down = F.size(long) - edits  # steps before the band's lowest diagonal meets the last row

        def step(s: Column, i: Column) -> Column:
            here = F.get(short, i)
            match = sum((F.when(F.get(long, i + (r - edits)) == here, 1 << r).otherwise(0) for r in range(1, 2 * edits + 1)),
                        F.when((i >= edits) & (F.get(long, i - edits) == here), 1).otherwise(0)) if edits else F.when(F.get(long, i) == here, 1).otherwise(0)
            vp, vn, score, row = s["vp"], s["vn"], s["score"], s["row"]

            def after(d0: Column) -> Column:
                hp = vn.bitwiseOR(inverse(d0.bitwiseOR(vp)))
                hn, moved = d0.bitwiseAND(vp), F.shiftright(d0, 1)
                gain = F.when(i < down, F.when(bit(d0, F.lit(top)), 0).otherwise(1)).otherwise(
                    F.when(bit(hp, row), 1).when(bit(hn, row), -1).otherwise(0))
                return F.struct(hn.bitwiseOR(inverse(moved.bitwiseOR(hp))).alias("vp"), moved.bitwiseAND(hp).alias("vn"),
                                (score + gain).alias("score"), F.when(i < down, row).otherwise(F.shiftright(row, 1)).alias("row"))

            return let(match, lambda m: let(
                (m.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full)).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn), after))

        start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("score"), F.lit(top >> 1).alias("row"))
        places = F.when(F.size(short) > 0, F.sequence(F.lit(0), F.size(short) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda s: s["score"] <= edits)

    cut = lambda x: F.array_remove(F.split(x, ""), "")
    longer = F.length(a) >= F.length(b)
    pair = F.struct(cut(F.when(longer, a).otherwise(b)).alias("a"), cut(F.when(longer, b).otherwise(a)).alias("b"))
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, False).otherwise(let(pair, run))


def _segment(length: Column, edits: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment k of a line: the last ones take the rest."""
    size, rest = F.floor(length / (edits + 1)).cast("int"), (length % (edits + 1)).cast("int")
    long_from = F.lit(edits + 1) - rest  # segments from here on are one longer
    return size * k + F.greatest(F.lit(k) - long_from, F.lit(0)), size + F.when(F.lit(k) >= long_from, 1).otherwise(0)


def segment_keys(line: Column, length: Column, edits: int) -> tuple[list[Column], list[Column]]:
    """Keys a line is stored under, and the further keys under which it looks for shorter or equal ones."""
    key = lambda of, k, start, size: F.xxhash64(of, F.lit(k), F.substring(line, start + 1, size))
    stored, looked = [], []
    for k in range(edits + 1):
        start, size = _segment(length, edits, k)
        stored.append(key(length, k, start, size))
    for less in range(edits + 1):
        of = length - less
        for k in range(edits + 1):
            start, size = _segment(of, edits, k)
            for shift in range(-edits, edits + 1):
                # edits left of the segment are at least |shift|, right of it at least |less - shift|
                if abs(shift) + abs(less - shift) > edits or abs(shift) > k or abs(less - shift) > edits - k or (less == shift == 0):
                    continue
                at = start + shift
                looked.append(F.when((at >= 0) & (at + size <= length), key(of, k, at, size)))
    return stored, looked


LETTERS = "etaoinsr"


def letter_counts(line: Column, length: Column) -> Column:
    """How often eight frequent letters occur, modulo 256, a byte each."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = (length - F.length(F.replace(line, F.lit(c), F.lit("")))) % 256
        out = out.bitwiseOR(F.shiftleft(n.cast("long"), 8 * i))
    return out


def counts_allow(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines can be within the distance: an edit raises one count and lowers one, by one at most."""
    more, less = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        byte = lambda x: F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))  # noqa: B023, E731
        apart = F.pmod(byte(a) - byte(b) + 128, F.lit(256)) - 128
        more, less = more + F.greatest(apart, F.lit(0)), less - F.least(apart, F.lit(0))
    return (more <= edits) & (less <= edits)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _counts(line: Column) -> Column:
    return line.rlike(WORD)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """d (the order of documents, one number per id or, where ids repeat, per text) and pack (the columns), dealt by d.

    The columns travel as one value that is never cut to the fields a branch needs: so every branch
    has the same exchange, and texts are shuffled once.  Also the same rows as they are read.
    """
    rows = docs.select(F.array(F.struct(*docs.columns)).alias("pack"), row_key(id_col).alias("d"))
    text = F.element_at("pack", 1)[text_col]
    again = written(docs.select(row_key(id_col).alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d"), "again")
    if not again.isEmpty():
        behind = F.lit(1 << 62) + F.xxhash64(F.col("d"), text).bitwiseAND(F.lit((1 << 62) - 1))
        rows = rows.join(again.select(F.col("d").alias("twice")), F.col("d") == F.col("twice"), "left").withColumn(
            "d", F.when(F.col("twice").isNull(), F.col("d")).otherwise(behind)).drop("twice")
    return rows.repartition("d"), rows


def kept_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The docs' columns in ``doc``, with ``lines`` (array), ``kept`` (places from 0), ``n_equal`` and ``n_near`` (lines removed)."""
    base, read = _documents(docs, id_col, text_col)
    # all that follows is one plan: its exchanges of texts, lines and keys are shared by the branches that need them
    text = base.select("d", F.element_at("pack", 1)[text_col].alias("text"))
    lines = read.select("d", F.posexplode(_lines(F.element_at("pack", 1)[text_col])).alias("pos", "line")).filter(_counts(F.col("line")))
    firsts = lines.groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")).agg(
        F.min(F.struct("d", "pos")).alias("f"), F.first(F.length("line")).alias("n")).select("f.*", "n")
    mine = _picked(text, firsts.filter(F.col("n") >= shortest).groupBy("d").agg(F.collect_list("pos").alias("places")))
    stored, looked = segment_keys(F.col("line"), F.col("n"), edits)
    # keys are columns of their own first: inside the generator they would be interpreted
    keyed = mine.select("d", "pos", letter_counts(F.col("line"), F.col("n")).alias("counts"), F.array(*stored, *looked).alias("keys")).select(
        "d", "pos", "counts", F.posexplode_outer("keys").alias("no", "k")).filter("k IS NOT NULL").repartition("k")
    other = keyed.select(*[F.col(c).alias(c + "2") for c in ("d", "pos", "counts", "no", "k")])
    first, second = F.struct("d", "pos"), F.struct("d2", "pos2")
    kept_key = F.col("no2") < len(stored)
    # one side has a stored key; two of them meet from both sides, once is enough.  (As one condition on
    # both sides it stays in the join, so that both read the same exchange.)
    meets = F.when(F.col("no") < len(stored), kept_key & (first < second)).otherwise(kept_key & (first != second))
    met = keyed.join(other.hint("shuffle_hash"), (F.col("k") == F.col("k2")) & meets & counts_allow(F.col("counts"), F.col("counts2"), edits))
    near = _verified(met.select("d", "pos", "d2", "pos2").distinct(), text, edits)
    places = firsts.join(near, ["d", "pos"], "left").groupBy("d").agg(
        F.collect_list(F.when(F.col("near").isNull(), F.col("pos"))).alias("places"), F.count("near").alias("n_near"))
    joined = base.join(places.hint("shuffle_hash"), "d", "left").withColumn("doc", F.element_at("pack", 1))
    free = F.filter(F.transform("lines", lambda x, i: F.when(_counts(x), -1).otherwise(i)), lambda i: i >= 0)
    kept = F.array_sort(F.array_union(free, F.coalesce("places", F.array().cast("array<int>"))))
    out = joined.withColumn("lines", F.coalesce(_lines(F.col("doc")[text_col]), F.array().cast("array<string>"))).withColumn("kept", kept)
    near_here = F.coalesce("n_near", F.lit(0))
    return out.select("doc", "lines", "kept", (F.size("lines") - F.size("kept") - near_here).cast("long").alias("n_equal"), near_here.cast("long").alias("n_near"))


def _picked(text: DataFrame, places: DataFrame) -> DataFrame:
    """The lines at given places: d, pos, line and its length n."""
    lines = let(_lines(F.col("text")), lambda x: F.transform("places", lambda p: let(F.get(x, p), lambda line: F.struct(
        p.alias("pos"), line.alias("line"), F.length(line).alias("n")))))
    return text.join(places.hint("shuffle_hash"), "d").select("d", F.explode_outer(lines).alias("l")).select("d", "l.pos", "l.line", "l.n")


def _verified(pairs: DataFrame, text: DataFrame, edits: int) -> DataFrame:
    """Of the pairs within the distance, the later lines (d, pos, near)."""
    line = lambda at: F.get(_lines(F.col("text")), F.col(at))
    one = text.join(pairs.hint("shuffle_hash"), "d").select("d", "pos", "d2", "pos2", line("pos").alias("line"))
    both = text.withColumnRenamed("d", "d2").join(one.hint("shuffle_hash"), "d2").select("d", "pos", "d2", "pos2", "line", line("pos2").alias("line2"))
    close = both.filter(within(F.col("line"), F.col("line2"), edits))
    later = F.greatest(F.struct("d", "pos"), F.struct(F.col("d2").alias("d"), F.col("pos2").alias("pos")))
    return close.select(later.alias("f")).distinct().select("f.*", F.lit(True).alias("near"))


def kept_text() -> Column:
    """The kept lines, joined by newlines."""
    return let(F.col("lines"), lambda x: F.array_join(F.transform("kept", lambda i: F.get(x, i)), "\n"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_equal, n_near (lines removed as equal or near to an earlier one), kept (text)."""
    out = kept_lines(docs.select(id_col, text_col), edits, shortest, id_col, text_col)
    return out.select(F.col(f"doc.{id_col}").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), "n_equal", "n_near", kept_text().alias("kept"))


def without_repeats(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, repeated lines removed from the text."""
    out = kept_lines(docs, edits, shortest, id_col, text_col)
    text = F.when(F.col(f"doc.{text_col}").isNotNull(), kept_text())
    return out.select(*[(text if c == text_col else F.col(f"doc.{c}")).alias(c) for c in docs.columns])
