"""Conversation structure repair: cheapest edits that give every conversation a legal order of turns.

Legal role initials are ``(s?(ua)+)?``.  Edits: Keep 0, Rerole 3, Delete 4 (the only edit of a blank
or repeated row), Insert 3; a truncated row that stays costs 3 more.  A row of the DAG is (row, role
state); the weight of a path is one integer: its high digits hold the cost, below them every audit
letter has one octal digit at its position, and the end is padded with zeros.  The least integer
therefore is the cheapest repair with the ASCII-least audit, and nothing else is compared.

A conversation need not fit a task.  Rows are ranged over tasks by (conversation, turn), so a long
one spreads over many; each task reduces its pieces (at most ``BLOCK`` rows) to the least weight from
every role state to every other.  Pieces compose: two equally cheap audits of one piece between the
same states never are prefixes of each other (both hold one letter per row, and more letters would be
inserts, which cost), so the choice inside a piece does not depend on what follows.  Pieces of a
conversation then stream through one task from the last to the first, and its texts once, in order,
through the hash; the task holds the audit and one row at a time.

Cases: a null role or text counts as one space, a null conversation id or turn as one space in the
damage key; null turns stand first; a null conversation id is a conversation; rows of one
conversation and turn stand by role and by the digest of role and text; equal rows are rows of their
own (all but the first are duplicates); an empty table gives no rows; only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.llm.common import WORD

BLOCK = 512          # rows of a piece: integers of a piece have at most 9 * BLOCK bits and the cost
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: state -> state that a user or assistant turn leads to, and the role it has
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}


# ----------------------------------------------------------------------------- damage and faults
def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, copies, gone: the rows after damage; dropped rows stay as ``gone`` markers of their conversation."""
    space = F.lit(" ")
    conv, turn = F.col(conv_col), F.col(turn_col)
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    base = rows.select(conv.alias("conv"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return base.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"), (F.col("kind") == 0).alias("gone"))


def as_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of a table that is repaired as it stands, without damage."""
    space = F.lit(" ")
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"),
                       F.coalesce(F.col(text_col), space).alias("text"), F.lit(1).alias("copies"), F.lit(False).alias("gone"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def faults(rows: DataFrame) -> DataFrame:
    """One line per different row: conv, turn, role, digest, initial, blank, cut, gone, n (equal rows), seen (earlier in the conversation).

    No text moves: a row is its digest, and equal rows are counted before the shuffle.
    """
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    compact = rows.select("conv", "turn", "role", _digest().alias("digest"), (~F.col("text").rlike(WORD)).alias("blank"),
                          (~last.isin(".", "!", "?")).alias("cut"), "gone", "copies")
    keys = ["conv", "turn", "role", "digest", "blank", "cut", "gone"]
    counted = compact.groupBy(*keys).agg(F.sum("copies").alias("n"))
    first = counted.filter(~F.col("gone")).groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("at")).select("c", "d", F.col("at.turn").alias("t"), F.lit(True).alias("first"))
    both = counted.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    return both.select(*keys, "n", F.substring("role", 1, 1).alias("initial"), F.col("first").isNull().alias("seen"))


# ----------------------------------------------------------------------------- the DP of a piece
class Weights:
    """Path weights of up to ``width`` audit letters as integers."""

    def __init__(self, width: int) -> None:
        self.bits = 3 * width
        self.mask = (1 << self.bits) - 1

    def before(self, cost: int, letter: str, rest: int) -> int:
        """The weight of one edit followed by ``rest``."""
        return ((rest >> self.bits) + cost << self.bits) + (LETTERS[letter] << self.bits - 3) + ((rest & self.mask) >> 3)

    def of(self, cost: int, audit: str) -> int:
        digits = audit.translate(TO_DIGITS)
        return (cost << self.bits) + (int(digits, 8) << self.bits - 3 * len(digits) if digits else 0)

    def read(self, weight: int) -> tuple[int, str]:
        digits = format(weight & self.mask, "o").zfill(self.bits // 3)
        return weight >> self.bits, digits.rstrip("0").translate(TO_LETTERS)


TO_DIGITS = str.maketrans({k: str(v) for k, v in LETTERS.items()})
TO_LETTERS = str.maketrans({str(v): k for k, v in LETTERS.items()})


def _row_step(w: Weights, row: tuple[str, bool, bool], after: list) -> list:
    """Least weights from each state in front of a row, given those behind it (None: no path)."""
    initial, bound_to_go, cut = row
    here = []
    for s in STATES:
        best = [w.before(DELETE, "D", after[s])] if after[s] is not None else []
        if not bound_to_go:
            more = CUT if cut else 0
            t = SYSTEM if initial == "s" and s == START else NEXT[s] if initial == ("a" if s == USER else "u") else None
            if t is not None and after[t] is not None:
                best.append(w.before(KEEP + more, "K", after[t]))
            if after[NEXT[s]] is not None:
                best.append(w.before(REROLE + more, "R", after[NEXT[s]]))
        here.append(min(best, default=None))
    return _inserted(w, here)


def _inserted(w: Weights, here: list) -> list:
    """Allow inserts in front: two lead from any state to any that inserts can reach, three would go round."""
    out = here
    for _ in range(2):
        out = [min((x for x in (here[s], None if out[NEXT[s]] is None else w.before(INSERT, "I", out[NEXT[s]])) if x is not None), default=None)
               for s in STATES]
    return out


def piece_weights(rows: list[tuple[str, bool, bool]]) -> list[list[tuple[int, str] | None]]:
    """[from][to] -> (cost, audit) of a piece, rows as (initial, blank or duplicate, truncated)."""
    w = Weights(3 * len(rows))
    ends = []
    for t in STATES:
        v = [0 if s == t else None for s in STATES]
        for row in reversed(rows):
            v = _row_step(w, row, v)
        ends.append(v)
    return [[None if ends[t][s] is None else w.read(ends[t][s]) for t in STATES] for s in STATES]


FINAL = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


def in_front(piece: list[list[tuple[int, str] | None]], rest: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Least (cost, audit) from each state through a piece and what follows it."""
    out = []
    for s in STATES:
        ways = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(piece[s], rest) if a is not None]
        w = Weights(max(len(x) for _, x in ways))
        out.append(min(ways, key=lambda x: w.of(*x)))
    return out


# ----------------------------------------------------------------------------- tasks
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]


def _piece_schema(conv: T.DataType) -> T.StructType:
    way = T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    return T.StructType([
        T.StructField("conv", conv), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("rows", T.LongType()),
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()),
        T.StructField("at_turn", T.LongType()), T.StructField("at_role", T.StringType()), T.StructField("at_digest", T.BinaryType()),
        T.StructField("no", T.LongType()), T.StructField("ways", T.ArrayType(way))])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _emit(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


class _Piece:
    """Rows of one conversation that stand together in a task."""

    def __init__(self, at: tuple, no: int) -> None:
        self.conv, self.at, self.no = at[0], at[1:], no
        self.rows: list[tuple[str, bool, bool]] = []
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.head = self.tail = self.turn = None

    def add(self, turn, initial: str, blank: bool, cut: bool, seen: bool) -> None:
        self.count["blank"] += blank
        self.count["duplicate"] += not blank and seen
        self.count["truncated"] += not blank and not seen and cut
        self.count["illegal"] += self.rows != [] and self.tail + initial not in ("su", "ua", "au")
        if turn is not None:
            self.count["turns"] += self.turn != turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.head = initial if self.head is None else self.head
        self.tail = initial
        self.rows.append((initial, blank or seen, cut and not blank and not seen))

    def line(self) -> tuple:
        ways = [w for side in piece_weights(self.rows) for w in side]
        return (self.conv, *self.count.values(), len(self.rows), self.low, self.high, self.head, self.tail, *self.at, self.no,
                [None if w is None else {"cost": w[0], "audit": w[1]} for w in ways])


def _pieces(arrow: pa.Schema, block: int):
    def run(batches):
        piece, no, out = None, 0, []
        for conv, turn, role, digest, blank, cut, gone, n, initial, seen in _lines(batches):
            if piece is None or piece.conv != conv:
                if piece is not None:
                    out.append(piece.line())
                no += 1
                piece = _Piece((conv, turn, role, digest), no)
            for k in range(0 if gone else n):
                if len(piece.rows) == block:
                    out.append(piece.line())
                    no += 1
                    piece = _Piece((conv, turn, role, digest), no)
                piece.add(turn, initial, blank, cut, seen or k > 0)
            if len(out) >= 256:
                yield _emit(out, arrow)
                out = []
        if piece is not None:
            out.append(piece.line())
        if out:
            yield _emit(out, arrow)

    return run


class _Whole:
    """Pieces of one conversation, added from the last to the first."""

    def __init__(self, conv) -> None:
        self.conv, self.count, self.rows = conv, dict.fromkeys(COUNTS, 0), 0
        self.best = list(FINAL)
        self.low = self.high = self.head = None

    def add(self, piece: dict) -> None:
        if not piece["rows"]:
            return
        for c in COUNTS:
            self.count[c] += piece[c]
        if self.rows:
            self.count["illegal"] += piece["tail"] + self.head not in ("su", "ua", "au")
            self.count["turns"] -= self.low is not None and piece["high"] == self.low
        if piece["high"] is not None:
            self.high = piece["high"] if self.high is None else self.high
            self.low = piece["low"]
        self.head, self.rows = piece["head"], self.rows + piece["rows"]
        ways = [None if w is None else (w["cost"], w["audit"]) for w in piece["ways"]]
        self.best = in_front([ways[4 * s:4 * s + 4] for s in STATES], self.best)

    def line(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.count["turns"]
        c = self.count
        return (self.conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], *self.best[START])


def _whole_schema(conv: T.DataType) -> T.StructType:
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return T.StructType([T.StructField("conv", conv), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("audit", T.StringType())])


def _wholes(names: list[str], arrow: pa.Schema):
    def run(batches):
        whole, out = None, []
        for line in _lines(batches):
            piece = dict(zip(names, line))
            if whole is None or whole.conv != piece["conv"]:
                if whole is not None:
                    out.append(whole.line())
                whole = _Whole(piece["conv"])
            whole.add(piece)
            if len(out) >= 1024:
                yield _emit(out, arrow)
                out = []
        if whole is not None:
            out.append(whole.line())
        if out:
            yield _emit(out, arrow)

    return run


class Replay:
    """(role, text) turns that an audit leaves of the rows it is given in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _turn(self, text: str) -> tuple[str, str]:
        self.state = NEXT[self.state]
        return ROLE[self.state], text

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._turn("")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "R":
            yield self._turn(text)
        elif letter == "K":
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
            yield role, text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """Conversations as (head line, turns), from lines sorted with the head in front; turns must be read up before the next."""
    lines = _lines(batches)
    ahead = next(lines, None)

    def turns(head: tuple) -> Iterator[tuple[str, str]]:
        nonlocal ahead
        replay = Replay(head[-1])
        ahead = next(lines, None)
        while ahead is not None and ahead[1] == 1:
            for _ in range(ahead[5]):
                yield from replay.row(ahead[3], ahead[4])
            ahead = next(lines, None)
        yield from replay.inserts()

    while ahead is not None:
        head = ahead
        yield head, turns(head)


def _hashed(arrow: pa.Schema):
    def run(batches):
        out = []
        for head, turns in _replayed(batches):
            digest, joint = hashlib.sha256(), ""
            for role, text in turns:
                digest.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            out.append((head[0], *head[6:], digest.hexdigest()))
            if len(out) >= 1024:
                yield _emit(out, arrow)
                out = []
        if out:
            yield _emit(out, arrow)

    return run


def _written_turns(arrow: pa.Schema):
    def run(batches):
        out = []
        for head, turns in _replayed(batches):
            for position, (role, text) in enumerate(turns):
                out.append((head[0], position, role, text))
                if len(out) >= 1024:
                    yield _emit(out, arrow)
                    out = []
        if out:
            yield _emit(out, arrow)

    return run


# ----------------------------------------------------------------------------- the operator
def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of rows from :func:`damaged` or :func:`as_rows`."""
    conv = rows.schema["conv"].dataType
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("gone")]
    lines = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _piece_schema(conv)
    pieces = lines.mapInArrow(_pieces(_arrow(schema), block), schema)
    back = [F.col("conv"), F.col("at_turn").desc_nulls_last(), F.col("at_role").desc(), F.col("at_digest").desc(), F.col("no").desc()]
    whole = _whole_schema(conv)
    return pieces.repartition("conv").sortWithinPartitions(*back).mapInArrow(_wholes(schema.names, _arrow(whole)), whole)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows in order behind the head line of their conversation: conv, part, turn, role, text, copies, columns of the audit."""
    numbers = [c for c in found.columns if c != "conv"]
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    heads = found.select("conv", F.lit(0).alias("part"), nothing("turn", "long"), nothing("role", "string"), nothing("text", "string"),
                         F.lit(0).alias("copies"), *numbers, nothing("digest", "binary"))
    texts = rows.filter(~F.col("gone")).select(
        "conv", F.lit(1).alias("part"), "turn", "role", "text", "copies", *[nothing(c, found.schema[c].dataType) for c in numbers], _digest().alias("digest"))
    order = ["conv", "part", F.col("turn").asc_nulls_first(), "role", "digest"]
    return heads.unionByName(texts).repartition("conv").sortWithinPartitions(*order).drop("digest")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``repaired_sha256`` to :func:`audits`: the digest of the repaired ``role:text`` turns, joined by newlines."""
    found = audits(rows, block)
    schema = T.StructType([*found.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    return _beside(rows, found).mapInArrow(_hashed(_arrow(schema)), schema)


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, position, role, text: the repaired conversations themselves."""
    found = audits(rows, block).select("conv", "audit")
    schema = T.StructType([rows.schema["conv"], T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return _beside(rows, found).mapInArrow(_written_turns(_arrow(schema)), schema)
