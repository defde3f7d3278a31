"""Dictionary match: every occurrence of many registered forms in many texts.

The cost per text does not grow with the registry.  Each form is represented by one *anchor*:
its links of three (else two) neighbouring words, edge words cut to their inner three
characters, the one rarest in the registry; for a single-word form the rarest 8-, 4-, 2- or
1-character gram.  A word of 15 characters and more is anchored by its first eight 8-grams at once:
the text then needs to be cut into 8-blocks only, because one of eight neighbouring grams starts a
block.  A text can only contain the form if it contains an anchor, so anchors select candidates and
only those are scanned for real.  Two exact physical ways:

* inline - a registry of checked size is one value of the plan; texts never move;
* join - any size: what a text holds of the anchors meets them in an equi-join, candidates return to
  their text by key.

Which anchors a text holds is looked up word by word in an Arrow pass with the set of all anchors, as
long as that set has a checked size; beyond it a Bloom filter drops the other grams inside the row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions import fixed
from cloakwork.functions.predicates import is_case_expandable, is_lowercase_single_word
from cloakwork.functions.text import flexible_pattern, key_fold, let, pin
from cloakwork.operators.prefilter import KeyFilter
from cloakwork.operators.spans import mark_safe, scan
from cloakwork.session import checkpoint

BLOCKS = 88                   # class of 8-grams at every eighth character
_BLOCK = 8
CLASSES = (-3, -2, BLOCKS, 8, 4, 2, 1)  # anchor classes, most selective first
_EDGE = 3                     # characters either side of a word gap
_LONG_RUN = 128
INLINE_FORMS = 4_000          # forms that may travel in the broadcast row
INLINE_BYTES = 2_000_000      # and their total value bytes
MOST_KEYS = 400_000           # anchors that a task may hold as a set
MOST_KEY_BYTES = 16_000_000   # and their total bytes
_KNOWN_WORDS = 50_000         # words a task remembers between texts
_ROWS = 256                   # texts that are Python strings at a time

FORM_DEFAULTS = {
    "entity_id": None, "entity_type": None, "protection_kind": "literal", "canonical": None,
    "boundary": "substring", "name": "registry", "source": "registry", "kind": "custom",
    "confidence": "exact", "authority": "registry",
}


def with_form_defaults(forms: DataFrame) -> DataFrame:
    """Complete a form table ``(value, …)`` to the full form schema."""
    out = forms
    for name, default in FORM_DEFAULTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default).cast("string"))
    out = out.withColumn("entity_id", F.coalesce("entity_id", F.concat(
        F.col("authority"), F.lit(":"), F.sha2(F.col("value"), 256))))
    return out.withColumn("canonical", F.coalesce("canonical", "value"))


def form_struct() -> Column:
    """The fields of a form that candidates carry."""
    return F.struct("value", *FORM_DEFAULTS)


def _split_words(folded: Column) -> Column:
    return F.split(folded, rf"[{fixed.WS}]+")


def _link(words: Column, i: Column, span: int) -> Column:
    """``span`` neighbouring words: edge words by their inner characters, middle ones whole."""
    middle = [F.get(words, i + k) for k in range(1, span - 1)]
    return F.concat_ws(
        " ", F.substring(F.get(words, i), -_EDGE, _EDGE), *middle, F.substring(F.get(words, i + span - 1), 1, _EDGE))


def _links(words: Column, span: int) -> Column:
    return F.when(F.size(words) >= span, F.transform(
        F.sequence(F.lit(0), F.size(words) - span), lambda i: _link(words, i, span)
    )).otherwise(F.array().cast("array<string>"))


def _form_links(words: Column, span: int) -> Column:
    """Links of a form whose edge words are long enough or known to be whole."""
    last = F.size(words) - 1
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(last + 1 - span, F.lit(0))), lambda i: F.when(
            (last + 1 >= span)
            & ((F.length(F.get(words, i)) >= _EDGE) | (i > 0))
            & ((F.length(F.get(words, i + span - 1)) >= _EDGE) | (i + span - 1 < last)),
            _link(words, i, span),
        )),
        lambda h: h.isNotNull(),
    )


def _grams(run: Column, size: int) -> Column:
    """All overlapping grams of one white-space-free run."""
    short = F.transform(
        F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substring(run, i, F.lit(size)))
    # cutting by position is quadratic in the run length, so long runs use one regex pass
    long = F.regexp_extract_all(run, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.when(F.length(run) > _LONG_RUN, long).otherwise(short)


def _word_grams(words: Column, size: int) -> Column:
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: _grams(w, size)))


def _blocks(words: Column) -> Column:
    """The 8-blocks of words that are long enough to hold eight neighbouring 8-grams."""
    cut = rf"(?s)(.{{{_BLOCK}}})"
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 2 * _BLOCK - 1), lambda w:
                                 F.regexp_extract_all(w, F.lit(cut), F.lit(1))))


def text_anchors(text: Column, classes: Sequence[int]) -> Column:
    """Anchor hashes of a text for the given classes (negative: words linked, positive: gram size)."""
    def of_class(words: Column, c: int) -> Column:
        return _links(words, -c) if c < 0 else _blocks(words) if c == BLOCKS else _word_grams(words, c)

    def of_words(words: Column) -> Column:
        parts = [of_class(words, c) for c in classes]
        return F.transform(F.concat(*parts), lambda k: F.xxhash64(k)) if parts else F.array().cast("array<bigint>")
    return let(_split_words(key_fold(text)), of_words)


_ODD_SPACE, _GAP = re.compile("[\x1c-\x1f\x85\ufeff]"), re.compile(
    "[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", fixed.WS) + "]+")


class _Keys:
    """The anchors of a registry by class; tells which of them a folded text holds."""

    def __init__(self, by_class: dict[int, frozenset[str]]) -> None:
        self.by_class = by_class
        # links of three words are looked up by their middle word first
        self.middles = frozenset(k.split(" ")[1] for k in by_class.get(-3, ()))
        self.known: dict[str, tuple[str, ...]] = {}

    def of_word(self, w: str) -> tuple[str, ...]:
        """Grams and blocks of one word; words come again and again, so the last ones are remembered."""
        hit = self.known.get(w)
        if hit is None:
            hit = tuple({w[i:i + size] for c, keys in self.by_class.items() if c > 0
                         for size, step, least in [(_BLOCK, _BLOCK, 2 * _BLOCK - 1) if c == BLOCKS else (c, 1, c)] if len(w) >= least
                         for i in range(0, len(w) - size + 1, step) if w[i:i + size] in keys})
            if len(self.known) >= _KNOWN_WORDS:
                self.known.clear()
            if len(w) <= _LONG_RUN:
                self.known[w] = hit
        return hit

    def of(self, folded: str | None) -> list[str]:
        if folded is None:
            return []
        words = _GAP.split(folded) if _ODD_SPACE.search(folded) else folded.split()
        out: set[str] = set()
        if self.middles:
            for i in [i for i, w in enumerate(words) if w in self.middles]:
                if 0 < i < len(words) - 1:
                    out.add(f"{words[i - 1][-_EDGE:]} {words[i]} {words[i + 1][:_EDGE]}")
            out &= self.by_class[-3]
        if -2 in self.by_class:
            out |= self.by_class[-2].intersection([f"{a[-_EDGE:]} {b[:_EDGE]}" for a, b in zip(words, words[1:])])
        if any(c > 0 for c in self.by_class):
            for w in set(words):
                out.update(self.of_word(w))
        return sorted(out)


def key_lookup(prepared: DataFrame) -> Callable[[Column], Column] | None:
    """From a text column to the array of anchor keys it holds; null if the keys are too many for a task."""
    keys = prepared.select("cls", "key").distinct()
    size = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    if size["n"] > MOST_KEYS or (size["bytes"] or 0) > MOST_KEY_BYTES:
        return None
    # bounded by the check above
    by_class: dict[int, set[str]] = {}
    for r in keys.collect():
        by_class.setdefault(r["cls"], set()).add(r["key"])
    shared = prepared.sparkSession.sparkContext.broadcast(_Keys({c: frozenset(k) for c, k in by_class.items()}))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def held(folded: pa.Array) -> pa.Array:
        look = shared.value
        return pa.array([look.of(x) for a in range(0, len(folded), _ROWS) for x in folded.slice(a, _ROWS).to_pylist()], pa.list_(pa.string()))

    return lambda text: held(key_fold(text))


def _form_anchors(value: Column) -> Column:
    """struct<cls, keys>: anchor class of a form and all its possible anchors of that class."""
    def pick(words: Column) -> Column:
        longest = F.array_max(F.transform(words, lambda w: F.length(w)))
        cls, keys = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.array().cast("array<string>"))
        for c in CLASSES:
            if c == BLOCKS:
                # all eight are needed: which of them starts a block depends on the text
                first = F.get(F.filter(words, lambda w: F.length(w) >= 2 * _BLOCK - 1), F.lit(0))
                found, usable = F.slice(_grams(first, _BLOCK), F.lit(1), F.lit(_BLOCK)), longest >= 2 * _BLOCK - 1
            else:
                found = _form_links(words, -c) if c < 0 else _word_grams(words, c)
                usable = F.size(found) > 0 if c < 0 else longest >= c
            cls, keys = cls.when(usable, F.lit(c)), keys.when(usable, found)
        return F.struct(cls.alias("cls"), F.array_distinct(keys).alias("keys"))
    return let(F.filter(_split_words(key_fold(value)), lambda w: w != ""), pick)


def anchored(forms: DataFrame) -> DataFrame:
    """Add ``cls`` (anchor class), ``key``, the form's rarest anchor, or a row for each it needs, and ``anchor``, its hash."""
    cols = forms.columns
    keyed = forms.withColumn("_a", pin(_form_anchors(F.col("value")))).filter("_a.cls is not null")
    pairs = keyed.select(*cols, F.col("_a.cls").alias("cls"), F.explode("_a.keys").alias("_key")).withColumn(
        "_form", F.xxhash64(*cols))
    chosen = pairs.filter(F.col("cls") != BLOCKS)
    counts = chosen.groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = chosen.join(counts, "_key").groupBy("_form").agg(
        F.min(F.struct("_n", "_key")).alias("_best"), F.first(F.struct(*cols, "cls")).alias("_f")
    ).select("_f.*", F.col("_best._key").alias("key"))
    every = rarest.unionByName(pairs.filter(F.col("cls") == BLOCKS).select(*cols, "cls", F.col("_key").alias("key")))
    return every.withColumn("anchor", F.xxhash64("key"))


def may_occur(folded: Column, value: Column) -> Column:
    """Cheap literal test of a folded text before the regex of a form without white space."""
    return value.rlike(f"[{fixed.WS}]") | folded.contains(key_fold(value))


def expand(text: Column, forms: Column) -> Column:
    """Occurrences of candidate forms in one text.

    ``array<struct<start,end,value,form>>``; white space in a form matches one reflowed line
    break, word-like or detected forms match any letter case, token forms need token edges.
    """
    letter = r"[\p{L}\p{M}\p{N}_]"
    word = f"^{letter}$"

    def pattern(f: Column) -> Column:
        loose = (f.authority == "detected") | is_case_expandable(f.value)
        # a form of one whole word is no hit inside a longer one: the pattern says so, before spans are made of it
        whole = (f.boundary == "token") & f.value.rlike(f"^{letter}+$")
        return let(flexible_pattern(f.value), lambda p: F.concat(F.when(loose, "(?iu)").otherwise(""), F.lit("("), p, F.lit(")"), F.when(
            whole, F.concat(F.lit(f"(?!{letter})(?<!{letter}"), p, F.lit(")"))).otherwise("")))

    def edges(f: Column, s: Column) -> Column:
        first, last = F.substring(f.value, 1, 1), F.substring(f.value, -1, 1)
        before, after = F.substring(text, s.start, F.lit(1)), F.substring(text, s.end + 1, F.lit(1))
        left = first.rlike(word) & (s.start > 0) & before.rlike(word)
        return ~left & ~(last.rlike(word) & after.rlike(word))

    def admitted(f: Column, s: Column) -> Column:
        return F.when(f.boundary == "token", edges(f, s)).otherwise(True) & ~(
            (f.authority == "detected") & is_lowercase_single_word(s.value) & ~is_lowercase_single_word(f.value)
        )

    def of_form(safe: Column, f: Column) -> Column:
        return F.transform(
            F.filter(scan(safe, pattern(f)), lambda s: admitted(f, s)),
            lambda s: F.struct(
                s.start.alias("start"), s.end.alias("end"),
                F.substring(text, s.start + 1, s.end - s.start).alias("value"), f.alias("form"),
            ),
        )

    return let(F.struct(mark_safe(text).alias("safe"), key_fold(text).alias("folded")), lambda b: F.flatten(F.transform(
        F.filter(forms, lambda f: may_occur(b.folded, f.value)), lambda f: of_form(b.safe, f))))


class Dictionary:
    """A registry form table prepared for matching."""

    def __init__(self, forms: DataFrame, inline_forms: int = INLINE_FORMS, inline_bytes: int = INLINE_BYTES):
        self.forms = with_form_defaults(forms).select("value", *FORM_DEFAULTS).filter("value <> ''").distinct()
        # prepared once: matching, the gate and the key filter all read it
        self.anchored = checkpoint(anchored(self.forms))
        # the size check that allows the broadcast row, and the anchor classes in use
        size = self.anchored.agg(
            F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"),
            F.collect_set("cls").alias("classes")).first()
        self.inline = size["n"] <= inline_forms and (size["bytes"] or 0) <= inline_bytes
        self.size = size["n"]
        self.empty = size["n"] == 0
        self.classes = sorted(size["classes"])
        self.lookup = None if self.empty else key_lookup(self.anchored)

    def hashes(self, text: Column) -> Column:
        """Anchor hashes of a text, for the anchor classes this registry uses."""
        return text_anchors(text, self.classes)

    def _row(self) -> DataFrame:
        # one row: bounded by the size check in __init__
        return self.anchored.agg(
            F.collect_set("anchor").alias("_anchors"),
            F.collect_list(F.struct("anchor", form_struct().alias("form"))).alias("_forms"),
        )

    def candidates(self, df: DataFrame, keys: Sequence[str], text_col: str, out: str = "candidates") -> DataFrame:
        """Add the array of forms whose anchor occurs in the text."""
        none = F.array().cast(self.forms.select(F.array(form_struct()).alias("x")).schema["x"].dataType)
        if self.empty:
            return df.withColumn(out, none)
        if self.inline:
            if self.lookup is not None:
                df = df.withColumn("_keys", self.lookup(F.col(text_col)))
                held = F.transform("_keys", lambda k: F.xxhash64(k))
            else:
                held = F.array_intersect("_row._anchors", self.hashes(F.col(text_col)))
            # bound with let: a pushed-down filter may inline this, and it must run once per text
            picked = let(F.struct(F.col("_row._forms").alias("forms"), held.alias("hits")), lambda b: F.when(
                F.size(b["hits"]) > 0, F.array_distinct(F.transform(
                    F.filter(b["forms"], lambda f: F.array_contains(b["hits"], f.anchor)), lambda f: f.form))))
            # the projections collapse into one, so the forms are a value of the plan and ride on no row
            row = self._row().select(F.struct("_anchors", "_forms")).scalar()
            return df.withColumn("_row", row).withColumn(out, pin(F.coalesce(picked, none))).drop("_row", "_keys")
        found = self.candidate_rows(df, keys, text_col).groupBy(*keys).agg(F.collect_set("form").alias(out))
        return df.join(found, list(keys), "left").withColumn(out, F.coalesce(out, none))

    def candidate_rows(self, df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
        """(keys, form) pairs by an equi-join of distinct text grams with the anchors."""
        if self.lookup is not None:
            held = df.select(*keys, self.lookup(F.col(text_col)).alias("_keys")).select(*keys, F.explode("_keys").alias("key"))
            return held.join(self.anchored.select("key", form_struct().alias("form")), "key").drop("key")
        maybe = KeyFilter(self.anchored, "anchor", self.size).keep(df.select(*keys, text_col), self.hashes(F.col(text_col)), "_as")
        grams = maybe.select(*keys, pin(F.array_distinct("_as")).alias("_as")).select(*keys, F.explode("_as").alias("anchor"))
        return grams.join(self.anchored.select("anchor", form_struct().alias("form")), "anchor").drop("anchor")

    def occurrences(self, df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
        """One row per occurrence ``(keys, start, end, surface, value, …form fields)``."""
        return (
            self.candidates(df.select(*keys, text_col), keys, text_col)
            .select(*keys, pin(expand(F.col(text_col), F.col("candidates"))).alias("_os"))
            .select(*keys, F.explode("_os").alias("_o"))
            .select(*keys, "_o.start", "_o.end", F.col("_o.value").alias("surface"), "_o.form.*")
        )


def scoped_candidates(df: DataFrame, keys: Sequence[str], text_col: str, forms: DataFrame, scope: Sequence[str],
                      turn: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """(keys, carried columns, form) of forms whose anchor occurs in a text of their own scope.

    Texts meet only forms whose anchor they contain, never all forms of their scope; anchor classes
    that no form has are not looked for.
    """
    carried = [c for c in forms.columns if c not in {*scope, "value", *FORM_DEFAULTS}]
    prepared = anchored(with_form_defaults(forms).select(*scope, *carried, "value", *FORM_DEFAULTS).distinct())
    prepared = prepared.withColumn("_at", F.xxhash64("anchor", *scope))
    size = prepared.agg(F.count("*").alias("n"), F.collect_set("cls").alias("classes")).first()
    own = [*keys, *[c for c in scope if c not in keys], *[c for c in turn if c not in keys]]
    hashes = F.transform(text_anchors(F.col(text_col), sorted(size["classes"])), lambda a: F.xxhash64(a, *[F.col(c) for c in scope]))
    maybe = KeyFilter(prepared, "_at", size["n"]).keep(df.select(*own, text_col), hashes, "_as")
    grams = maybe.select(*own, pin(F.array_distinct("_as")).alias("_as")).select(*own, F.explode("_as").alias("_at"))
    hit = grams.join(prepared, [*scope, "_at"]).drop("anchor", "key", "cls", "_at")
    if keep is not None:
        hit = hit.filter(keep)
    return hit.select(*keys, *carried, form_struct().alias("form")).distinct()


def match_scoped(df: DataFrame, keys: Sequence[str], text_col: str, forms: DataFrame, scope: Sequence[str],
                 turn: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """Occurrences of forms that belong to the text's own scope (``scope`` columns on both sides).

    ``keep`` is a residual condition over form columns and the text's ``turn`` columns.
    """
    carried = [c for c in forms.columns if c not in {*scope, "value", *FORM_DEFAULTS}]
    found = scoped_candidates(df, keys, text_col, forms, scope, turn, keep)
    scanned = df.select(*keys, text_col).join(found, list(keys))
    return scanned.select(
        *keys, *carried, pin(expand(F.col(text_col), F.array("form"))).alias("_os")
    ).select(*keys, *carried, F.explode("_os").alias("_o")).select(*keys, *carried, "_o.start", "_o.end", F.col("_o.value").alias("surface"), "_o.form.*")


# ------------------------------------------------------------------------ J3
def short_key(value: Column, registered: bool) -> Column:
    """First lexical word of an organization name, without ``the`` and legal designators.

    A detected mention must be exactly one lexical word.
    """
    normalized = F.lower(F.regexp_replace(value, rf"[{fixed.WS}]+", " "))
    if not registered:
        whole = F.trim(normalized)
        return F.when(whole.rlike(f"^{fixed.LEXICAL_WORD}$"), whole)
    words = F.regexp_extract_all(normalized, F.lit(f"({fixed.LEXICAL_WORD})"), F.lit(1))
    return let(
        F.when(F.get(words, F.lit(0)) == "the", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words),
        lambda w: F.get(F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: ~(
            # a word is dropped when it and everything behind it are designators
            ~F.exists(F.slice(w, x.i + 1, F.size(w)), lambda y: ~y.isin(fixed.LINK_LEGAL_DESIGNATORS))
        )), F.lit(0))["x"],
    )


def link_anchors(registry: DataFrame) -> DataFrame:
    """(key, owners) of registered organizations, from canonical and other forms."""
    return (
        registry.filter("protection_kind = 'entity' and entity_type = 'organization'")
        .select(short_key(F.col("value"), True).alias("key"), "entity_id")
        .filter("key is not null").distinct()
        .groupBy("key").agg(
            F.count("*").alias("owners"), F.min("entity_id").alias("owner"),
            F.sort_array(F.collect_list("entity_id")).alias("candidates"))
    )


def link_entities(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach single-word organization mentions to their registered owner.

    ``mentions`` has ``rule``, ``value`` and ``confidence``.  Exactly one owner links; two or
    more is reported as ambiguous, with the candidates.
    """
    eligible = F.col("confidence").isin("exact", "high") & (
        F.translate(F.lower(F.trim("rule")), "_", "-") == "organization")
    keyed = mentions.withColumn("key", F.when(eligible, short_key(F.col("value"), False)))
    out = keyed.join(link_anchors(registry), "key", "left")
    one = F.coalesce(F.col("owners") == 1, F.lit(False))
    many = F.coalesce(F.col("owners") >= 2, F.lit(False))
    return (
        out.withColumn("link_source", F.when(one, "deterministic_alias").otherwise("none"))
        .withColumn("link_confidence", F.when(one, "high"))
        .withColumn("linked_id", F.when(one, F.col("owner")))
        .withColumn("ambiguous", many)
        .withColumn("candidates", F.when(many, F.col("candidates")))
        .drop("owners", "owner", "key")
    )


def ambiguity_diagnostics(admissible: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ambiguous mentions of which some part survived resolution, with hashed owner ids."""
    from cloakwork.operators.spans import span_overlap_join

    spans = admissible.filter("ambiguous").select(*keys, "entity_id", "start", "end", "candidates").distinct()
    won = resolved.filter("ambiguous").select(*keys, "entity_id", "start", "end").distinct()
    hit = span_overlap_join(spans, won, [*keys, "entity_id"]).drop("r_start", "r_end").distinct()
    hashed = F.sort_array(F.transform("candidates", lambda c: F.substring(F.sha2(c, 256), 1, 16)))
    return hit.select(
        *keys, "start", "end", F.size("candidates").alias("candidate_count"), hashed.alias("candidate_ids"))
