"""Redaction, leak gate and fail-closed routing as composed plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.surrogates import Surrogates
from cloakwork.functions.text import decode_query, encode_query, json_escape, key_fold, let, mask_json_strings, pin
from cloakwork.operators.bodies import literals, structural_values
from cloakwork.operators.detect import FINDING, Detector, Rule, findings, first_values, run_detectors
from cloakwork.operators.match import INLINE_BYTES, INLINE_FORMS, Dictionary, expand, link_anchors, may_occur, short_key
from cloakwork.operators.paths import PATH_HINT, preserved
from cloakwork.operators.spans import (
    ORIGIN, longest_first, mark_safe, overlaps, priority, resolve_array, scan, splice,
)

_FIELDS = ("value", "entity_id", "entity_type", "protection_kind", "canonical", "boundary", "name", "source", "kind",
           "confidence", "authority")
_FORM = "struct<" + ",".join(f"{c}:string" for c in _FIELDS) + ">"
_LOCATED = f"array<struct<start:int,end:int,value:string,form:{_FORM}>>"


def detected_forms(found: Column) -> Column:
    """Forms of the distinct values a text's own detectors found."""
    return F.transform(first_values(found), lambda f: F.struct(
        f.value.alias("value"),
        F.concat(F.lit("detected:"), F.sha2(f.value, 256)).alias("entity_id"),
        F.lit(None).cast("string").alias("entity_type"), F.lit("literal").alias("protection_kind"),
        f.value.alias("canonical"), F.lit("substring").alias("boundary"), f.rule.alias("name"),
        f.source.alias("source"), f.kind.alias("kind"), f.confidence.alias("confidence"),
        F.lit("detected").alias("authority"),
    ))


def _claim(start: Column, end: Column, value: Column, form: Column, origin: str) -> Column:
    attributes = {
        "authority": form.authority, "confidence": form.confidence, "source": form.source,
        "entity_id": form.entity_id,
        "detection_source": F.when(form.authority == "registry", "registry").otherwise("detector"),
        "link_source": F.when(form.authority == "registry", "explicit_form").when(
            form.protection_kind == "entity", "deterministic_alias").otherwise("none"),
        "link_confidence": F.when((form.authority != "registry") & (form.protection_kind == "entity"), "high").otherwise(""),
        "origin": F.lit(origin),
    }
    return F.struct(
        priority(start, end, value, attributes.__getitem__).alias("pri"),
        start.alias("start"), end.alias("end"), value.alias("value"), form.alias("info"),
    )


def raised_claims(text: Column, forms: Column, found: Column) -> Column:
    """Claims of one text, wherever they stand: detector spans and expanded forms."""
    by_expansion = F.transform(expand(text, forms), lambda o: _claim(o.start, o.end, o.value, o.form, "expansion"))
    by_detector = F.transform(found, lambda f: _claim(f.start, f.end, f.value, f.form, "detector"))
    return F.concat(by_detector, by_expansion)


def admissible_claims(text: Column, raised: Column, tokens_pattern: str, prefix: str, preserve_paths: bool = True) -> Column:
    """Those of the claims that stand outside tokens and paths."""
    tokens = F.when(text.contains(prefix), scan(mark_safe(text), f"({tokens_pattern})"))

    def admissible(bound: Column) -> Column:
        return F.filter(raised, lambda c: ~F.exists(
            F.coalesce(bound.tokens, F.array().cast("array<struct<start:int,end:int,value:string>>")),
            lambda t: overlaps(t.start, t.end, c.start, c.end),
        ) & ~(bound.hint & preserved(text, c.start, c.end, c.value)))

    hint = text.rlike(PATH_HINT) if preserve_paths else F.lit(False)
    return let(F.struct(tokens.alias("tokens"), hint.alias("hint")), admissible)


def claims_of(text: Column, forms: Column, found: Column, tokens_pattern: str, prefix: str,
              preserve_paths: bool = True) -> Column:
    """Admissible claims of one text: detector spans and expanded forms, outside tokens and paths."""
    return admissible_claims(text, raised_claims(text, forms, found), tokens_pattern, prefix, preserve_paths)


@dataclass
class Redactor:
    """Detect, match, resolve and replace protected values.

    ``registry`` is a form table (see :mod:`cloakwork.operators.match`).  With ``context_col``
    registered entities get family tokens bound to that context.
    """

    surrogates: Surrogates
    rules: Sequence[Rule] = ()
    registry: DataFrame | None = None
    preserve_paths: bool = True
    max_entities: int = fixed.MAX_ENTITIES
    max_occurrences: int = fixed.MAX_OCCURRENCES
    dictionary: Dictionary | None = field(default=None)
    inline_links: int = INLINE_FORMS

    def __post_init__(self) -> None:
        if self.dictionary is None and self.registry is not None:
            self.dictionary = Dictionary(self.registry)
        self.links = self._link_table()

    def _link_table(self) -> DataFrame | None:
        """(key, owner) of registered organizations that one short name belongs to alone, if the registry has any."""
        if self.dictionary is None:
            return None
        entities = self.dictionary.forms.filter("protection_kind = 'entity' and entity_type = 'organization'")
        found = link_anchors(entities).filter("owners = 1").select("key", "owner")
        size = found.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + F.octet_length("owner")).alias("bytes")).first()
        self.links_inline = size["n"] <= self.inline_links and (size["bytes"] or 0) <= INLINE_BYTES
        return found if size["n"] else None

    # ------------------------------------------------------------------ stages
    def with_candidates(self, df: DataFrame, keys: Sequence[str], text_col: str, out: str) -> DataFrame:
        if self.dictionary is None:
            return df.withColumn(out, F.array().cast(f"array<{_FORM}>"))
        return self.dictionary.candidates(df, keys, text_col, out).withColumn(out, F.col(out).cast(f"array<{_FORM}>"))

    def with_findings(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        if not self.rules:
            return df.withColumn(out, F.array().cast(
                "array<struct<rule:string,start:int,end:int,value:string,kind:string,confidence:string,"
                "source:string,score:double>>"))
        return df.withColumn(out, pin(findings(F.col(text_col), self.rules, self.surrogates.prefix)))

    def token(self, value: Column, info: Column, context: Column | None) -> Column:
        literal = self.surrogates.mint(value, info["name"], info.kind)
        if context is None:
            return literal
        return F.when(
            (info.protection_kind == "entity") & info.entity_type.isNotNull(),
            self.surrogates.mint_entity(context, info.entity_id, info.entity_type, value),
        ).otherwise(literal)

    def redact(self, df: DataFrame, keys: Sequence[str], text_col: str = "text",
               context_col: str | None = None, extra_forms: str | None = None, raised: str | None = None) -> DataFrame:
        """Plain texts, without any shuffle of texts when the registry is inline.

        Adds ``redacted``, ``spans`` (resolved, with token and owner), ``known`` (values that must
        not survive) and ``over_limit``; a text over a limit keeps no redacted form, because it is
        to be blocked, never truncated.  ``extra_forms`` names an array column of further forms.
        A value goes wherever it occurs again; spans that a rule itself gave are ``found``.
        ``raised`` names an array column to add: every find of a rule or a given form ``(start, end, value, info)``,
        also those that overlap or stay readable.
        """
        text = F.col(text_col)
        out = self.with_findings(self.with_candidates(df, keys, text_col, "_registry"), text_col, "_found")
        out = out.withColumn("_detected", pin(detected_forms(F.col("_found"))))
        extra = F.col(extra_forms).cast(f"array<{_FORM}>") if extra_forms else F.array().cast(f"array<{_FORM}>")
        out = out.withColumn("_forms", F.concat("_registry", extra, "_detected"))
        located = F.transform("_found", lambda f: F.struct(
            f.start.alias("start"), f.end.alias("end"), f.value.alias("value"),
            F.get(F.filter("_detected", lambda d: d.value == f.value), F.lit(0)).alias("form")))
        claims = raised_claims(text, F.col("_forms"), located)
        if raised:
            out = out.withColumn("_raised", pin(claims))
            out = out.withColumn(raised, F.transform(
                F.filter("_raised", lambda c: (c.info.authority == "registry") | (c.pri.p_origin == -ORIGIN["detector"])),
                lambda c: c.dropFields("pri")))
            claims = F.col("_raised")
        out = out.withColumn("_claims", pin(admissible_claims(
            text, claims, self.surrogates.pattern, self.surrogates.prefix, self.preserve_paths)))
        over = (F.size("_forms") > self.max_entities) | (F.size("_claims") > self.max_occurrences)
        out = out.withColumn("over_limit", over)
        context = F.col(context_col).cast("string") if context_col else None
        place = lambda s: F.shiftleft(s.start.cast("bigint"), 31) + s.end
        out = out.withColumn("_places", pin(F.transform("_found", place)))
        spans = F.transform(
            resolve_array(F.when(F.col("over_limit"), F.filter("_claims", lambda c: F.lit(False))).otherwise(F.col("_claims"))),
            lambda r: F.struct(
                r.start.alias("start"), r.end.alias("end"), r.value.alias("value"),
                self.token(r.value, r.info, context).alias("token"), r.clipped.alias("clipped"),
                r.clipped_by.alias("clipped_by"), r.info.entity_id.alias("entity_id"),
                r.info["name"].alias("name"), r.info.source.alias("source"), r.info.kind.alias("kind"),
                r.info.confidence.alias("confidence"), r.info.authority.alias("authority"),
                r.info.boundary.alias("boundary"), r.info.protection_kind.alias("protection_kind"),
                F.array_contains("_places", place(r)).alias("found"),
            ),
        )
        out = out.withColumn("spans", pin(spans))
        out = out.withColumn("redacted", pin(F.when(
            ~F.col("over_limit"), splice(text, F.col("spans"), lambda s: s.token))))
        surfaces = F.transform(
            F.filter("spans", lambda s: ~s.clipped),
            lambda s: F.struct(s.value.alias("value"), (s.boundary == "token").alias("token_bound")))
        out = out.withColumn("known", F.array_distinct(F.concat(
            F.transform("_detected", lambda f: F.struct(f.value.alias("value"), F.lit(False).alias("token_bound"))),
            surfaces)))
        return out.drop("_registry", "_found", "_detected", "_forms", "_raised", "_claims", "_places")

    def gate(self, df: DataFrame, keys: Sequence[str], redacted_col: str = "redacted",
             known_col: str = "known", json_body: bool = False) -> DataFrame:
        """Add ``leaks``: distinct known values still present in an outbound text.

        Registry forms are matched again, independently of what the resolver chose; text inside
        surrogate tokens never counts.  For JSON bodies numbers are checked as whole tokens.
        """
        out = df
        if json_body:
            # the decoded strings, kept apart by an empty line that no match can bridge
            body = F.col(redacted_col)
            strings = F.array_join(F.transform(literals(body), lambda x: x["text"]), "\n\n")
            valid = F.try_parse_json(body).isNotNull()
            out = out.withColumn("_strings", pin(strings))
            primitives = F.array_distinct(F.regexp_extract_all(mask_json_strings(body), F.lit(r"([A-Za-z0-9_.+-]+)"), F.lit(1)))
            out = out.withColumn("_numbers", pin(F.when(valid, primitives).otherwise(F.array().cast("array<string>"))))
            # registered values are looked for among strings and among numbers
            out = out.withColumn("_all", F.concat_ws("\n\n", "_strings", "_numbers"))
        text = F.col("_strings" if json_body else redacted_col)
        out = self.with_candidates(out, keys, "_all" if json_body else redacted_col, "_again")
        known = F.transform(F.coalesce(F.col(known_col), F.array().cast(
            "array<struct<value:string,token_bound:boolean>>")), lambda k: F.struct(
                k.value.alias("value"), F.sha2(k.value, 256).alias("entity_id"),
                F.lit(None).cast("string").alias("entity_type"), F.lit("literal").alias("protection_kind"),
                k.value.alias("canonical"), F.when(k.token_bound, "token").otherwise("substring").alias("boundary"),
                F.lit("known").alias("name"), F.lit("known").alias("source"), F.lit("custom").alias("kind"),
                F.lit("exact").alias("confidence"), F.lit("registry").alias("authority")))
        # a value can only be left over if it occurs literally or has white space or letters to vary
        left = claims_of(text, F.concat(known, F.col("_again")),
                         F.array().cast(f"array<struct<start:int,end:int,value:string,form:{_FORM}>>"),
                         self.surrogates.pattern, self.surrogates.prefix, self.preserve_paths)
        out = out.withColumn("leaks", pin(F.sort_array(F.array_distinct(F.transform(left, lambda c: c.info.value)))))
        if json_body:
            values = F.transform(F.concat(known, F.col("_again")), lambda f: f.value)
            out = out.withColumn("leaks", pin(F.array_distinct(F.concat("leaks", F.array_intersect(values, "_numbers")))))
        return out.drop("_again", "_strings", "_numbers", "_all")

    # -------------------------------------------------------------- text surface
    def redact_text(self, df: DataFrame, keys: Sequence[str], text_col: str,
                    preserve_paths: bool | None = None) -> DataFrame:
        """Raw text surfaces (headers, query parts): longest value first, losers dropped whole.

        Matching is exact apart from flexible white space, as for already registered values.
        """
        keep_paths = self.preserve_paths if preserve_paths is None else preserve_paths
        text = F.col(text_col)
        out = self.with_findings(self.with_candidates(df, keys, text_col, "_registry"), text_col, "_found")
        forms = F.concat("_registry", detected_forms(F.col("_found")))
        out = out.withColumn("_forms", pin(forms))
        # only the exact letter case counts on this surface
        exact = F.filter(
            claims_of(text, F.col("_forms"),
                      F.array().cast(f"array<struct<start:int,end:int,value:string,form:{_FORM}>>"),
                      self.surrogates.pattern, self.surrogates.prefix, keep_paths),
            lambda c: F.regexp_replace(c.value, rf"[{fixed.WS}]+", " ")
            == F.regexp_replace(c.info.value, rf"[{fixed.WS}]+", " "))
        picked = longest_first(F.transform(exact, lambda c: F.struct(
            c.start.alias("start"), c.end.alias("end"), c.value.alias("value"),
            c.info.value.alias("pattern_value"), c.info["name"].alias("name"), c.info.kind.alias("kind"),
            c.info.authority.alias("authority"))))
        out = out.withColumn("hits", pin(picked))
        return out.withColumn("redacted", splice(
            text, F.col("hits"), lambda s: self.surrogates.mint(s.pattern_value, s["name"], s.kind),
        )).drop("_registry", "_found", "_forms")

    # --------------------------------------------------------------- JSON bodies
    def with_links(self, df: DataFrame, keys: Sequence[str], forms_col: str) -> DataFrame:
        """Give single-word organization mentions the entity of their only registered owner."""
        if self.links is None:
            return df

        def key_of(f: Column) -> Column:
            named = F.translate(F.lower(F.trim(f["name"])), "_", "-") == "organization"
            return F.when(f.confidence.isin("exact", "high") & named & (f.authority == "detected"), short_key(f.value, False))

        def linked(f: Column) -> Column:
            owner = F.get(F.filter("_owners", lambda o: o["key"] == key_of(f)), F.lit(0))["owner"]
            new = {"entity_type": F.lit("organization"), "protection_kind": F.lit("entity")}
            return let(owner, lambda o: F.when(o.isNotNull(), F.struct(*[
                (o if c == "entity_id" else new.get(c, f[c])).alias(c) for c in _FIELDS]).cast(_FORM)).otherwise(f))

        pair = F.struct("key", "owner")
        if self.links_inline:
            # one row: bounded by the size check in _link_table
            row = self.links.agg(F.collect_list(pair).alias("_owners"), F.lit(1).alias("_link_row"))
            out = df.withColumn("_one", F.lit(1)).join(F.broadcast(row), F.col("_one") == F.col("_link_row"), "left").drop("_one", "_link_row")
        else:
            mentions = df.select(*keys, F.explode(F.array_distinct(F.array_compact(F.transform(forms_col, key_of)))).alias("key"))
            owners = mentions.join(self.links, "key").groupBy(*keys).agg(F.collect_list(pair).alias("_owners"))
            out = df.join(owners, list(keys), "left")
        none = F.array().cast("array<struct<key:string,owner:string>>")
        return out.withColumn("_owners", F.coalesce("_owners", none)).withColumn(
            forms_col, pin(F.transform(forms_col, linked))).drop("_owners")

    def body_values(self, df: DataFrame, keys: Sequence[str], body_col: str = "body", detections: str | None = None) -> DataFrame:
        """Read bodies: ``_lits`` (string literals), ``_found`` (per literal, what the rules find) and ``_detected``.

        ``_detected`` has the distinct values as forms: those of the rules, those that secret-ish keys
        own by path, and ``detections`` (array column of further findings: identity rules,
        analyzers).  Personal data is looked for in contents only, secrets in object keys too.
        Mentions of one registered organization belong to it.
        """
        none = F.array().cast(FINDING)
        out = df.withColumn("_lits", pin(literals(F.col(body_col))))
        if self.rules:
            out = out.withColumn("_found", pin(F.transform("_lits", lambda x: F.filter(
                findings(x["text"], self.rules, self.surrogates.prefix), lambda f: (x["kind"] != "key") | (f["kind"] != "pii")))))
        else:
            out = out.withColumn("_found", F.transform("_lits", lambda x: none))
        owned = structural_values(F.col("_lits"), FINDING) if any(r.kind == "secret" for r in self.rules) else none
        more = F.coalesce(F.col(detections).cast(FINDING), none) if detections else none
        # the first rule by name that finds a value names it
        ranked = F.transform(F.concat(F.flatten("_found"), owned, more), lambda f, i: F.struct(
            f["rule"].alias("rule"), F.coalesce(f["start"], F.lit(0)).alias("start"), i.alias("i"), f.alias("f")))
        ranked = let(ranked, lambda r: F.when(F.size(r) > 1, F.array_sort(r)).otherwise(r))
        out = out.withColumn("_every", pin(F.transform(ranked, lambda r: r["f"])))
        out = out.withColumn("_detected", pin(detected_forms(F.col("_every")).cast(f"array<{_FORM}>"))).drop("_every")
        return self.with_links(out, keys, "_detected")

    def redact_bodies(self, df: DataFrame, keys: Sequence[str], body_col: str = "body", context_col: str | None = None,
                      extra_forms: str | None = None, detections: str | None = None) -> DataFrame:
        """JSON bodies: string keys and values are redacted, every other byte stays as it was.

        Everything happens in the row of the body: its literals are read once, values found anywhere
        in it are replaced in all of them, and the literals that changed are spliced back.  Bodies
        are not shuffled, unless the registry is too large to travel.  Invalid JSON is one raw leaf.

        ``extra_forms`` names an array column of further forms: what the scope has seen before, what
        its user selected.  ``detections``: see :meth:`body_values`.
        """
        keys, none = list(keys), F.array().cast(f"array<{_FORM}>")
        out = self.body_values(df, keys, body_col, detections)
        if self.dictionary is not None and not self.dictionary.empty:
            # literals stand apart by an empty line that no match can bridge
            out = out.withColumn("_joined", F.array_join(F.transform("_lits", lambda x: x["text"]), "\n\n"))
            out = self.with_candidates(out, keys, "_joined", "_registry").drop("_joined")
        else:
            out = out.withColumn("_registry", none)
        extra = F.coalesce(F.col(extra_forms).cast(f"array<{_FORM}>"), none) if extra_forms else none
        out = out.withColumn("_forms", pin(F.concat("_registry", extra, "_detected"))).drop("_registry")

        def claims(x: Column, i: Column) -> Column:
            located = F.transform(F.get("_found", i), lambda f: F.struct(
                f.start.alias("start"), f.end.alias("end"), f.value.alias("value"),
                F.get(F.filter("_detected", lambda d: d.value == f.value), F.lit(0)).alias("form")))
            here = let(key_fold(x["text"]), lambda folded: F.filter("_forms", lambda f: may_occur(folded, f.value)))
            # a literal that can hold no form is done
            return let(F.struct(here.alias("forms"), located.cast(_LOCATED).alias("found")), lambda b: F.when(
                F.size(b["forms"]) + F.size(b["found"]) > 0,
                claims_of(x["text"], b["forms"], b["found"], self.surrogates.pattern, self.surrogates.prefix, self.preserve_paths)))

        out = out.withColumn("_claims", pin(F.transform("_lits", claims)))
        count = F.aggregate("_claims", F.lit(0), lambda n, c: n + F.coalesce(F.size(c), F.lit(0)) * c.isNotNull().cast("int"))
        out = out.withColumn("over_limit", (F.size("_forms") > self.max_entities) | (count > self.max_occurrences))
        context = F.col(context_col).cast("string") if context_col else None

        def edit(x: Column, i: Column) -> Column:
            claimed = F.get("_claims", i)
            spans = F.transform(resolve_array(claimed), lambda r: F.struct(
                r.start.alias("start"), r.end.alias("end"), r.value.alias("value"), self.token(r.value, r.info, context).alias("token"),
                r.clipped.alias("clipped"), r.clipped_by.alias("clipped_by"), r.info.entity_id.alias("entity_id"),
                r.info["name"].alias("name"), r.info.source.alias("source"), r.info.kind.alias("kind"),
                r.info.confidence.alias("confidence"), r.info.authority.alias("authority"), r.info.boundary.alias("boundary"),
                r.info.protection_kind.alias("protection_kind"), i.alias("leaf")))

            def whole(s: Column) -> Column:
                text = splice(x["text"], s, lambda t: t["token"])
                return F.struct(x["at"].alias("start"), x["at_end"].alias("end"), F.when(x["kind"] == "raw", text).otherwise(
                    F.concat(F.lit('"'), json_escape(text), F.lit('"'))).alias("token"), s.alias("spans"))

            return F.when(F.coalesce(F.size(claimed), F.lit(0)) > 0, let(spans, whole))

        out = out.withColumn("_edits", pin(F.when(~F.col("over_limit"), F.filter(
            F.transform("_lits", edit), lambda e: e.isNotNull() & (F.size(e["spans"]) > 0)))))
        out = out.withColumn("redacted", pin(F.when(~F.col("over_limit"), splice(F.col(body_col), F.col("_edits"), lambda e: e["token"]))))
        out = out.withColumn("spans", pin(F.flatten(F.transform("_edits", lambda e: e["spans"]))))
        surfaces = F.transform(F.filter("spans", lambda s: ~s.clipped), lambda s: F.struct(
            s.value.alias("value"), (s.boundary == "token").alias("token_bound")))
        known = F.concat(F.transform("_detected", lambda f: F.struct(f.value.alias("value"), F.lit(False).alias("token_bound"))), surfaces)
        return out.withColumn("known", F.array_distinct(known)).drop("_lits", "_found", "_detected", "_forms", "_claims", "_edits")


def with_detections(df: DataFrame, keys: Sequence[str], body_col: str, detectors: Sequence[tuple[str, Detector, str]],
                    out: str = "detections", threshold: float = fixed.SCORE_THRESHOLD) -> DataFrame:
    """Add what detectors ``(name, callable, view)`` find in the literals of each body, as findings for ``detections``.

    A detector gets leaf rows (keys, leaf, text) and gives spans ``(…, start, end, rule)``, with score,
    confidence, source and kind where it knows them.  Only spans are shuffled.
    """
    keys = list(keys)
    read = df.select(*keys, pin(literals(F.col(body_col))).alias("_lits"))
    leaves = read.select(*keys, F.posexplode("_lits").alias("leaf", "_l")).select(
        *keys, "leaf", F.col("_l.kind").alias("kind"), F.col("_l.text").alias("text"))
    found = run_detectors(leaves, [*keys, "leaf"], "text", detectors)
    have = lambda c, default: F.coalesce(F.col(c), default) if c in found.columns else default
    score = have("score", F.lit(1.0)).cast("double")
    certain = F.when(score >= fixed.HIGH_SCORE, "high").otherwise("probabilistic")
    spans = found.filter(score >= threshold).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(
        F.col("rule"), "leaf", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), have("kind", F.lit("pii")).alias("kind"),
        have("confidence", certain).alias("confidence"), have("source", F.lit("pii-analyzer")).alias("source"), score.alias("score")))).alias("_spans"))
    # a surface is read from its literal in the row of the body
    valued = F.transform("_spans", lambda f: let(F.get("_lits", f["leaf"])["text"], lambda t: F.struct(
        f["rule"], f["start"], f["end"], F.substring(t, f["start"] + 1, f["end"] - f["start"]), f["kind"], f["confidence"], f["source"], f["score"])))
    joined = df.join(spans, keys, "left").withColumn("_lits", literals(F.col(body_col)))
    return joined.withColumn(out, pin(F.coalesce(valued.cast(FINDING), F.array().cast(FINDING)))).drop("_lits", "_spans")


def dictionary_of(redacted: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Reversible mapping rows of a redaction run: ``(scope, token, value, layer, …)``.

    This table is as sensitive as the texts; write it apart from reports.
    """
    return (
        redacted.select(*scope, F.explode("spans").alias("s"))
        .select(*scope, "s.token", "s.value", "s.authority", "s.name", "s.entity_id", (~F.col("s.clipped")).alias("match_form"))
        .groupBy(*scope, "token", "value")
        .agg(F.max("match_form").alias("match_form"), F.min("name").alias("name"),
             F.max("authority").alias("authority"), F.min("entity_id").alias("entity_id"))
        .withColumn("layer", F.when(F.col("authority") == "registry", "registry").otherwise("detected"))
        .withColumn("layer_rank", layer_rank(F.col("layer")))
        .drop("authority")
    )


LAYERS = ["user", "registry", "detected", "permanent"]


def layer_rank(layer: Column) -> Column:
    """Precedence of a dictionary layer (0 wins)."""
    out = F.when(F.lit(False), F.lit(0))
    for rank, name in enumerate(LAYERS):
        out = out.when(layer == name, F.lit(rank))
    return out.otherwise(F.lit(len(LAYERS)))


def token_collisions(dictionary: DataFrame) -> DataFrame:
    """Entity tags owned by several entities, and tokens standing for several values."""
    tag = F.regexp_extract("token", r"_(?:ORG|PERSON)_([A-Z2-7]{12})_[A-Z2-7]{12}$", 1)
    tags = (
        dictionary.withColumn("tag", tag).filter("tag <> ''").groupBy("tag")
        .agg(F.count_distinct("entity_id").alias("owners")).filter("owners > 1")
        .select(F.lit("entity-tag").alias("problem"), F.col("tag").alias("token"), "owners")
    )
    tokens = (
        dictionary.groupBy("token").agg(F.count_distinct("value").alias("owners")).filter("owners > 1")
        .select(F.lit("token").alias("problem"), "token", "owners")
    )
    return tags.unionByName(tokens)


def route_fail_closed(df: DataFrame, fail_closed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split gated texts into (forwarded, blocked).

    A text over a safety limit, or with leaks under the closed policy, is blocked; open policy
    forwards it with a warning count.
    """
    marked = df.withColumn("outcome", outcome(fail_closed)).withColumn("warnings", F.size("leaks"))
    return marked.filter("outcome = 'forwarded'"), marked.filter("outcome = 'blocked'")


def outcome(fail_closed: bool = True) -> Column:
    """Routing decision of a gated row."""
    leaking = (F.size("leaks") > 0) & F.lit(fail_closed)
    return F.when(F.col("over_limit") | leaking, "blocked").otherwise("forwarded")


def preview(redacted: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Findings for review: offsets, surrogate, origin and the hash of the reviewed text."""
    return redacted.select(*keys, F.sha2(F.col(text_col), 256).alias("text_sha256"), F.explode("spans").alias("s")).select(
        *keys, "text_sha256", "s.start", "s.end", F.col("s.token").alias("surrogate"), "s.name", "s.kind",
        "s.confidence",
        F.when(F.col("s.source") == "user-selected", "user").when(
            F.col("s.authority") == "registry", "registry").otherwise("detected").alias("origin"), "s.found",
    )


def user_forms(values: DataFrame) -> DataFrame:
    """Values a user selected, as registry-strength forms."""
    return values.select(
        *[c for c in values.columns if c != "value"], F.trim("value").alias("value"),
        F.lit("USER_SELECTED").alias("name"), F.lit("user-selected").alias("source"),
        F.lit("custom").alias("kind"), F.lit("exact").alias("confidence"), F.lit("registry").alias("authority"),
    ).filter("value <> ''")


# ------------------------------------------------------------------- R5, R6
def redact_query_strings(df: DataFrame, keys: Sequence[str], url_col: str, redactor: Redactor) -> DataFrame:
    """Redact each decoded query component; only changed components are re-encoded."""
    keys = list(keys)
    query = F.regexp_extract(F.col(url_col), r"^[^?#]*\?([^#]*)", 1)
    segments = df.select(*keys, F.posexplode(F.split(query, "&")).alias("seg", "raw"))
    eq = F.instr("raw", "=")
    parts = segments.select(*keys, "seg", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.when(eq == 0, F.col("raw")).otherwise(
            F.substring(F.col("raw"), F.lit(1), eq - 1)).alias("wire")),
        F.struct(F.lit(1).alias("part"), F.when(eq > 0, F.substring(
            F.col("raw"), eq + 1, F.length("raw"))).alias("wire")),
    )).alias("p")).select(*keys, "seg", "p.part", "p.wire").filter("wire is not null")
    decoded = parts.withColumn("decoded", decode_query(F.col("wire")))
    done = redactor.redact_text(decoded, [*keys, "seg", "part"], "decoded")
    wire = F.when(F.size("hits") > 0, encode_query(F.col("redacted"))).otherwise(F.col("wire"))
    rebuilt = done.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("seg", "part", wire.alias("wire")))).alias("c"),
        F.sum(F.size("hits")).alias("redacted_values"),
    )
    joined = F.aggregate("c", F.lit(""), lambda acc, p: F.concat(
        acc, F.when(p.part == 1, "=").when(p.seg > 0, "&").otherwise(""), p.wire))
    head = F.regexp_extract(F.col(url_col), r"^([^?#]*\?)[^#]*", 1)
    tail = F.regexp_extract(F.col(url_col), r"(#.*)$", 1)
    return df.join(rebuilt, keys, "left").withColumn(
        "redacted_url",
        F.when(head == "", F.col(url_col)).otherwise(F.concat(head, joined, tail)),
    ).drop("c")


def redact_headers(df: DataFrame, keys: Sequence[str], name_col: str, value_col: str,
                   redactor: Redactor) -> DataFrame:
    """Redact header rows except the credentials the request itself needs; paths are not kept."""
    exempt = F.lower(F.col(name_col)).isin(fixed.EXEMPT_HEADERS)
    open_rows = df.filter(exempt).withColumn("redacted", F.col(value_col)).withColumn("redacted_values", F.lit(0))
    done = redactor.redact_text(df.filter(~exempt), [*keys, name_col], value_col, preserve_paths=False)
    done = done.withColumn("redacted_values", F.size("hits")).drop("hits")
    return done.unionByName(open_rows)
