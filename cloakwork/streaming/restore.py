"""Streaming restore: tokens split over chunks or event fragments come back whole.

State per stream key is one short text tail, never longer than a token.  The fold itself is a few
lines of Python per chunk; Spark partitions, orders by micro-batch and keeps the state.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cloakwork.functions.surrogates import Surrogates

OUT_SCHEMA = "stream_id string, fragment string, seq bigint, kind string, text string, withheld bigint, residuals bigint"
POLICIES = ("all", "none", "detected")
RESTORED = Row("stream_id", "fragment", "seq", "kind", "text", "withheld", "residuals")
FRAGMENT = Row("stream_id", "fragment", "seq", "kind", "text")


def _by_seq(row: Row) -> tuple[bool, int]:
    return row.seq is None, row.seq or 0


class _StreamRestorer(StatefulProcessor):
    """Restore the fragments of one response as they come.

    State of a stream: its dictionary (one entry per token, looked up token by token), per fragment
    the possible token start that is held back and the raw text that residuals are looked for in,
    and the residuals counted so far.
    """

    def __init__(self, surrogates: Surrogates, policy: str) -> None:
        if policy not in POLICIES:
            raise ValueError(f"tool policy is one of {', '.join(POLICIES)}")
        self.patterns = (surrogates.pattern, surrogates.partial_pattern, surrogates.residual_pattern)
        self.policy, self.context = policy, len(surrogates.prefix) + LONGEST_TAIL

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "token string", "value string, layer string")
        self.tails = handle.getMapState("tails", "fragment string", "held string, near string")
        self.counted = handle.getMapState("counted", "token string", "times int")
        self.token, self.open, self.debris = (re.compile(p) for p in self.patterns)
        self.looked_up: dict[str, tuple[str, str] | None] = {}
        self.done: set[str] = set()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._learn(initialState.token, initialState.value, initialState.layer)

    def _learn(self, token: str, value: str, layer: str) -> None:
        # the layer that goes before wins, the first value of a layer stays
        if not self.entries.containsKey((token,)) or LAYERS.index(layer) < LAYERS.index(self.entries.getValue((token,))[1]):
            self.entries.updateValue((token,), (value, layer))
            self.looked_up.pop(token, None)

    def _entry(self, token: str) -> tuple[str, str] | None:
        """(value, layer) of a token, asked of the state once per micro-batch."""
        if token not in self.looked_up:
            self.looked_up[token] = self.entries.getValue((token,)) if self.entries.containsKey((token,)) else None
        return self.looked_up[token]

    def _restored(self, text: str, kind: str) -> tuple[str, int]:
        withheld = 0

        def one(m: re.Match) -> str:
            nonlocal withheld
            entry = self._entry(m.group(0))
            if entry is None:
                return m.group(0)
            value, layer = entry
            if kind == "tool" and (self.policy == "none" or (self.policy == "detected" and layer != "detected")):
                withheld += 1
                return m.group(0)
            return json.dumps(value, ensure_ascii=False)[1:-1] if kind == "tool" else value

        return self.token.sub(one, text), withheld

    def _residuals(self, near: str, ended: bool) -> int:
        """New residuals in the raw text; one that later text may still change waits for it."""
        fresh = 0
        for m in self.debris.finditer(near):
            settled = ended or m.end() + self.context <= len(near)
            if settled and m.group(0) not in self.done and self._entry(m.group(0)) is None:
                self.done.add(m.group(0))
                if not self.counted.containsKey((m.group(0),)):
                    self.counted.updateValue((m.group(0),), (1,))
                    fresh += 1
        return fresh

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # what this micro-batch has read of the state of its stream
        self.looked_up, self.done = {}, set()
        tails: dict[str, tuple[str, str] | None] = {}
        stored = set()
        for row in sorted(rows, key=_by_seq):
            fragment, text = row.fragment, row.text or ""
            if row.kind == "entry":
                self._learn(fragment, row.text, row.layer)
                continue
            if fragment not in tails:
                tails[fragment] = None
                if self.tails.containsKey((fragment,)):
                    tails[fragment] = self.tails.getValue((fragment,))
                    stored.add(fragment)
            held, near = tails[fragment] or ("", "")
            whole = held + text
            open_end = None if row.stop else self.open.search(whole)
            ready, held = (whole[: open_end.start()], whole[open_end.start():]) if open_end else (whole, "")
            restored, withheld = self._restored(ready, row.kind)
            near += text
            fresh = self._residuals(near, bool(row.stop))
            tails[fragment] = None if row.stop else (held, near[-2 * self.context:])
            if restored or withheld or fresh:
                yield RESTORED(key[0], fragment, row.seq, row.kind, restored, withheld, fresh)
        for fragment, tail in tails.items():
            if tail is not None:
                self.tails.updateValue((fragment,), tail)
            elif fragment in stored:
                self.tails.removeKey((fragment,))

    def close(self) -> None:
        return None


LONGEST_TAIL = 64      # characters of a token behind its prefix, and a few more
LAYERS = ("user", "registry", "detected", "permanent")
_ENTRY = ("stream_id", "token", "value", "layer")


def restore_stream(fragments: DataFrame, dictionary: DataFrame, surrogates: Surrogates, policy: str = "all") -> DataFrame:
    """Restore a stream of ``(stream_id, fragment, seq, kind, text, stop)`` rows before its sink.

    ``dictionary`` (stream_id, token, value, layer) is the state that streams start with; rows of kind
    ``entry`` (fragment: token, text: value, and a ``layer``) add to it on the way.  A stream restores
    what its own dictionary holds.  Values go into tool arguments under the tool ``policy``, escaped for
    the JSON string they stand in; ``withheld`` counts what stayed, ``residuals`` token-like remains
    without a mapping, once per stream.
    """
    rows = fragments if "layer" in fragments.columns else fragments.withColumn("layer", F.lit(None).cast("string"))
    rows = rows.select("stream_id", "fragment", F.col("seq").cast("bigint").alias("seq"), "kind", "text", "stop", "layer")
    return rows.groupBy("stream_id").transformWithState(
        _StreamRestorer(surrogates, policy), OUT_SCHEMA, "append", "None", dictionary.select(*_ENTRY).groupBy("stream_id"))


def restore_chunks(chunks: DataFrame, mapping: DataFrame, surrogates: Surrogates) -> DataFrame:
    """Restore a stream of ``(stream_id, seq, text, last)`` chunks: one fragment per stream."""
    one = chunks.select("stream_id", F.lit("").alias("fragment"), "seq", F.lit("text").alias("kind"), "text", F.col("last").alias("stop"))
    dictionary = mapping if "layer" in mapping.columns else mapping.withColumn("layer", F.lit("detected"))
    return restore_stream(one, dictionary, surrogates).select("stream_id", "seq", "text", "residuals")


class _FragmentJoiner(StatefulProcessor):
    """Regroup fragment text so that no emitted piece ends inside a possible token."""

    def __init__(self, partial: str) -> None:
        self.partial = partial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "text string")
        self.open = re.compile(self.partial)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.tail.get()
        tail = stored[0] if stored else ""
        for row in sorted(rows, key=_by_seq):
            whole = tail + (row.text or "")
            held = None if row.stop else self.open.search(whole)
            ready, tail = (whole[: held.start()], whole[held.start():]) if held else (whole, "")
            if ready:
                yield FRAGMENT(*key, row.seq, row.kind, ready)
        if tail:
            self.tail.update((tail,))
        elif stored:
            self.tail.clear()

    def close(self) -> None:
        return None


FRAGMENT_SCHEMA = "stream_id string, fragment string, seq bigint, kind string, text string"


def whole_fragments(fragments: DataFrame, surrogates: Surrogates) -> DataFrame:
    """Stateful regrouping of ``(stream_id, fragment, seq, kind, text, stop)`` rows."""
    return fragments.groupBy("stream_id", "fragment").transformWithState(
        _FragmentJoiner(surrogates.partial_pattern), FRAGMENT_SCHEMA, "append", "None")


# ------------------------------------------------------------- T2 fragments of records
def record_fragments(records: DataFrame, wire: Column) -> DataFrame:
    """Fragments of parsed records ``(stream_id, seq, data, done)`` by provider key.

    One row per text or tool-argument fragment, and a ``stop`` row where a block ends.
    """
    v = F.try_parse_json(F.col("data"))
    s = lambda p: F.try_variant_get(F.col("v"), p, "string")
    rows = records.withColumn("v", v).withColumn("wire", wire)
    kind, none = s("$.type"), F.array().cast("array<struct<fragment:string,kind:string,text:string,stop:boolean>>")
    frag = lambda key, k, text, stop=False: F.struct(
        key.alias("fragment"), F.lit(k).alias("kind"), text.alias("text"), F.lit(stop).alias("stop"))
    empty = F.lit("")
    index = F.coalesce(s("$.index"), F.lit("undefined"))
    a_text, a_tool = F.concat(F.lit("anthropic:"), index, F.lit(":text")), F.concat(F.lit("anthropic:"), index, F.lit(":partial_json"))
    anthropic = (
        F.when((kind == "content_block_delta") & (s("$.delta.type") == "input_json_delta"),
               F.array(frag(a_tool, "tool", s("$.delta.partial_json"))))
        .when((kind == "content_block_delta") & (s("$.delta.type") == "text_delta"), F.array(frag(a_text, "text", s("$.delta.text"))))
        .when(kind == "content_block_stop", F.array(frag(a_text, "text", empty, True), frag(a_tool, "tool", empty, True)))
    )
    choice = "array<struct<index:int,delta:struct<content:string,tool_calls:array<struct<index:int,function:struct<arguments:string>>>>>>"
    calls = "array<struct<index:int,function:struct<arguments:string>>>"
    chat = F.flatten(F.transform(
        F.try_variant_get(F.col("v"), "$.choices", choice),
        lambda c, i: F.concat(
            F.array(frag(F.concat(F.lit("openai-chat:"), F.coalesce(c.index, i).cast("string"), F.lit(":content")), "text", c.delta.content)),
            F.transform(F.coalesce(c.delta.tool_calls, F.array().cast(calls)), lambda t, j: frag(
                F.concat(F.lit("openai-chat:"), F.coalesce(c.index, i).cast("string"), F.lit(":tool:"),
                         F.coalesce(t.index, j).cast("string"), F.lit(":arguments")), "tool", t.function.arguments)))))
    item = F.coalesce(s("$.item_id"), s("$.output_index"), empty)
    r_text = F.concat(F.lit("openai-responses:"), item, F.lit(":"), F.coalesce(s("$.content_index"), empty), F.lit(":text"))
    r_tool = F.concat(F.lit("openai-responses:"), item, F.lit(":arguments"))
    responses = (
        F.when(kind == "response.output_text.delta", F.array(frag(r_text, "text", s("$.delta"))))
        .when(kind == "response.function_call_arguments.delta", F.array(frag(r_tool, "tool", s("$.delta"))))
        .when(kind == "response.output_text.done", F.array(frag(r_text, "text", empty, True)))
        .when(kind == "response.function_call_arguments.done", F.array(frag(r_tool, "tool", empty, True)))
    )
    chosen = F.coalesce(
        F.when(F.col("wire") == "anthropic", anthropic).when(F.col("wire") == "openai-chat", chat)
        .when(F.col("wire") == "openai-responses", responses), none)
    return rows.select("stream_id", "seq", F.explode(chosen).alias("f")).select("stream_id", "seq", "f.*").filter(
        "text is not null")


def joined_fragments(fragments: DataFrame) -> DataFrame:
    """Batch twin of the stateful regrouping: the full text of each fragment key."""
    return fragments.groupBy("stream_id", "fragment", "kind").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text")).filter("text <> ''")
