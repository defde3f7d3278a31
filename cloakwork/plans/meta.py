"""Counts over request bodies, response bodies and event streams (values-free)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _items(v: Column, path: str, ddl: str) -> Column:
    return F.try_variant_get(v, path, f"array<{ddl}>")


def _count(arr: Column, test=None) -> Column:
    if test is None:
        return F.when(arr.isNotNull(), F.size(arr))
    return F.when(arr.isNotNull(), F.size(F.filter(arr, lambda x: F.coalesce(test(x), F.lit(False)))))


def request_meta(df: DataFrame, keys: Sequence[str], body_col: str = "body", wire_col: str = "wire") -> DataFrame:
    """Messages, tools, tool results and function calls per request, by wire."""
    v = F.try_parse_json(F.col(body_col))
    wire = F.col(wire_col)
    # role and type are read apart from content: content may be text or blocks
    roles = _items(v, "$.messages", "struct<role:string>")
    blocks = _items(v, "$.messages", "struct<content:variant>")
    inputs = _items(v, "$.input", "struct<type:string>")
    results = F.aggregate(
        F.coalesce(blocks, F.array().cast("array<struct<content:variant>>")), F.lit(0),
        lambda acc, m: acc + F.coalesce(F.size(F.filter(
            F.try_variant_get(m.content, "$", "array<struct<type:string>>"), lambda b: b.type == "tool_result")), F.lit(0)))
    chatty = wire.isin("anthropic", "openai-chat")
    return df.select(
        *keys, wire_col,
        F.try_variant_get(v, "$.model", "variant").isNotNull().alias("model_set"),
        _count(_items(v, "$.tools", "variant")).alias("tool_count"),
        F.when(chatty, _count(roles)).alias("message_count"),
        F.when(wire == "anthropic", results).when(wire == "openai-chat", _count(roles, lambda m: m.role == "tool"))
        .alias("tool_result_count"),
        F.when(wire == "openai-responses", _count(inputs)).alias("input_count"),
        F.when(wire == "openai-responses", _count(inputs, lambda i: i.type == "function_call")).alias("function_call_count"),
        F.when(wire == "openai-responses", _count(inputs, lambda i: i.type == "function_call_output"))
        .alias("function_output_count"),
    )


def response_meta(df: DataFrame, keys: Sequence[str], body_col: str = "body", wire_col: str = "wire") -> DataFrame:
    """Content blocks, tool uses, choices and outputs per complete response, by wire."""
    v = F.try_parse_json(F.col(body_col))
    wire = F.col(wire_col)
    content = _items(v, "$.content", "struct<type:string>")
    output = _items(v, "$.output", "struct<type:string>")
    return df.select(
        *keys, wire_col,
        F.when(wire == "anthropic", _count(content)).alias("content_count"),
        F.when(wire == "anthropic", _count(content, lambda b: b.type == "text")).alias("text_blocks"),
        F.when(wire == "anthropic", _count(content, lambda b: b.type == "tool_use")).alias("tool_uses"),
        F.when(wire == "openai-chat", _count(_items(v, "$.choices", "variant"))).alias("choice_count"),
        F.when(wire == "openai-responses", _count(output)).alias("output_count"),
        F.when(wire == "openai-responses", _count(output, lambda i: i.type == "function_call")).alias("function_calls"),
    )


def sse_meta(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event types and fragment kinds per stream, from parsed records ``(keys, seq, data)``."""
    v = F.try_parse_json(F.col("data"))
    get = lambda p: F.try_variant_get(F.col("v"), p, "string")
    rows = records.withColumn("v", v).filter("v is not null")
    calls = F.try_variant_get(F.col("v"), "$.choices", "array<struct<delta:struct<tool_calls:array<variant>>>>")
    chat = F.aggregate(F.coalesce(calls, F.array().cast("array<struct<delta:struct<tool_calls:array<variant>>>>")), F.lit(0),
                       lambda acc, c: acc + F.greatest(F.coalesce(F.size(c.delta.tool_calls), F.lit(0)), F.lit(0)))
    kind = get("$.type")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("data_lines"), F.count_distinct(kind).alias("event_types"),
        F.count_if((kind == "content_block_start") & (get("$.content_block.type") == "tool_use")).alias("tool_use_starts"),
        F.count_if((kind == "content_block_delta") & (get("$.delta.type") == "input_json_delta")).alias("input_json_deltas"),
        F.count_if((kind == "response.output_item.added") & (get("$.item.type") == "function_call")).alias("function_call_starts"),
        F.count_if(kind == "response.function_call_arguments.delta").alias("function_argument_deltas"),
        F.count_if(kind == "response.output_text.delta").alias("text_deltas"),
        F.sum(chat).alias("chat_tool_deltas"),
    )
