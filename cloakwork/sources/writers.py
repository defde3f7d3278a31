"""Sinks: managed registry files and the outputs of a redaction run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.text import normalize_form


def render_registry(entries: DataFrame) -> DataFrame:
    """Managed entries of approved rows ``(id, protection_kind, entity_type, type, value, forms, status)``.

    An entity keeps its forms; each other form of a literal becomes its own entry with a derived id.
    """
    approved = entries.filter("status = 'approved'")
    rows = approved.withColumnRenamed("forms", "_forms")
    entity = rows.filter("protection_kind = 'entity'").withColumn("_f", F.explode_outer("_forms"))
    entity = entity.withColumn("_same", normalize_form(F.col("_f.value")) == normalize_form(F.col("value")))
    entity = entity.groupBy("id", "entity_type", "value").agg(
        F.collect_list(F.when(~F.col("_same"), F.col("_f"))).alias("forms")
    ).select("id", F.lit("entity").alias("protectionKind"), F.col("entity_type").alias("entityType"),
             F.col("value").alias("canonicalValue"), F.lit(None).cast("string").alias("value"),
             F.lit(None).cast("string").alias("semanticType"), "forms")
    literal = rows.filter("protection_kind = 'literal'")
    main = literal.select("id", "value", "type")
    extra = literal.select("id", "type", F.col("value").alias("_main"), F.explode("_forms").alias("_f")).filter(
        normalize_form(F.col("_f.value")) != normalize_form(F.col("_main"))
    ).select(
        F.concat("id", F.lit(":form:"), F.substring(F.sha2(normalize_form(F.col("_f.value")), 256), 1, 16)).alias("id"),
        F.col("_f.value").alias("value"), "type")
    flat = main.unionByName(extra).select(
        "id", F.lit("literal").alias("protectionKind"), F.lit(None).cast("string").alias("entityType"),
        F.lit(None).cast("string").alias("canonicalValue"), "value", F.col("type").alias("semanticType"),
        F.lit(None).cast("array<struct<value:string,kind:string,boundary:string>>").alias("forms"))
    return entity.unionByName(flat)


def write_registry(entries: DataFrame, path: str, revision: str, generated_at: str, mode: str = "error",
                   max_bytes: int = 16_000_000) -> None:
    """Write rendered entries as managed registry JSON files of about ``max_bytes``.

    Entries are dealt to documents by the hash of their id, as many as their bytes need.  Each
    document is complete; the loader reads a folder of them as one registry, so a large registry
    never passes through one task or one row.
    """
    entry = F.struct("id", "protectionKind", "entityType", "canonicalValue", "value", "semanticType", "forms")
    size = entries.agg(F.sum(F.octet_length(F.to_json(entry))).alias("bytes")).first()["bytes"] or 0
    documents = -(-size // max_bytes) or 1
    parts = entries.groupBy(F.pmod(F.xxhash64("id"), F.lit(documents)).alias("_part")).agg(F.collect_list(entry).alias("entries"))
    parts.select(
        F.lit(fixed.REGISTRY_SCHEMA).alias("schema"), F.lit(revision).alias("revision"),
        F.lit("cloakwork").alias("generatedBy"), F.lit(generated_at).alias("generatedAt"), "entries",
    ).write.mode(mode).option("maxRecordsPerFile", 1).json(path)


def write_outputs(redacted: DataFrame, dictionary: DataFrame | None, out_dir: str, restricted_dir: str | None = None,
                  partition_by: str | None = None, capture_values: bool = False, mode: str = "error") -> None:
    """Write the redacted corpus and its findings; values are written only on request.

    The dictionary goes to the restricted folder, never next to the corpus.
    """
    corpus = redacted.drop("spans", "known", "text", "leaks")
    writer = corpus.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{out_dir}/corpus")
    keys = [c for c in corpus.columns if c not in ("redacted", "over_limit")]
    spans = redacted.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*")
    if not capture_values:
        spans = spans.withColumn("value_sha256", F.sha2("value", 256)).drop("value")
    spans.write.mode(mode).parquet(f"{out_dir}/findings")
    if dictionary is not None:
        if not restricted_dir:
            raise ValueError("the dictionary needs a restricted folder of its own")
        dictionary.write.mode(mode).parquet(f"{restricted_dir}/dictionary")
