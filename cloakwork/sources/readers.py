"""Readers of protected values and of request, response and analyzer logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloakwork.functions import fixed
from cloakwork.functions.text import fold_ws, normalize_form, pin, trim_ws
from cloakwork.operators.spans import MARK

# ------------------------------------------------------------------- S1 dotenv
_NAME = r"(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*"
_QUOTED = r'"((?:[^"\\]|\\(?s:.))*+)("|\z)[^\n]*' + r"|'((?:[^'\\]|\\(?s:.))*+)('|\z)[^\n]*"
# One entry: quoted over lines | bare to the end of the line.  Comment and other lines are
# consumed whole, so a quoted block never starts inside them.
ENV_ENTRY = rf"(?m)^[ \t]*(?:{_NAME}(?:{_QUOTED}|([^\n]*))|[^\n]*)$"


# A bare value up to its comment: a hash at the start or behind white space, outside quotes.
# All loops are possessive, so no value length can exhaust the stack.
_BARE = (
    rf"""^((?:[^"'#\\]++|\\.|\\|(?<=[^{fixed.WS}])\#|"(?:[^"\\]|\\.)*+(?:"|$)|'(?:[^'\\]|\\.)*+(?:'|$))*+)(?:\#.*)?$"""
)


def parse_dotenv(text: Column) -> Column:
    """``array<struct<name,value>>`` of one env file."""
    plain = F.regexp_replace(text, "\r\n", "\n")
    entries = F.regexp_extract_all(plain, F.lit(ENV_ENTRY), F.lit(0))

    def parsed(entry: Column) -> Column:
        name = F.regexp_extract(entry, rf"^[ \t]*{_NAME}", 1)
        rest = F.regexp_replace(entry, rf"^[ \t]*{_NAME}", "")
        double = F.regexp_extract(rest, r'(?s)^"((?:[^"\\]|\\.)*+)', 1)
        single = F.regexp_extract(rest, r"(?s)^'((?:[^'\\]|\\.)*+)", 1)
        # an escape pair is replaced as a unit, so an escaped backslash never escapes its neighbour
        unescaped = F.regexp_replace(double, r'\\(["\\$])', f"{MARK}$1")
        for code, char in (("n", "\n"), ("r", "\r"), ("t", "\t")):
            unescaped = F.regexp_replace(unescaped, rf"(?<!{MARK})\\{code}", char)
        unescaped = F.regexp_replace(unescaped, MARK, "")
        bare = trim_ws(F.regexp_replace(rest, _BARE, "$1"))
        return F.struct(name.alias("name"), F.when(rest.startswith('"'), unescaped).when(
            rest.startswith("'"), single).otherwise(bare).alias("value"))

    return F.filter(F.transform(entries, parsed), lambda e: e["name"] != "")


HIDDEN_BYTES = 16_000_000     # env files with dotted names that may be read by the driver


def _listed(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list]:
    """Files under the paths: names that Spark's readers list, and files they skip (leading dot or underscore)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen, hidden = [], []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        for found in fs.globStatus(where) or []:
            for f in fs.listStatus(found.getPath()):
                if f.isFile():
                    if f.getPath().getName()[0] in "._":
                        hidden.append((fs, f))
                    else:
                        seen.append(f.getPath().toString())
    return seen, hidden


def load_dotenv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, pos, name, value) of all env files under the paths.

    Spark's file sources skip names with a leading dot, as ``.env`` has.  Such files are few and small, so
    the driver reads them, up to ``HIDDEN_BYTES``; beyond that they must be stored under other names.
    """
    seen, hidden = _listed(spark, [paths] if isinstance(paths, str) else list(paths))
    if (size := sum(f.getLen() for _, f in hidden)) > HIDDEN_BYTES:
        raise ValueError(f"{size} bytes of env files with dotted names; store them under names that Spark lists")
    read = spark._jvm.org.apache.commons.io.IOUtils.toString
    dotted = []
    for fs, f in hidden:
        stream = fs.open(f.getPath())
        try:
            dotted.append((f.getPath().toString(), read(stream, "UTF-8")))
        finally:
            stream.close()
    files = spark.createDataFrame(dotted, "path string, value string")
    if seen:
        files = files.unionByName(spark.read.text(seen, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))
    return files.select("path", F.posexplode(parse_dotenv(F.col("value"))).alias("pos", "e")).select("path", "pos", "e.name", "e.value")


# ------------------------------------------------------------- S2, S12 env tables
def load_reason(name: Column, value: Column, min_len: int = fixed.MIN_REGISTRY_LEN, mode: str = "all") -> Column:
    """Why a (name, value) pair is not loaded, or null."""
    secretish = ~F.upper(name).isin(fixed.SHELL_NAMES) & name.rlike("(?i)" + fixed.SECRETISH_ENV)
    filtered = ~secretish if mode == "secret-ish" else F.lit(False)
    return (
        F.when(value.isNull() | (value == "") | name.isNull() | (name == ""), "empty")
        .when(filtered, "name-filtered")
        .when(F.length(value) < min_len, "too-short")
    )


def load_env_snapshot(df: DataFrame, mode: str = "secret-ish") -> DataFrame:
    """Name/value rows of a process environment that the mode admits."""
    return df.filter(F.coalesce(load_reason(F.col("name"), F.col("value"), 0, mode), F.lit("")) == "")


def admit_min_len(df: DataFrame, n: int = fixed.MIN_REGISTRY_LEN) -> DataFrame:
    """Non-empty values of at least ``n`` characters."""
    return df.filter((F.col("value") != "") & (F.length("value") >= n))


def mark_load(df: DataFrame, order: Sequence[str], min_len: int = fixed.MIN_REGISTRY_LEN, mode: str = "all",
              identity: Sequence[str] = ("source", "name", "value")) -> DataFrame:
    """Add ``reason``: null for loaded rows, first-wins ``duplicate`` per identity."""
    first = df.withColumn("reason", load_reason(F.col("name"), F.col("value"), min_len, mode))
    ok = F.col("reason").isNull()
    # only admitted rows are ranked; the others, however alike, are spread
    alone = F.when(~ok, F.xxhash64(*order))
    rank = F.row_number().over(W.partitionBy(*identity, ok, alone).orderBy(*order))
    return first.withColumn("_rn", rank).withColumn(
        "reason", F.when(ok & (F.col("_rn") > 1), "duplicate").otherwise(F.col("reason"))).drop("_rn")


def source_load_stats(marked: DataFrame) -> DataFrame:
    """Counts per source of loaded and skipped rows."""
    def n(reason: str) -> Column:
        return F.count_if(F.col("reason") == reason)
    return marked.groupBy("source").agg(
        F.count_if(F.col("reason").isNull()).alias("loaded"), n("empty").alias("skipped_empty"),
        n("too-short").alias("skipped_too_short"), n("duplicate").alias("skipped_duplicate"),
        n("name-filtered").alias("skipped_name_filter"),
    )


# ------------------------------------------------------------------ S3 secret dumps
def load_secret_dumps(df: DataFrame, order: Sequence[str], json_col: str = "dump",
                      min_len: int = fixed.MIN_REGISTRY_LEN) -> tuple[DataFrame, DataFrame]:
    """JSON objects of name to string, one per config row.

    Returns (loaded values, rejected configs).  Non-strings are dropped, a document that is no
    object is rejected, and a value seen in an earlier config is not loaded again.
    """
    parsed = df.withColumn("_v", F.try_parse_json(F.col(json_col))).withColumn(
        "status",
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), "unsupported_json").otherwise("ok"))
    rejected = parsed.filter("status <> 'ok'").drop("_v", json_col)
    pairs = parsed.filter("status = 'ok'").lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("_v").outer())
    ).filter(F.schema_of_variant("value") == "STRING").select(
        *order, F.lit("secret-dump").alias("source"), F.col("key").alias("name"),
        F.col("value").cast("string").alias("value"))
    marked = mark_load(pairs, [*order, "name"], min_len, identity=("value",))
    return marked.filter("reason is null").drop("reason"), rejected


# --------------------------------------------------------------- S4 managed registry
MANAGED_SCHEMA = (
    "schema string, revision string, generatedBy string, generatedAt string, entries array<struct<"
    "id:string,protectionKind:string,entityType:string,canonicalValue:string,value:string,"
    "semanticType:string,forms:array<struct<value:string,kind:string,boundary:string>>>>"
)


class RegistryConflict(ValueError):
    """A managed registry declares an id twice or gives one surface two owners."""


def managed_entries(files: DataFrame) -> DataFrame:
    """One row per entry of ``(path, …managed fields)`` rows, with a ``valid`` flag."""
    entry = files.select("path", "schema", "revision", "generatedBy", "generatedAt",
                         F.posexplode("entries").alias("pos", "e"))
    header = (
        (F.col("schema") == fixed.REGISTRY_SCHEMA)
        & F.col("revision").rlike(r"^[A-Za-z0-9._:-]{1,128}$") & (F.col("generatedBy") != "")
        & F.col("generatedAt").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$")
    )
    literal = (F.col("e.protectionKind") == "literal") & (F.trim("e.value") != "") & (
        F.col("e.semanticType").isNull() | (F.col("e.semanticType") != ""))
    entity = (
        (F.col("e.protectionKind") == "entity") & F.col("e.entityType").isin("organization", "person")
        & (F.trim("e.canonicalValue") != "") & F.col("e.forms").isNotNull()
        & F.forall("e.forms", lambda f: (F.trim(f.value) != "") & f.kind.isin(fixed.FORM_KINDS)
                   & f.boundary.isin(fixed.FORM_BOUNDARIES))
    )
    ok = F.coalesce(header & (F.trim("e.id") != "") & (literal | entity), F.lit(False))
    return entry.select("path", "revision", "pos", "e.*", ok.alias("valid"))


def managed_forms(entries: DataFrame) -> DataFrame:
    """Matching forms of managed entries; a form equal to the canonical value is folded into it."""
    canonical = F.coalesce(F.when(F.col("protectionKind") == "entity", F.col("canonicalValue")), F.col("value"))
    listed = F.concat(
        F.array(F.struct(canonical.alias("value"), F.lit("substring").alias("boundary"), F.lit(0).alias("rank"))),
        F.transform(F.coalesce("forms", F.array().cast("array<struct<value:string,kind:string,boundary:string>>")),
                    lambda f: F.struct(f.value.alias("value"), f.boundary.alias("boundary"),
                                       F.when(f.boundary == "substring", 1).otherwise(2).alias("rank"))),
    )
    rows = entries.select(
        F.col("id").alias("entity_id"), F.col("entityType").alias("entity_type"),
        F.col("protectionKind").alias("protection_kind"), canonical.alias("canonical"), F.explode(listed).alias("f"),
    ).withColumn("norm", normalize_form(F.col("f.value")))
    # the canonical surface wins over an equal form, a substring form over an equal token form
    return rows.groupBy("entity_id", "entity_type", "protection_kind", "canonical", "norm").agg(
        F.min_by("f", F.struct("f.rank", "f.value")).alias("f")
    ).select(
        "f.value", "entity_id", "entity_type", "protection_kind", "canonical", "f.boundary",
        F.concat(F.lit("managed-registry:"), "entity_id").alias("name"),
        F.lit("managed-registry-file").alias("source"), F.lit("custom").alias("kind"),
        F.lit("exact").alias("confidence"), F.lit("registry").alias("authority"),
        F.concat("entity_id", F.lit(":"), F.substring(F.sha2("norm", 256), 1, 16)).alias("form_id"), "norm",
    )


def registry_conflicts(entries: DataFrame, forms: DataFrame) -> DataFrame:
    """Ids declared twice, and normalized surfaces with more than one owner."""
    ids = entries.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit("duplicate-id").alias("problem"), F.col("id").alias("subject"), "n")
    owners = forms.groupBy("norm").agg(F.count_distinct("entity_id").alias("n")).filter("n > 1").select(
        F.lit("shared-surface").alias("problem"), F.sha2("norm", 256).alias("subject"), "n")
    return ids.unionByName(owners)


def load_managed_registry(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Forms of managed registry files; malformed entries and conflicts are fatal."""
    files = spark.read.schema(MANAGED_SCHEMA).json(paths, multiLine=True).withColumn(
        "path", F.col("_metadata.file_path"))
    entries = managed_entries(files)
    bad = entries.filter(~F.col("valid")).select("path", "pos").limit(1).collect()
    if bad:
        raise RegistryConflict(f"invalid managed registry entry {bad[0]['pos']} in {bad[0]['path']}")
    forms = managed_forms(entries)
    clash = registry_conflicts(entries, forms).limit(1).collect()
    if clash:
        raise RegistryConflict(f"{clash[0]['problem']}: {clash[0]['subject']}")
    return forms


# ------------------------------------------------------------------- S5 CSV import
CSV_COLUMNS = ["protection_kind", "entity_type", "matter_id", "type", "value", "forms", "status"]


def _key(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim_ws(col)), rf"[{fixed.WS}-]+", "_"), "[^a-z0-9_]", "")


def check_import(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate import rows with :data:`CSV_COLUMNS` and ``row``; returns (entries, rejects)."""
    out = rows
    for c in CSV_COLUMNS:
        out = out.withColumn(c, F.coalesce(fold_ws(F.col(c)), F.lit("")) if c in out.columns else F.lit(""))
    loose = F.lower(F.regexp_replace("type", rf"[{fixed.WS}-]+", "_"))
    out = out.withColumn("type", F.when(F.col("type") == "", fixed.REGISTRY_TYPE_DEFAULT).otherwise(loose))
    out = out.withColumn("status", F.when(F.col("status") == "", "approved").otherwise(
        F.lower(F.regexp_replace("status", rf"[{fixed.WS}-]+", "_"))))
    out = out.withColumn("protection_kind", F.when(F.col("protection_kind") == "", "literal").otherwise(
        _key(F.col("protection_kind"))))
    out = out.withColumn("entity_type", _key(F.col("entity_type")))
    parts = F.transform(
        F.when(F.col("forms") == "", F.array().cast("array<string>")).otherwise(F.split("forms", ";")),
        lambda f: F.transform(F.split(f, "~"), fold_ws))
    out = out.withColumn("_p", parts)
    bad_form = F.when(F.exists("_p", lambda p: F.size(p) != 3), "form must be value~kind~boundary").when(
        F.exists("_p", lambda p: F.get(p, F.lit(0)) == ""), "form value is blank").when(
        F.exists("_p", lambda p: ~F.get(p, F.lit(1)).isin(fixed.FORM_KINDS)), "form kind is not supported").when(
        F.exists("_p", lambda p: ~F.get(p, F.lit(2)).isin(fixed.FORM_BOUNDARIES)), "form boundary is not supported")
    forms = F.transform("_p", lambda p: F.struct(
        F.get(p, F.lit(0)).alias("value"), F.get(p, F.lit(1)).alias("kind"), F.get(p, F.lit(2)).alias("boundary"),
        F.lower(F.get(p, F.lit(0))).alias("norm")))
    unique = F.aggregate(forms, F.filter(forms, lambda f: F.lit(False)), lambda acc, f: F.when(
        F.exists(acc, lambda x: x.norm == f.norm), acc).otherwise(F.concat(acc, F.array(f))))
    out = out.withColumn("_forms", unique)
    entity = F.col("protection_kind") == "entity"
    reason = (
        F.when(F.col("value") == "", "value is blank")
        .when(~F.col("type").isin(fixed.REGISTRY_TYPES), "type is not supported")
        .when(~F.col("status").isin(fixed.REGISTRY_STATUSES), "status is not supported")
        .when(~F.col("protection_kind").isin("literal", "entity"), "protection kind is not supported")
        .when(entity & ~F.col("entity_type").isin("organization", "person"), "entity type is not supported")
        .when(bad_form.isNotNull(), bad_form)
        .when(F.size("_forms") > fixed.REGISTRY_MAX_FORMS, "too many forms")
        .when(~entity & F.exists("_forms", lambda f: f.boundary != "substring"),
              "literal forms must use substring boundaries")
    )
    out = out.withColumn("reason", reason)
    entries = out.filter("reason is null").select(
        *[c for c in rows.columns if c not in CSV_COLUMNS], "protection_kind",
        F.when(entity, F.col("entity_type")).alias("entity_type"), "matter_id", "type", "value",
        F.transform("_forms", lambda f: F.struct(f.value.alias("value"), f.kind.alias("kind"),
                                                 f.boundary.alias("boundary"))).alias("forms"), "status")
    rejects = out.filter("reason is not null").select(
        *[c for c in rows.columns if c not in CSV_COLUMNS], "reason")
    return entries, rejects


def _column_of(cell: str | None) -> str | None:
    """Import column that a header cell names, if any."""
    key = "_".join("".join(c if c.isalnum() or c == "_" else " " if c in "- \t\n" else "" for c in (cell or "").strip().lower()).split())
    return key if key in CSV_COLUMNS else None


def import_registry_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Registry entries and rejected rows of CSV files, with their ``row`` in the file.

    The first row is a header if one of its cells names an import column; without one the columns
    are value and status.  Blank rows do not count.  All files of a path have the same columns.
    """
    raw = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True, inferSchema=False)
    cells = raw.columns
    filled = F.coalesce(*[F.when(trim_ws(F.col(c)) != "", F.lit(True)) for c in cells], F.lit(False))
    # a file is one partition (quoted cells may hold line breaks), so its rows number in order
    numbered = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id()).filter(filled).withColumn(
        "row", F.row_number().over(W.partitionBy("_file").orderBy("_at")))
    first = numbered.orderBy("_file", "row").limit(1).collect()
    named = [_column_of(first[0][c]) for c in cells] if first else []
    header = any(named)
    columns = named if header else ["value", "status"][: len(cells)]
    rows = numbered.filter("row > 1") if header else numbered
    return check_import(rows.select("row", *[F.col(c).alias(n) for c, n in zip(cells, columns) if n]))


# -------------------------------------------------------------------- S6 bodies
def wire_of(path: Column) -> Column:
    """Provider wire from the request path."""
    return (
        F.when(path.contains("/chat/completions"), "openai-chat").when(path.contains("/responses"), "openai-responses")
        .when(path.contains("/messages"), "anthropic").otherwise("unknown")
    )


def read_bodies(df: DataFrame, path_col: str = "path", body_col: str = "body") -> DataFrame:
    """Add ``wire`` and the safe ``model`` field of the body."""
    model = F.try_variant_get(F.try_parse_json(F.col(body_col)), "$.model", "string")
    return df.withColumn("wire", wire_of(F.col(path_col))).withColumn("model", model)


# -------------------------------------------------------------------- S7 leaves
def flatten_leaves(df: DataFrame, keys: Sequence[str], body_col: str = "body") -> DataFrame:
    """String leaves ``(keys, path, kind, text)``: object keys and string values, by JSON path.

    One bracket-stack pass inside each row, whatever the nesting; invalid JSON is a single raw
    leaf.  Keys that are no plain names stand quoted in brackets in a path.
    """
    from cloakwork.operators.bodies import literals, path_of

    return df.select(*keys, pin(literals(F.col(body_col))).alias("_ls")).select(*keys, F.explode("_ls").alias("_l")).select(
        *keys, path_of(F.col("_l.steps")).alias("path"), F.col("_l.kind").alias("kind"), F.col("_l.text").alias("text"))


# ----------------------------------------------------------------------- S8 SSE
def parse_sse(df: DataFrame, keys: Sequence[str], stream_col: str = "stream") -> DataFrame:
    """Records ``(keys, seq, event, data, done)`` of event streams.

    Several ``data`` lines are joined by a line feed, the last ``event`` line names the record.
    """
    plain = F.regexp_replace(F.col(stream_col), "\r\n|\r", "\n")
    # like a streaming reader, a record ends at the first blank line
    records = df.select(*keys, F.posexplode(F.split(plain, "\n\n")).alias("seq", "record"))
    records = records.filter("record <> ''")
    lines = F.split("record", "\n")

    def fields(name: str) -> Column:
        hit = F.filter(lines, lambda x: x.startswith(f"{name}:") | (x == name))
        return F.transform(hit, lambda x: F.regexp_replace(x, f"^{name}:? ?", ""))

    data = F.array_join(fields("data"), "\n")
    return records.select(
        *keys, "seq", F.get(F.reverse(fields("event")), F.lit(0)).alias("event"),
        F.when(data != "", data).alias("data"),
    ).withColumn("done", F.coalesce(F.trim("data") == "[DONE]", F.lit(False)))


# ------------------------------------------------------------------ S9 analyzer
def read_analyzer_spans(df: DataFrame, threshold: float = fixed.SCORE_THRESHOLD,
                        allow: Sequence[str] | None = None, source: str = "pii-analyzer") -> DataFrame:
    """Findings from external offset spans ``(…, text, entity_type, start, end, score)``."""
    from cloakwork.operators.detect import gate_spans

    return gate_spans(df, threshold, allow).withColumn("source", F.lit(source))


def read_analyzer_entities(df: DataFrame, keys: Sequence[str], threshold: float = fixed.SCORE_THRESHOLD,
                           allow: Sequence[str] | None = None, source: str = "pii-medical", order: Sequence[str] = ()) -> DataFrame:
    """Findings from external entities ``(…, text, label, entity_type, canonical_label, confidence)``.

    Of equally confident mentions of a value the first by ``order`` names it, then the least label.
    """
    label = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("canonical_label", "entity_type", "label")])
    out = df.withColumn("_label", label).withColumn("value", trim_ws(F.col("text"))).filter(
        (F.col("text") != "") & F.col("_label").isNotNull() & F.col("confidence").isNotNull()
        & ~F.isnan("confidence") & (F.col("confidence") >= threshold)
        & (F.length("value") >= fixed.MIN_PII_LEN))
    if allow:
        out = out.filter(F.upper("_label").isin([a.upper() for a in allow]))
    best = out.groupBy(*keys, "value").agg(F.min_by(
        F.struct("_label", "confidence"), F.struct(-F.col("confidence"), *order, "_label")).alias("b"))
    return best.select(
        *keys, "value", F.translate(F.lower("b._label"), "_", "-").alias("rule"),
        F.when(F.col("b.confidence") >= fixed.HIGH_SCORE, "high").otherwise("probabilistic").alias("confidence"),
        F.lit(source).alias("source"), F.lit("pii").alias("kind"))
