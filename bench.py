"""Throughput of the headline queries; prints one JSON line.

BENCH_SF_DIR names the scale folder, BENCH_CPUS the local cores.  Every query runs whole tables
into a no-op sink; the time includes building and planning the query.  The tables are first dealt over as
many files as there are cores (not timed), as they would be on a cluster.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import all_queries, flagship  # noqa: E402
from catalog.base import KEY, TABLES, Tables  # noqa: E402
from cloakwork import get_session  # noqa: E402
from cloakwork.functions.surrogates import Surrogates  # noqa: E402
from cloakwork.operators import detect as D  # noqa: E402
from cloakwork.operators.match import Dictionary  # noqa: E402
from cloakwork.plans import redact as RD  # noqa: E402
from cloakwork.plans import restore as RS  # noqa: E402
from cloakwork.session import shared_folder  # noqa: E402

CATALOG = [
    "match_registry_join", "resolve_occurrences_rows", "resolve_occurrences_array", "span_overlap_join", "carry_forward",
    "detect_distinct_texts", "redact_json_bodies", "restore_json_detected", "flatten_leaves", "stats_totals",
    "stats_by_dimension", "stats_by_label", "hash_chain", "verify_chain", "daily_stats", "classify_environment",
    "structural_json_pairs", "designator_organizations", "redact_query_strings", "redact_bodies_structural", "redact_bodies_turns",
]


def registry(t: Tables, n: int):
    """The first ``n`` long words of the corpus by hash: values that really occur."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z]{9,})\b"), F.lit(1))).alias("value"))
    return words.distinct().orderBy(F.xxhash64("value")).limit(n)


def spread(spark, sf_dir: str, files: int) -> str:
    """The tables in several files each: a table in one row group would be read by a single task."""
    out = f"{shared_folder(spark)}/bench-in-{os.getpid()}"
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return out


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "0"})
    spark.sparkContext.setLogLevel("OFF")
    scale, sf_dir = os.path.basename(sf_dir).removeprefix("sf"), spread(spark, sf_dir, int(cpus))
    t = Tables(spark, sf_dir)
    sur = Surrogates(KEY)
    size = t.documents.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    sink(flagship(spark, sf_dir))  # warm-up: class loading and code caches

    times: dict[str, float] = {}
    rates: dict[str, dict[str, float]] = {}

    def timed(name: str, run, texts: bool = False) -> None:
        start = time.perf_counter()
        run()
        took = time.perf_counter() - start
        times[name] = round(took, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        if texts:
            rates[name] = {"docs_per_s": round(size["n"] / took), "mb_per_s": round(size["b"] / took / 1e6, 2)}

    docs = t.documents.select("doc_id", "lang", "text")
    timed("flagship", lambda: sink(flagship(spark, sf_dir)), True)
    timed("detect_all_rules", lambda: sink(D.detect(docs, ["doc_id"], "text", [*D.SECRET_RULES, *D.PII_RULES])), True)
    for n in (10, 100, 1000):
        # the registry is a table of its own, as it is in production
        path = f"{shared_folder(spark)}/bench-registry-{os.getpid()}-{n}"
        registry(t, n).write.mode("overwrite").parquet(path)
        holder: dict[str, RD.Redactor] = {}

        def prepare(path=path) -> None:
            holder["r"] = RD.Redactor(sur, D.PII_RULES, dictionary=Dictionary(spark.read.parquet(path)))

        timed(f"prepare_{n}", prepare)
        r = holder["r"]
        timed(f"redact_{n}", lambda r=r: sink(r.redact(docs, ["doc_id"]).select("doc_id", "redacted")), True)
        timed(f"redact_gate_{n}", lambda r=r: sink(
            r.gate(r.redact(docs, ["doc_id"]), ["doc_id"]).select("doc_id", "redacted", "leaks")), True)
        if n == 100:
            done = f"{shared_folder(spark)}/bench-redacted-{os.getpid()}"
            out = r.redact(docs, ["doc_id"])
            out.select("doc_id", "redacted", "spans").write.mode("overwrite").parquet(done)
            saved = spark.read.parquet(done)
            timed("restore_100", lambda saved=saved: sink(RS.restore_text(
                saved.select("doc_id", "redacted"), ["doc_id"], "redacted", RD.dictionary_of(saved, ["doc_id"]), ["doc_id"], sur
            ).select("doc_id", "restored")), True)
    by_name = {q.name: q for q in all_queries()}
    for name in CATALOG:
        timed(name, lambda name=name: sink(by_name[name].call(spark, sf_dir)))
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rates": rates, "sf": scale}))


if __name__ == "__main__":
    main()
