"""Time the headline queries and print one JSON line.

The derived inputs are written once, as they would lie on a cluster: results and truth with a
column for each field and in buckets of documents, the rest in many files. Each query then runs
on the stored inputs into a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from fieldeval.plans.catalog import CATALOG
from fieldeval.operators.shredded import save_by_document, shred
from fieldeval.plans.derive import Inputs
from fieldeval.schema import DEFAULT_SPEC

HEADLINE = (
    "field_accuracy",
    "model_accuracy",
    "document_accuracy",
    "truth_match_report",
    "document_evaluation_wide",
    "readiness",
    "field_rates",
    "extraction_capability",
    "parse_responses",
    "extraction_method",
    "clean_response",
    "repetition_metrics",
    "classify_documents",
    "validate_truth",
    "resource_summary",
    "benchmark_summary",
)


class StoredInputs(Inputs):
    """Inputs read back from written tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: str, parts: int) -> None:
        super().__init__(spark, sf_dir)
        self.store = store
        for name, fields in (("truth", "truth_fields"), ("results", "extracted_fields")):
            rows = shred(getattr(Inputs, name)(self), DEFAULT_SPEC, fields)
            save_by_document(rows, f"bench_{name}", f"{store}/{name}", parts)
        Inputs.responses(self).repartition(parts, "doc_id").write.parquet(f"{store}/responses")
        for name in ("documents", "events"):
            Inputs.table(self, name).repartition(parts).write.parquet(f"{store}/{name}")

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/{name}")

    def truth(self) -> DataFrame:
        return self.spark.table("bench_truth")

    def requested(self) -> DataFrame:
        return Inputs.requested(self)

    def results(self) -> DataFrame:
        return self.spark.table("bench_results")

    def responses(self) -> DataFrame:
        return self._stored("responses")

    def table(self, name: str) -> DataFrame:
        return self._stored(name) if name == "documents" else super().table(name)


def cpus_are_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    cores = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldeval-bench")
        .config("spark.sql.shuffle.partitions", str(2 * cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # On a cluster this must be a folder that all executors share.
    shared = os.environ.get("BENCH_STORE") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not cpus_are_local(spark):
        raise SystemExit("set BENCH_STORE or spark.checkpoint.dir to a shared folder")
    store = f"{shared or tempfile.mkdtemp(prefix='spark-')}/bench-{time.time_ns()}"
    start = time.time()
    inputs = StoredInputs(spark, sf_dir, f"{store}/inputs", 2 * cores)
    seconds = {"prepare_inputs": round(time.time() - start, 3)}
    for name in HEADLINE:
        start = time.time()
        CATALOG[name].build(inputs).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(v for k, v in seconds.items() if k != "prepare_inputs"), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
