"""Evaluate the algorithms on the labelled cases: python -m factloom [--algorithm NAME] [--verbose] [--export FILE]."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom import queries
from factloom.operators import evaluate
from factloom.shipping import ship


def main(args: list[str] | None = None) -> str:
    """Prints, and returns, the report; --export also writes it."""
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    parser.add_argument("--algorithm", "-a", choices=[*evaluate.ADAPTERS, "all"], default="all", help="which algorithm to evaluate")
    parser.add_argument("--verbose", "-v", action="store_true", help="list the cases that failed")
    parser.add_argument("--export", "-e", metavar="FILE", help="write the report as Markdown")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    results, available = queries.evaluated(spark), evaluate.statuses(spark)
    if asked.algorithm != "all":
        results, available = results.filter(F.col("algo") == asked.algorithm), available.filter(F.col("algo") == asked.algorithm)
    results = results.persist()
    metrics = evaluate.metrics(results).persist()
    report = evaluate.markdown(evaluate.coverage(metrics), metrics, available, evaluate.priorities(results, available))
    if asked.verbose:
        failed = results.filter(~F.col("passed")).orderBy("algo", "case_id").select("algo", "h_type", "verdict", "text").collect()
        report += "\n### Failures\n\n" + "\n".join(f"- {r.algo}: {r.text} ({r.h_type}, {r.verdict})" for r in failed) + "\n"
    for frame in (metrics, results):
        frame.unpersist()
    print(report)
    if asked.export:
        Path(asked.export).write_text(report)
    return report


if __name__ == "__main__":
    main()
