"""Commands: run a registered query, the metric suite, or the hierarchy job on a folder of tables."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

MODULES = ["corpusloom.queries_prepare", "corpusloom.queries_corpus", "corpusloom.queries_metrics", "corpusloom.queries_models", "corpusloom.queries_study"]


def known() -> dict:
    return {name: q for m in MODULES for name, q in importlib.import_module(m).QUERIES.items()}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a query and write or show its rows")
    run.add_argument("query", choices=sorted(known()))
    run.add_argument("tables")
    run.add_argument("--out", help="folder for Parquet; without it the first rows are shown")
    metrics = sub.add_parser("metrics", help="run the metric suite")
    metrics.add_argument("tables")
    hierarchy = sub.add_parser("hierarchy", help="narrower topics of articles, appended to what a folder holds")
    hierarchy.add_argument("tables")
    hierarchy.add_argument("out")
    hierarchy.add_argument("--sample", type=int)
    hierarchy.add_argument("--client", default="corpusloom.operators.chat:OfflineClient", help="module:name of what makes a client")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "run":
        df = known()[args.query](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(truncate=False)
        return 0
    if args.command == "metrics":
        from corpusloom.operators import runner
        from corpusloom.queries_study import _metrics

        report = runner.run_metrics(spark, args.tables, _metrics())
        report.show(truncate=False)
        runner.summary(report).show(truncate=False)
        return int(report.filter("status <> 'ok'").count() > 0)
    from corpusloom.operators import pipeline
    from corpusloom.sources import files
    from corpusloom.sources.tables import table

    module, name = args.client.split(":")
    articles = table(spark, args.tables, "nyt_sampled")
    made = pipeline.hierarchies(articles, "row_id", getattr(importlib.import_module(module), name), sample=args.sample)
    return int(files.append_missing(made, args.out, "row_id") < 0)


if __name__ == "__main__":
    raise SystemExit(main())
