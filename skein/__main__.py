"""Command line: ``ingest`` raw JSON lines, ``run`` the pipeline or some of its steps, ``export`` its results.

    python -m skein ingest --corpus corpus.jsonl --split train=train.jsonl --split test=test.jsonl --to tables
    python -m skein run --tables tables --out run [--step labels --step edit_bridges] [--again]
    python -m skein export --out run --to results
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from skein.plans import pipeline
from skein.sources import formats


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    does = p.add_subparsers(dest="do", required=True)
    ingest = does.add_parser("ingest", help="raw JSON lines to tables")
    ingest.add_argument("--corpus", nargs="+", required=True)
    ingest.add_argument("--split", action="append", required=True, metavar="NAME=PATH")
    ingest.add_argument("--to", required=True)
    run = does.add_parser("run", help="steps of the analysis")
    run.add_argument("--tables", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--step", action="append", choices=[*pipeline.STEPS])
    run.add_argument("--again", action="store_true", help="make tables again that are there")
    export = does.add_parser("export", help="results as JSON and text")
    export.add_argument("--out", required=True)
    export.add_argument("--to", required=True)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    if a.do == "ingest":
        formats.ingest(spark, a.corpus, dict(s.split("=", 1) for s in a.split), a.to)
    elif a.do == "run":
        pipeline.run(spark, a.tables, a.out, a.step, not a.again)
    else:
        pipeline.export(spark, a.out, a.to)


if __name__ == "__main__":
    main()
