"""Commands over an ontology file: stats, query, export, validate."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinmap.functions.text import bar
from veinmap.operators import quality, query, sinks
from veinmap.sources.ontology import default_path, load_ontology

#: Names of an ontology's file, and the setting for a folder that holds it.
NAMES, FOLDER = ("ontology.json",), "VEINMAP_DATA"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veinmap")
    p.add_argument("--ontology", "-o", help=f"an ontology file; by default {NAMES[0]} in the current folder, data/ or ${FOLDER}")
    commands = p.add_subparsers(dest="command")
    stats = commands.add_parser("stats")
    stats.add_argument("-v", "--verbose", action="store_true")
    q = commands.add_parser("query")
    q.add_argument("text", nargs="?", default="")
    q.add_argument("--class", "-c", dest="class_name")
    q.add_argument("--property", "-p", help="name or name=value")
    q.add_argument("--hierarchy", "-H")
    q.add_argument("--category", choices=("all", "classes", "individuals"), default="all")
    q.add_argument("--limit", "-n", type=int, default=20)
    q.add_argument("--output", "-O")
    e = commands.add_parser("export")
    e.add_argument("format", choices=("json", "csv-classes", "csv-individuals", "csv-properties", "graphml", "markdown"))
    e.add_argument("output")
    v = commands.add_parser("validate")
    v.add_argument("--quick", "-q", action="store_true")
    v.add_argument("--output", "-O")
    return p


def asked(o, args) -> DataFrame:
    """The query's rows: class before property before hierarchy before text."""
    if args.class_name:
        return query.by_class(o, args.class_name)
    if args.property:
        name, _, value = args.property.partition("=")
        return query.by_property(o, name, value or None)
    if args.hierarchy:
        return query.hierarchy(o, args.hierarchy)
    return query.search(o, args.text, args.category)


def default_ontology() -> str:
    return default_path(NAMES, tuple(f for f in (os.environ.get(FOLDER), ".", "data") if f))


def to_json_file(rows: DataFrame, path: str) -> int:
    """Rows as one JSON file, an object a line, in a query's order."""
    lines = rows.orderBy(*query.in_order(rows)) if "pos" in rows.columns else rows
    lines.select(F.to_json(F.struct("*")).alias("line")).write.mode("overwrite").text(f"{path}.parts")
    return sinks.one_file(rows.sparkSession, f"{path}.parts", path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    spark = spark or SparkSession.builder.appName("veinmap").getOrCreate()
    o = load_ontology(spark, args.ontology or default_ontology())
    if args.command == "stats":
        for name, n in query.stats(o).first().asDict().items():
            print(f"{name}: {n}")
        for r in query.class_distribution(o).collect() if args.verbose else []:
            print(f"  {r['class']}: {r.n}")
    elif args.command == "query":
        found = asked(o, args)
        shown, more = query.displayed(found, args.limit)
        for r in shown.collect():
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))
        if more:
            print(f"... and {more} more")
        if args.output:
            to_json_file(found, args.output)
    elif args.command == "export":
        tables = {"csv-classes": sinks.csv_classes, "csv-individuals": sinks.csv_individuals, "csv-properties": sinks.csv_properties}
        if args.format == "json":
            size = sinks.export_json(o, args.output)
        elif args.format in tables:
            size = sinks.export_csv(tables[args.format](o), args.output)
        else:
            size = sinks.export_lines(sinks.graphml_lines(o) if args.format == "graphml" else sinks.markdown_lines(o), args.output)
        print(f"{args.format} -> {args.output} ({size:,} bytes)")
    else:
        report = quality.quick_check(o) if args.quick else quality.validate(o)
        shown = report if args.quick else report.select("*", *(bar(F.col(d)).alias(f"{d}_bar") for d in quality.DIMENSIONS))
        for name, value in shown.first().asDict().items():
            print(f"{name}: {value}")
        if args.output:
            to_json_file(report, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
