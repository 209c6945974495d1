"""Command line: analyse a repository and ask about it."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession

from tributary.engine import Analysis, Engine
from tributary.operators import graph, semantic
from tributary.sources import files as sources

VERSION = "0.2.0"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tributary")
    parser.add_argument("--master", default="local[*]", help="the cluster, as Spark names it")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="analyse a folder or a repository's URL and write the result")
    analyze.add_argument("repository")
    analyze.add_argument("output", nargs="?", default="artifacts")
    lineage = commands.add_parser("lineage", help="what lies downstream or upstream of a dataset")
    lineage.add_argument("--upstream", action="store_true")
    impact = commands.add_parser("impact", help="what a change of a module reaches")
    query = commands.add_parser("query", help="send a question to the tool that its words ask for")
    for command, last in ((lineage, "dataset"), (impact, "module"), (query, "question")):
        command.add_argument("repository")
        command.add_argument(last)
    commands.add_parser("version", help="the version")
    return parser


def root_of(repository: str) -> str:
    """The folder of a repository; one given by URL is cloned first."""
    return sources.clone(repository, ".tributary") if re.match(r"(https?|ssh)://|git@", repository) else repository


def answer(engine: Engine, found: Analysis, asked: argparse.Namespace):
    """The table that a command prints."""
    if asked.command == "lineage":
        ids = found.data_nodes.select("identity").union(found.transformations.select("identity"))
        start = graph.find_start(ids, asked.dataset).first()
        return graph.trace(found.lineage_edges, start[0] if start else asked.dataset, upstream=asked.upstream).orderBy("distance", "node")
    if asked.command == "impact":
        start = graph.find_start(found.modules.select("identity"), asked.module).first()
        return graph.weighted_impact(found.module_edges, found.modules, start[0] if start else asked.module).orderBy("distance", "node")
    return engine.query(found, asked.question)


def main(arguments: list[str] | None = None) -> int:
    asked = _parser().parse_args(arguments)
    if asked.command == "version":
        print(VERSION)
        return 0
    spark = SparkSession.builder.master(asked.master).appName("tributary").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    found = engine.analyze(root_of(asked.repository))
    if asked.command == "analyze":
        found.write(asked.output)
        print(f"{found.modules.count()} modules, {found.data_nodes.count()} datasets, {found.lineage_edges.count()} lineage edges; written to {asked.output}")
        return 0
    if asked.command == "query":
        print(f"tool: {semantic.route(asked.question)}")
    rows = answer(engine, found, asked)
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
