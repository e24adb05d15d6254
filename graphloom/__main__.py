"""Command line: python -m graphloom analyze SOURCE GRAPH, then python -m graphloom impact GRAPH NAME, and so on."""

from __future__ import annotations

import argparse


def main() -> None:
    from pyspark.sql import SparkSession

    from .engine import Engine

    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    parser.add_argument("command", choices=["analyze", "status", "search", "trace", "impact", "context", "callers", "suggest", "hotspots", "findings", "flows", "score", "gaps", "communities", "processes"])
    parser.add_argument("graph", help="folder of the saved graph; for analyze, the source folder")
    parser.add_argument("name", nargs="?", default="", help="symbol or query; for analyze, where to save the graph")
    parser.add_argument("--depth", type=int, default=3)
    parser.add_argument("--limit", type=int, default=20)
    a = parser.parse_args()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "analyze":
        Engine.analyze(spark, a.graph).save(a.name)
        return
    e = Engine.load(spark, a.graph)
    answer = {
        "status": lambda: e.status(), "search": lambda: e.search(a.name, a.limit), "trace": lambda: e.trace(a.name, a.depth)[0], "impact": lambda: e.impact(a.name, a.depth),
        "context": lambda: e.context(a.name, a.depth), "callers": lambda: e.callers(a.name), "suggest": lambda: e.suggest(a.name, a.limit), "hotspots": lambda: e.hotspots(a.limit),
        "findings": lambda: e.findings(), "flows": lambda: e.flows(), "score": lambda: e.security_score(), "gaps": lambda: e.test_gaps(), "communities": lambda: e.communities(), "processes": lambda: e.processes(),
    }[a.command]
    answer().show(a.limit, truncate=False)


if __name__ == "__main__":
    main()
