"""python -m trailweave: run queries from a shell.

    python -m trailweave query  SOURCE "MATCH ..." [--params '{"x": 1}']
    python -m trailweave shell  SOURCE

SOURCE is a folder of the driver's tables (read only), or store:PATH for a mutable graph.
"""

from __future__ import annotations

import argparse
import json
import sys

from trailweave.plans.errors import GraphError


def session_of(source: str):
    from pyspark.sql import SparkSession

    from trailweave.session import Session
    from trailweave.sources.store import Store
    from trailweave.sources.testdata import load

    spark = SparkSession.builder.appName("trailweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return Session(Store(spark, source[6:])) if source.startswith("store:") else Session(load(spark, source))


def run(session, text: str, params: dict | None) -> int:
    try:
        print(session.execute(text, params).to_json())
        return 0
    except GraphError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def shell(session) -> int:
    """A statement a line, or :begin, :commit, :rollback, :quit."""
    for line in sys.stdin:
        text = line.strip()
        if text in (":quit", ":exit"):
            break
        if text in (":begin", ":commit", ":rollback"):
            try:
                getattr(session, text[1:])()
            except GraphError as e:
                print(f"{type(e).__name__}: {e}", file=sys.stderr)
        elif text:
            run(session, text, None)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trailweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=("query", "shell"))
    parser.add_argument("source")
    parser.add_argument("text", nargs="?")
    parser.add_argument("--params", type=json.loads)
    args = parser.parse_args(argv)
    if args.verb == "query" and not args.text:
        parser.error("query needs a text")
    session = session_of(args.source)
    return shell(session) if args.verb == "shell" else run(session, args.text, args.params)


if __name__ == "__main__":
    sys.exit(main())
