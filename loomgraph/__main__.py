"""python -m loomgraph QUERY FOLDER: runs a registered query over a folder of tables and shows its rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomgraph.plans import graph_queries, record_queries, search_queries, text_queries  # noqa: F401  (they register themselves)
from loomgraph.plans.registry import QUERIES


def main() -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("folder")
    parser.add_argument("--rows", type=int, default=20)
    args = parser.parse_args()
    QUERIES[args.query](SparkSession.builder.getOrCreate(), args.folder).show(args.rows, truncate=100)


if __name__ == "__main__":
    main()
