"""Command line: list the queries, show the SQL of one, or run one over a data folder."""

from __future__ import annotations

import argparse
import sys

from quern.plans import registry
from quern.session import session


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    shown = commands.add_parser("sql", help="the SQL of a query")
    shown.add_argument("name", choices=registry.ORACLE_SQL, metavar="name")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name", choices=registry.QUERIES, metavar="name")
    run.add_argument("folder", help="folder with the parquet tables")
    run.add_argument("--to", help="folder for the result; without it the first rows are printed")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--cores", type=int, default=8)
    asked = parser.parse_args(words)
    if asked.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
    elif asked.command == "sql":
        print(registry.ORACLE_SQL[asked.name])
    else:
        result = registry.QUERIES[asked.name](session(asked.cores), asked.folder)
        if asked.to:
            result.write.mode("errorifexists").format(asked.format).save(asked.to)
        else:
            result.show(asked.rows, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
