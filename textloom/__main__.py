"""Runs a query and writes its rows: python -m textloom QUERY TABLES TARGET.  Exit codes: 0 done, 2 refused, 64 wrong usage."""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException

DONE, REFUSED, USAGE = 0, 2, 64


def main(args: list[str]) -> int:
    from textloom.operators.cohort import Refused
    from textloom.plans import catalog
    from textloom.session import session

    if args == ["--list"]:
        print("\n".join(sorted(catalog.QUERIES)))
        return DONE
    if len(args) != 3 or args[0] not in catalog.QUERIES:
        print(__doc__, file=sys.stderr)
        return USAGE
    query, source, target = args
    try:
        catalog.QUERIES[query](session(f"textloom {query}"), source).write.parquet(target)
    except Refused as e:  # names columns and counts, never values
        print(f"refused: {e}", file=sys.stderr)
        return REFUSED
    except PySparkException as e:
        print(f"failed: {type(e).__name__} {e.getCondition() or ''}", file=sys.stderr)
        return REFUSED
    return DONE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
