"""``python -m tessera QUERY FOLDER [OUT]``: run a query of the catalog and show or write its rows (UDF6)."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from tessera import catalog

    if len(args) < 2 or args[0] not in catalog.QUERIES:
        print(__doc__)
        print("Queries: " + " ".join(sorted(catalog.QUERIES)))
        return 2
    from tessera.session import session

    df = catalog.QUERIES[args[0]](session(), args[1])
    if len(args) > 2:
        df.write.mode("errorifexists").parquet(args[2])
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
