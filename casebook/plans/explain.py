"""Print the formatted physical plan of a registered query.

    python -m casebook.plans.explain <query> [sf_dir]
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> None:
    from casebook.plans.catalog import QUERIES
    from casebook.session import build_session
    if not argv or argv[0] not in QUERIES:
        print("queries:", ", ".join(sorted(QUERIES)))
        return
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[*]", 8)
    QUERIES[argv[0]](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
