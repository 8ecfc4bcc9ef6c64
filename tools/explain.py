"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from gustline.plans import catalog  # noqa: E402
from gustline.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session()
    for name in args or ["gold_alerts"]:
        print(f"===== {name}")
        catalog.queries()[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
