"""``python -m souqframe list`` and ``python -m souqframe run NAME --data DIR [--out PATH]``."""

from __future__ import annotations

import argparse

from souqframe.plans import registry
from souqframe.session import build_session, ship_package


def main() -> None:
    p = argparse.ArgumentParser(prog="souqframe")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(registry.QUERIES), metavar="NAME")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    a = p.parse_args()
    if a.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = build_session()
    ship_package(spark)
    df = registry.QUERIES[a.name](spark, a.data)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(20, False)


if __name__ == "__main__":
    main()
