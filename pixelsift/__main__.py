"""python -m pixelsift --version | --self-test | --help | FILE: print the structure of a file."""

from __future__ import annotations

import sys

from pixelsift.sources.structure import analyse

VERSION = "0.1.0"


def main(args: list[str]) -> int:
    if args[:1] == ["--version"]:
        print(VERSION)
        return 0
    if args[:1] == ["--self-test"]:
        from pyspark.sql import SparkSession

        from pixelsift import selfcheck

        rows = selfcheck.run(SparkSession.builder.appName("self-test").getOrCreate()).collect()
        for r in rows:
            print("ok  " if r.passed else "FAIL", r.step, r.detail)
        return int(not all(r.passed for r in rows))
    if len(args) == 1 and not args[0].startswith("-"):
        with open(args[0], "rb") as f:
            for _, section, kind, label, value in analyse(f.read()):
                print(f"[{section}] {kind}: {label} {value}".rstrip())
        return 0
    print(__doc__)
    return 0 if args[:1] == ["--help"] else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
