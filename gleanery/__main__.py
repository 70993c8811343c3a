"""python -m gleanery {duplication,forms,digest,pack} ...: analyses of a source tree."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleanery")
    sub = parser.add_subparsers(dest="command", required=True)
    d = sub.add_parser("duplication")
    d.add_argument("root")
    d.add_argument("--kind", choices=["exact", "near"], default="exact")
    d.add_argument("--min-tokens", type=int)
    d.add_argument("--min-lines", type=int)
    f = sub.add_parser("forms")
    f.add_argument("root")
    f.add_argument("--name")
    t = sub.add_parser("digest")
    t.add_argument("root")
    p = sub.add_parser("pack")
    p.add_argument("action", choices=["validate", "build", "import", "list"])
    p.add_argument("paths", nargs="+")
    a = parser.parse_args(argv)
    try:
        if a.command == "digest":
            from .sources.trees import tree_digest

            print(tree_digest(a.root))
            return 0
        if a.command == "pack":
            return _pack(a)
        return _analyse(a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _pack(a) -> int:
    from pathlib import Path

    from .sources import pack_files as P

    if a.action == "validate":
        P.verify(P.parse(Path(a.paths[0], "pack.toml").read_text()), a.paths[0])
    elif a.action == "build":
        print(P.write_oci(P.parse(Path(a.paths[0], "pack.toml").read_text()), a.paths[0], a.paths[1]))
    elif a.action == "import":
        print(P.Cache(a.paths[1]).add(a.paths[0]))
    else:
        for d, m in P.Cache(a.paths[0]).list():
            print(d, m["name"], m["version"])
    return 0


def _analyse(a) -> int:
    from pyspark.sql import SparkSession

    from .operators import behaviors, clones
    from .sources import trees

    spark = SparkSession.builder.getOrCreate()
    files, problems = trees.scan(spark, a.root)
    for r in problems.toLocalIterator():
        print(f"{r['path']}: {r['message']}", file=sys.stderr)
    if a.command == "duplication":
        near = a.kind == "near"
        k, lines = a.min_tokens or (80 if near else 50), a.min_lines or (8 if near else 5)
        out = clones.clones(trees.tokenize(files), k, lines, ("identifier", "literal") if near else ())
    else:
        out = behaviors.python_forms(files.where("language = 'python'")).where("name is not null")
        if a.name:
            out = out.where(out["name"].contains(a.name))
        out = out.withColumn("simplified", behaviors.canonical_text(behaviors.simplified("form"))).withColumn("form", behaviors.canonical_text("form"))
    for line in out.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
