"""python -m mlode.cli eval|check|format|list|deps|rename|parse|replace-source FILE ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from mlode.lang.lint import dependencies, format_source, lint, rename
from mlode.lang.parser import parse, parse_section
from mlode.lang.tokens import replace_source, view
from mlode.plans.errors import MError


def _source(path: str) -> str:
    if path.endswith((".xlsx", ".pbix", ".pbit")):
        from mlode.sources.containers import read_section

        return read_section(path)
    if path.endswith(".pbip") or os.path.isdir(path):
        from mlode.sources.containers import read_project

        return project_section(read_project(path))
    with open(path, encoding="utf-8-sig") as f:
        return f.read()


def project_section(found: dict[str, str]) -> str:
    """The queries of a project folder as one section document, each named by its file."""
    return "section Project;\n" + "".join('shared #"' + name.replace('"', '""') + f'" = {text.strip()};\n' for name, text in found.items())


def _shown(v):
    return v.isoformat() if isinstance(v, (dt.date, dt.time)) else str(v)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mlode")
    parser.add_argument("command", choices=("eval", "check", "format", "list", "deps", "rename", "parse", "replace-source"))
    parser.add_argument("file")
    parser.add_argument("names", nargs="*", help="rename: old and new name; replace-source: the file with the new source")
    parser.add_argument("--member", help="a member of a section document or stored query")
    parser.add_argument("--bind", action="append", default=[], metavar="NAME=PATH")
    parser.add_argument("--strict", action="store_true", help="nulls in arithmetic and aggregates are errors")
    parser.add_argument("--csv", action="store_true", help="print a table as CSV")
    parser.add_argument("--write", metavar="PATH", help="write a table there, a file for each task, in place of printing it")
    parser.add_argument("--to", choices=("parquet", "csv", "json"), default="parquet", help="the format of --write")
    parser.add_argument("--mode", choices=("error", "overwrite", "append"), default="error", help="what --write does where the path exists")
    args = parser.parse_args(argv)
    try:
        text = _source(args.file)
        if args.command == "check":
            found = lint(text)
            for f in found:
                print(f"{args.file}:{f.line}:{f.column} {f.severity} {f.code} {f.message}")
            return int(any(f.severity == "error" for f in found))
        if args.command == "format":
            print(format_source(text), end="")
        elif args.command == "list":
            print("\n".join(parse_section(text)))
        elif args.command == "deps":
            print(json.dumps(dependencies(parse(text)), indent=2))
        elif args.command == "rename":
            print(rename(text, *args.names), end="")
        elif args.command == "parse":
            print(json.dumps(view(text), indent=2, ensure_ascii=False))
        elif args.command == "replace-source":
            if len(args.names) != 1:
                parser.error("replace-source needs the file with the new source")
            print(replace_source(text, _source(args.names[0])), end="")
        else:
            return _eval(args, text)
    except MError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
    return 0


def _eval(args: argparse.Namespace, text: str) -> int:
    from pyspark.sql import DataFrame, SparkSession

    from mlode.api import evaluate, section_member

    spark = SparkSession.builder.getOrCreate()
    bindings = dict(b.split("=", 1) for b in args.bind)
    nulls = "strict" if args.strict else "sql"
    out = section_member(spark, text, args.member, bindings, nulls=nulls) if args.member else evaluate(spark, text, bindings, nulls=nulls)
    if args.write:
        from mlode.api import write

        write(out, args.write, args.to, args.mode)
        return 0
    if isinstance(out, DataFrame):
        # printed on the driver; --write is for tables that don't fit there
        if args.csv:
            print(out.toPandas().to_csv(index=False), end="")
            return 0
        out = [r.asDict(True) for r in out.collect()]
    print(json.dumps(out, default=_shown, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
