"""The command line: python -m hyperstar COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import HyperstarError
from .model import provider
from .operators.crosstab import of_result
from .sources import output
from .workspace import Workspace


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hyperstar", description="Multidimensional analysis on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, config: bool = True):
        c = sub.add_parser(name, help=help)
        if config:
            c.add_argument("config", help="INI file of the workspace")
        return c

    c = command("serve", "serve the workspace over HTTP")
    c.add_argument("--host", default="localhost")
    c.add_argument("--port", type=int, default=5000)
    command("list", "list marts").add_argument("--verbose", action="store_true")
    c = command("model", "check or convert a model", config=False)
    c.add_argument("action", choices=["validate", "convert"])
    c.add_argument("model")
    c.add_argument("--target", help="bundle directory, or JSON file, to write")
    c.add_argument("--force", action="store_true")
    c = command("test", "run a query on every cube")
    c.add_argument("marts", nargs="*")
    c.add_argument("--aggregate", action="store_true")
    c = command("denormalize", "make denormalized tables")
    c.add_argument("marts", nargs="*")
    c.add_argument("--materialize", action="store_true")
    c.add_argument("--replace", action="store_true")
    c.add_argument("--index", action="store_true")
    c = command("preaggregate", "make a pre-aggregated table")
    c.add_argument("cube")
    c.add_argument("--table")
    c.add_argument("--dimension", action="append")
    c.add_argument("--replace", action="store_true")
    c = command("aggregate", "aggregate a cube")
    c.add_argument("cube")
    for option in ("--cut", "--split", "--page", "--page-size", "--on-rows", "--on-columns"):
        c.add_argument(option)
    for option in ("--aggregate", "--drilldown", "--order"):
        c.add_argument(option, action="append")
    c.add_argument("--format", default="json", choices=sorted(output.FORMATTERS))
    c = command("members", "list members of a dimension")
    c.add_argument("cube")
    c.add_argument("dimension")
    c.add_argument("--cut")
    c.add_argument("--depth", type=int)
    c.add_argument("--format", default="json", choices=["json", "json_lines", "csv"])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    args = _parser().parse_args(argv)
    try:
        return _run(args, spark, out)
    except HyperstarError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args, spark, out) -> int:
    if args.command == "model":
        model = provider.read_model(args.model)
        issues = provider.validate(model)
        if args.action == "validate":
            for severity, where, what in issues:
                print(f"{severity}: {where}: {what}", file=out)
            print("the model is sound" if not issues else f"{len(issues)} issues", file=out)
            return int(any(s == "error" for s, _, _ in issues))
        if args.target and args.target.endswith(".json"):
            with open(args.target, "w" if args.force else "x", encoding="utf-8") as f:
                json.dump(model, f, indent=2)
        elif args.target:
            provider.write_bundle(args.target, model, args.force)
        else:
            print(json.dumps(model, indent=2), file=out)
        return 0
    workspace = Workspace(spark or SparkSession.builder.getOrCreate(), args.config)
    every = [c["name"] for c in workspace.list_marts()]
    if args.command == "list":
        for c in workspace.list_marts():
            print(f"{c['name']} - {c.get('label') or ''}" if args.verbose else c["name"], file=out)
    elif args.command == "serve":
        from .server import make_server

        make_server(workspace, args.host, args.port).serve_forever()
    elif args.command == "test":
        failed = 0
        for name in args.marts or every:
            try:
                workspace.browser(name).test(args.aggregate)
                print(f"{name}: ok", file=out)
            except Exception as e:  # every cube is tried
                failed += 1
                print(f"{name}: {type(e).__name__}: {e}", file=out)
        return int(failed > 0)
    elif args.command == "denormalize":
        for name in args.marts or every:
            cube = workspace.cube(name)
            store = workspace.store(cube.store)
            store.create_denormalized_view(cube, materialize=args.materialize, replace=args.replace, create_index=args.index)
            print(f"{name}: {store.naming.denormalized_table(name)}", file=out)
    elif args.command == "preaggregate":
        cube = workspace.cube(args.cube)
        workspace.store(cube.store).create_cube_aggregate(cube, args.table, args.dimension, args.replace)
    elif args.command == "aggregate":
        result = workspace.browser(args.cube).aggregate(args.cut, args.aggregate, args.drilldown, args.split, args.order, args.page, args.page_size)
        if args.on_rows or args.on_columns:
            table = of_result(result, (args.on_rows or "").split(","), (args.on_columns or "").split(","))
            print(output.to_json(table), file=out)
        else:
            print(output.formatted(args.format, result), file=out)
    elif args.command == "members":
        df = workspace.browser(args.cube).members(args.cut, args.dimension, depth=args.depth)
        lines = output.csv_lines(df, df.columns) if args.format == "csv" else output.json_lines(df) if args.format == "json_lines" else [output.to_json(list(output.records(df)))]
        print("".join(lines), file=out)
    return 0
