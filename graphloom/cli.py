"""Command line: `python -m graphloom.cli COMMAND ...`; answers are JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .api import App
from .server import serve_http, serve_stdio


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("serve")
    a = sub.add_parser("add")
    a.add_argument("root")
    a.add_argument("--service", default="")
    a.add_argument("--description", default="")
    for name in ("sync", "stats", "tree", "graph", "history"):
        one = sub.add_parser(name)
        one.add_argument("service")
        if name == "sync":
            one.add_argument("--full", action="store_true", help="read every file, not only those whose size or time has changed")
    s = sub.add_parser("search")
    s.add_argument("service")
    s.add_argument("query")
    s.add_argument("--kind")
    s.add_argument("--limit", type=int, default=10)
    for name in ("peek", "code", "walk"):
        q = sub.add_parser(name)
        q.add_argument("service")
        q.add_argument("node")
        if name == "code":
            q.add_argument("--context", type=int, default=0)
        if name == "walk":
            q.add_argument("edge")
            q.add_argument("--direction", default="both")
            q.add_argument("--limit", type=int, default=20)
            q.add_argument("--offset", type=int, default=0)
    f = sub.add_parser("file")
    f.add_argument("service")
    f.add_argument("path_or_id")
    v = sub.add_parser("viz")
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--service", default="")
    return p


def main(argv: list[str] | None = None, app: App | None = None) -> None:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    app = app or App(SparkSession.builder.appName("graphloom").getOrCreate())
    if command == "serve":
        return serve_stdio(app)
    if command == "viz":
        return serve_http(app, port=args["port"], service=args["service"]).serve_forever()
    name = {"list": "services", "add": "add_service"}.get(command, command)
    print(json.dumps(getattr(app, name)(**args), indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
