"""The API as tools over JSON-RPC on standard input and output, and over HTTP."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

_ID, _TEXT, _NUMBER = {"serviceId": "string"}, "string", "number"
#: Fixed values, as clients know them: the tools' argument names and types, and how many of the first are required.
TOOLS = {
    "services": ("List the indexed services.", {}, 0),
    "add_service": ("Add a source tree as a service and index it.", {"rootAbs": _TEXT, "serviceId": _TEXT, "description": _TEXT, "mainEntities": _TEXT}, 1),
    "update_service_meta": ("Change a service's description and main entities.", _ID | {"description": _TEXT, "mainEntities": _TEXT}, 1),
    "sync": ("Index a service anew.", _ID, 1),
    "stats": ("Counts of a service's index.", _ID, 1),
    "search": ("Ranked keyword search.", _ID | {"query": _TEXT, "kind": _TEXT, "limit": _NUMBER}, 2),
    "peek": ("Summary of a symbol or a file.", _ID | {"id": _TEXT}, 2),
    "walk": ("Follow edges of a type.", _ID | {"id": _TEXT, "edge": _TEXT, "dir": _TEXT, "limit": _NUMBER, "offset": _NUMBER}, 3),
    "code": ("Source lines of a symbol.", _ID | {"id": _TEXT, "ctx": _NUMBER}, 2),
    "file": ("Overview of a file.", _ID | {"path": _TEXT}, 2),
}
#: Over HTTP: the operations and their defaults.
HTTP = {"info": {}, "stats": {}, "tree": {}, "graph": {}, "file": {}, "search": {"limit": 20}, "peek": {}, "walk": {"limit": 50}, "code": {}}
#: The App's names for the arguments.
_OWN = {
    "rootAbs": "root", "serviceId": "service", "mainEntities": "main_entities", "id": "node", "path": "path_or_id", "q": "query", "dir": "direction",
    "ctx": "context",
}


def call(app, name: str, args: dict):
    """An operation with the arguments' outer names. Lists come as JSON text or as lists, numbers as numbers or text."""
    own = {}
    for outer, value in args.items():
        if outer == "mainEntities" and isinstance(value, str):
            if not value:
                continue
            value = json.loads(value)
        own[_OWN.get(outer, outer)] = int(value) if outer in ("limit", "offset", "ctx") else value
    return getattr(app, name)(**own)


def call_tool(app, name: str, args: dict):
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name!r}")
    _, known, n = TOOLS[name]
    if missing := [a for a in list(known)[:n] if not args.get(a)]:
        raise ValueError(f"missing: {', '.join(missing)}")
    out = call(app, name, {a: v for a, v in args.items() if a in known})
    short = {"add_service": lambda: {"serviceId": out["id"]}, "update_service_meta": lambda: {"status": "ok"}, "sync": lambda: {"status": "ok", "serviceId": args["serviceId"]}}
    return short[name]() if name in short else out


def answer(app, message: dict) -> dict | None:
    """The answer to one JSON-RPC message; notifications have none."""
    method, number = message.get("method"), message.get("id")
    if number is None:
        return None
    ok = lambda result: {"jsonrpc": "2.0", "id": number, "result": result}
    if method == "initialize":
        version = message.get("params", {}).get("protocolVersion", "2024-11-05")
        return ok({"protocolVersion": version, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        schema = lambda args, n: {"type": "object", "properties": {a: {"type": t} for a, t in args.items()}, "required": list(args)[:n]}
        return ok({"tools": [{"name": n, "description": d, "inputSchema": schema(a, r)} for n, (d, a, r) in TOOLS.items()]})
    if method == "tools/call":
        params = message.get("params", {})
        try:
            result = call_tool(app, params.get("name"), params.get("arguments") or {})
            return ok({"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}]})
        except Exception as e:  # a tool's failure is an answer
            return ok({"content": [{"type": "text", "text": str(e)}], "isError": True})
    return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method {method!r}"}}


def serve_stdio(app, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip() and (reply := answer(app, json.loads(line))):
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def http_answer(app, url: str, service: str = "") -> tuple[int, dict]:
    """The answer to a request; `service` is the one that is served where the request names none."""
    parts = urlparse(url)
    name = parts.path.removeprefix("/api/")
    if not parts.path.startswith("/api/") or name not in HTTP:
        return 404, {"error": "not found"}
    given = {k: v[0] for k, v in parse_qs(parts.query).items()}
    args = HTTP[name] | {"serviceId": given.pop("service", service)} | given
    try:
        out = call(app, name, args)
        return 200, out | {"stats": app.stats(args["serviceId"])} if name == "info" else out
    except (KeyError, ValueError, TypeError) as e:
        return 400, {"error": str(e)}


def serve_http(app, host: str = "127.0.0.1", port: int = 8080, service: str = "") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, value = http_answer(app, self.path, service)
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
