"""The query interface over HTTP, with the standard library's server.

GET  /  /version  /info  /marts  /cube/NAME/model|aggregate|facts|fact/KEY|members/DIMENSION|cell
POST /cube/NAME/report
Parameters: cut, drilldown, aggregates, split, order, page, pagesize, fields, format, header, lang, locale; lists go by ``|``.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from . import __version__
from .errors import ArgumentError, HyperstarError, MissingObjectError, NotAuthorized, UserError
from .operators.result import AggregationResult
from .plans.cells import cut_from_dict
from .sources import output
from .sources.querylog import RequestLog
from .workspace import Workspace

TYPES = {"json": "application/json", "json_lines": "application/x-json-lines", "csv": "text/csv; charset=utf-8", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


class Service:
    """Answers paths with parameters; ``identity`` says who asks."""

    def __init__(self, workspace: Workspace, log: RequestLog | None = None, record_limit: int = output.RECORD_LIMIT):
        self.workspace, self.log, self.record_limit = workspace, log or RequestLog(), record_limit

    def answer(self, method: str, path: str, args: dict[str, str] | None = None, body: bytes = b"", identity=None) -> tuple[int, str, bytes]:
        """(status, content type, content)."""
        status, kind, content = self.streamed(method, path, args, body, identity)
        return status, kind, b"".join(content)

    def streamed(self, method: str, path: str, args: dict[str, str] | None = None, body: bytes = b"", identity=None) -> tuple[int, str, Iterator[bytes]]:
        """(status, content type, content in parts). Lists of rows come as Spark gives them, a partition at a time; the first part is there already."""
        try:
            kind, content = self._answer(method, [unquote(x) for x in path.strip("/").split("/") if x], args or {}, body, identity)
            parts = iter([content] if isinstance(content, (bytes, str)) else content)
            first = list(itertools.islice(parts, 1))
            return 200, TYPES.get(kind, kind), (x if isinstance(x, bytes) else x.encode() for x in itertools.chain(first, parts))
        except HyperstarError as e:
            status = 404 if isinstance(e, MissingObjectError) else 403 if isinstance(e, NotAuthorized) else 400 if isinstance(e, UserError) else 500
            return status, TYPES["json"], iter([output.to_json({"error": getattr(e, "kind", "error"), "message": str(e)}).encode()])

    def _answer(self, method: str, parts: list[str], args: dict, body: bytes, identity) -> tuple[str, Any]:
        if not parts:
            return "text/html", f"<html><body><h1>hyperstar {__version__}</h1></body></html>"
        if parts[0] == "version":
            return "json", output.to_json({"version": __version__})
        if parts[0] == "info":
            info = self.workspace.config.get("info", {})
            return "json", output.to_json(info | {"json_record_limit": self.record_limit, "timezone": str(self.workspace.calendar.zone or "")})
        if parts[0] == "marts":
            return "json", output.to_json(self.workspace.list_marts(identity))
        if parts[0] != "cube" or len(parts) < 3:
            raise MissingObjectError("/".join(parts))
        locale = args.get("lang") or args.get("locale")
        browser = self.workspace.browser(parts[1], locale=locale, identity=identity)
        action = parts[2]
        if action == "model":
            return "json", output.to_json(browser.cube.to_dict() | {"features": browser.features(), "locale": locale})
        cell = browser.cell(args.get("cut") or None)
        page = {"page": _number(args, "page"), "page_size": _number(args, "pagesize") or _number(args, "page_size")}
        order = [x for x in args.get("order", "").replace("|", ",").split(",") if x]
        listed = lambda k: [x for x in args.get(k, "").split("|") if x] or None
        fields = [x for x in args.get("fields", "").replace("|", ",").split(",") if x] or None
        with self.log.request(action, parts[1], cell.to_str(), identity, drilldown=args.get("drilldown"), split=args.get("split"), format=args.get("format"), **page):
            if action == "aggregate":
                result = browser.aggregate(cell, listed("aggregates"), listed("drilldown"), args.get("split") or None, order, **page)
                return self._rendered(result, result.labels, args, browser, "json")
            if action == "facts":
                df = browser.facts(cell, fields, order, **page)
                return self._rendered(df, df.columns, args, browser, "json")
            if action == "fact" and len(parts) == 4:
                found = browser.fact(_key(parts[3]), fields)
                if found is None:
                    raise MissingObjectError(parts[3], "no such fact")
                return "json", output.to_json(found)
            if action == "members" and len(parts) == 4:
                d = browser.cube.dimension(parts[3])
                h = d.hierarchy(args.get("hierarchy"))
                if args.get("depth") and args.get("level"):
                    raise ArgumentError("both depth and level are given")
                depth = _number(args, "depth") or (h.level_index(args["level"]) + 1 if args.get("level") else len(h))
                df = browser.members(cell, d, depth=depth, hierarchy=h.name, order=order, **page)
                if args.get("format", "json") != "json":
                    return self._rendered(df, df.columns, args, browser, "json")
                return "json", output.to_json({"dimension": d.name, "depth": depth, "hierarchy": h.name, "cell": [c.to_dict() for c in cell.cuts], "data": list(self._limited(df))})
            if action == "cell":
                return "json", output.to_json({"cube": browser.cube.name, "cuts": [c.to_dict() | {"details": browser.cut_details(c)} for c in cell.cuts]})
            if action == "report":
                if method != "POST":
                    raise ArgumentError("reports are posted")
                try:
                    spec = json.loads(body or b"{}")
                except ValueError as e:
                    raise ArgumentError(f"the report is no JSON: {e}") from e
                cuts = [cut_from_dict(c, browser.cube) for c in spec.get("cell", [])]
                return "json", output.to_json(browser.report(cell & browser.cell(cuts), spec.get("queries", {})))
        raise MissingObjectError(action)

    def _limited(self, df):
        return output.records(df.limit(self.record_limit))

    def _rendered(self, source, fields: list[str], args: dict, browser, default: str) -> tuple[str, Any]:
        kind = args.get("format", default)
        header = args.get("header", "labels")
        heading = output.labels_of(browser.cube, fields) if header == "labels" else None
        if kind == "json":
            if isinstance(source, AggregationResult):
                if source.cells_frame is not None:
                    source = replace(source, cells_frame=source.cells_frame.limit(self.record_limit))
                return kind, output.to_json(source.to_dict())
            return kind, output.to_json(list(self._limited(source)))
        if kind == "json_lines":
            return kind, output.json_lines(source)
        if kind == "csv":
            return kind, output.csv_lines(source, fields, heading, include_header=header != "none", lineterminator="\n")
        if kind == "xlsx":
            return kind, output.to_xlsx(source, fields, heading)
        raise ArgumentError(f"unknown format '{kind}'")


def _number(args: dict, name: str) -> int | None:
    if not args.get(name):
        return None
    try:
        return int(args[name])
    except ValueError as e:
        raise ArgumentError(f"'{name}' is no number: {args[name]}") from e


def _key(text: str):
    return int(text) if text.lstrip("-").isdigit() else text


def identity_of(authentication: str | None, headers, args: dict):
    """none, pass_parameter (``api_key``) or http_basic_proxy (the user that a proxy let in)."""
    if authentication in (None, "", "none"):
        return None
    if authentication == "pass_parameter":
        return args.get("api_key")
    if authentication == "http_basic_proxy":
        import base64

        kind, _, data = (headers.get("Authorization") or "").partition(" ")
        if kind.lower() != "basic":
            raise NotAuthorized("no identity")
        return base64.b64decode(data).decode().partition(":")[0]
    raise ArgumentError(f"unknown authentication '{authentication}'")


def make_server(workspace: Workspace, host: str = "localhost", port: int = 5000, log: RequestLog | None = None) -> ThreadingHTTPServer:
    service = Service(workspace, log)
    authentication = workspace.config.get("server", {}).get("authentication")

    class Handler(BaseHTTPRequestHandler):
        def _serve(self, method: str) -> None:
            url = urlsplit(self.path)
            args = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, kind, content = service.streamed(method, url.path, args, body, identity_of(authentication, self.headers, args))
            except HyperstarError as e:
                status, kind, content = 401, TYPES["json"], iter([output.to_json({"error": str(e)}).encode()])
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()  # the end of the connection ends the content
            self.wfile.writelines(content)

        def do_GET(self) -> None:  # noqa: N802
            self._serve("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._serve("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
