"""Marts of another server of this library, over HTTP."""

from __future__ import annotations

import json
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from ..errors import ArgumentError, StoreError
from ..model import ModelProvider


class RemoteStore:
    def __init__(self, url: str, timeout: float = 60.0):
        self.url, self.timeout = url.rstrip("/"), timeout

    def request(self, path: str, params: dict | None = None, body: dict | None = None):
        query = urlencode({k: v for k, v in (params or {}).items() if v not in (None, "")})
        data = json.dumps(body).encode() if body is not None else None
        try:
            with urlopen(Request(f"{self.url}/{path}" + (f"?{query}" if query else ""), data=data), timeout=self.timeout) as f:
                text = f.read().decode()
                return [json.loads(x) for x in text.splitlines()] if "json-lines" in f.headers.get("Content-Type", "") else json.loads(text)
        except HTTPError as e:
            message = e.read().decode(errors="replace")
            raise (ArgumentError if e.code < 500 else StoreError)(message) from e

    def cube_request(self, cube: str, action: str, params: dict | None = None, body: dict | None = None):
        return self.request(f"cube/{quote(cube)}/{action}", params, body)


class RemoteProvider(ModelProvider):
    """The models of a remote server's marts."""

    def __init__(self, store: RemoteStore):
        marts, dimensions = [], {}
        for c in store.request("marts"):
            model = store.cube_request(c["name"], "model")
            for d in model["dimensions"]:
                dimensions.setdefault(d["name"], {k: v for k, v in d.items() if k not in ("is_flat", "has_details")})
            marts.append({k: v for k, v in model.items() if k not in ("features", "locale")} | {"dimensions": [d["name"] for d in model["dimensions"]]})
        super().__init__({"marts": marts, "dimensions": list(dimensions.values())})


class RemoteBrowser:
    """The browser's methods, answered by the remote server with plain records."""

    def __init__(self, store: RemoteStore, cube: str, locale: str | None = None):
        self.store, self.cube, self.locale = store, cube, locale

    def _ask(self, action: str, cell=None, body=None, **params):
        params |= {"cut": str(cell) if cell is not None else None, "lang": self.locale}
        listed = {k: "|".join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in params.items()}
        return self.store.cube_request(self.cube, action, listed, body)

    def aggregate(self, cell=None, aggregates=None, drilldown=None, split=None, order=None, page=None, page_size=None) -> dict:
        return self._ask("aggregate", cell, aggregates=aggregates, drilldown=drilldown, split=split, order=order, page=page, pagesize=page_size)

    def facts(self, cell=None, fields=None, order=None, page=None, page_size=None) -> list[dict]:
        return self._ask("facts", cell, fields=fields, order=order, page=page, pagesize=page_size, format="json_lines")

    def fact(self, key) -> dict:
        return self._ask(f"fact/{quote(str(key))}")

    def members(self, cell=None, dimension=None, depth=None, level=None, hierarchy=None, page=None, page_size=None, order=None) -> list[dict]:
        return self._ask(f"members/{quote(dimension)}", cell, depth=depth, level=level, hierarchy=hierarchy, page=page, pagesize=page_size, order=order)["data"]

    def cell_details(self, cell=None) -> list:
        return [c["details"] for c in self._ask("cell", cell)["cuts"]]

    def report(self, cell, queries: dict) -> dict:
        return self._ask("report", cell, body={"queries": queries})
