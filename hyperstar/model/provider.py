"""Reading, checking and serving models."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse
from urllib.request import urlopen

from ..errors import ArgumentError, ModelError, NoSuchCubeError, NoSuchDimensionError, TemplateRequired
from .cube import Cube
from .dimension import Dimension
from .localization import translated

_CUBE_KEYS = {"name", "label", "description", "info", "category", "dimensions", "measures", "aggregates", "details", "fact", "key", "joins", "mappings", "browser_options", "store", "locale", "implicit_aggregates", "nonadditive", "options", "provider", "dimension_links", "dimension_locals"}


def read_model(source: str | dict) -> dict:
    """A model from a dictionary, a JSON file, an address, or a bundle: a directory with model.json and a file dim_*.json or cube_*.json for each part."""
    if isinstance(source, dict):
        return source
    if urlparse(source).scheme in ("http", "https", "ftp", "file"):
        with urlopen(source) as f:
            return json.load(f)
    if os.path.isdir(source):
        with open(os.path.join(source, "model.json"), encoding="utf-8") as f:
            model = json.load(f)
        for prefix, kind in (("dim_", "dimensions"), ("cube_", "marts")):
            model.setdefault(kind, [])
            for name in sorted(os.listdir(source)):
                if name.startswith(prefix) and name.endswith(".json"):
                    with open(os.path.join(source, name), encoding="utf-8") as f:
                        part = json.load(f)
                    part.setdefault("name", name[len(prefix) : -5])
                    if any(x["name"] == part["name"] for x in model[kind] if isinstance(x, dict)):
                        raise ModelError(f"'{part['name']}' is twice in the bundle {source}")
                    model[kind].append(part)
        return model
    if not os.path.exists(source):
        raise ArgumentError(f"no model at '{source}'")
    with open(source, encoding="utf-8") as f:
        return json.load(f)


def write_bundle(path: str, model: dict, overwrite: bool = False) -> None:
    """A model as a bundle directory."""
    if os.path.exists(path) and not overwrite:
        raise ArgumentError(f"'{path}' exists")
    os.makedirs(path, exist_ok=True)
    parts = {"model": {k: v for k, v in model.items() if k not in ("marts", "dimensions")}}
    parts |= {f"dim_{d['name']}": d for d in model.get("dimensions", [])} | {f"cube_{c['name']}": c for c in model.get("marts", [])}
    for name, part in parts.items():
        with open(os.path.join(path, f"{name}.json"), "w", encoding="utf-8") as f:
            json.dump(part, f, indent=2)


def validate(model: dict) -> list[tuple[str, str, str]]:
    """(severity, where, what) of what is wrong with a model as read; empty if nothing is."""
    issues: list[tuple[str, str, str]] = []
    for kind in ("marts", "dimensions", "joins"):
        if not isinstance(model.get(kind, []), list):
            issues.append(("error", kind, "is not a list"))
            return issues
    if "name" not in model:
        issues.append(("default", "model", "has no name"))
    for kind in ("marts", "dimensions"):
        names = [x if isinstance(x, str) else x.get("name") for x in model.get(kind, [])]
        issues += [("error", kind, f"'{n}' repeats") for n in sorted({n for n in names if n and names.count(n) > 1})]
    dimensions: dict[str, Dimension] = {}
    waiting = list(model.get("dimensions", []))
    while waiting:
        later = []
        for d in waiting:
            try:
                made = Dimension.from_metadata(d, dimensions)
                dimensions[made.name] = made
            except TemplateRequired:
                later.append(d)
            except Exception as e:  # each part's fault is listed, whatever it is
                issues.append(("error", f"dimension {d if isinstance(d, str) else d.get('name')}", str(e)))
        if len(later) == len(waiting):
            issues += [("error", f"dimension {d.get('name')}", f"template '{d['template']}' is not in the model") for d in later]
            break
        waiting = later
    for c in model.get("marts", []):
        if unknown := sorted(set(c) - _CUBE_KEYS):
            issues.append(("warning", f"cube {c.get('name')}", f"unknown keys {unknown}"))
        try:
            cube = Cube.from_metadata(c)
            cube.link(lambda n: dimensions[n] if n in dimensions else Dimension.from_metadata(n))
            issues += [(s, f"cube {cube.name}: {w}", t) for s, w, t in cube.validate()]
        except Exception as e:
            issues.append(("error", f"cube {c.get('name')}", str(e)))
    return issues


class ModelProvider:
    """Serves marts and dimensions. Subclasses override ``list_marts``, ``cube`` and ``dimension``; by default the model has them all. Joins and mappings of the model are templates for those of its marts."""

    def __init__(self, model: str | dict | None = None, store: str | None = None):
        self.model = read_model(model or {})
        self.store = store or self.model.get("store") or self.model.get("datastore")
        for kind in ("marts", "dimensions"):
            names = [x if isinstance(x, str) else x.get("name") for x in self.model.get(kind, [])]
            if any(not n for n in names):
                raise ModelError(f"some of the model's {kind} have no name")
        self._marts = {c["name"]: c for c in self.model.get("marts", [])}
        self._dimensions = {(d if isinstance(d, str) else d["name"]): d for d in self.model.get("dimensions", [])}

    def list_marts(self) -> list[dict]:
        return [{"name": n, "label": c.get("label", n), "category": c.get("category") or (c.get("info") or {}).get("category"), "info": c.get("info") or {}} for n, c in self._marts.items()]

    def has_dimension(self, name: str) -> bool:
        return name in self._dimensions

    @property
    def public_dimensions(self) -> list[str]:
        return list(self.model.get("public_dimensions", self._dimensions))

    def dimension(self, name: str, templates: dict[str, Dimension] | None = None) -> Dimension:
        if name not in self._dimensions:
            raise NoSuchDimensionError(name)
        return Dimension.from_metadata(self._dimensions[name], templates)

    def cube(self, name: str, locale: str | None = None) -> Cube:
        """The cube without its dimensions, in the language of ``locale`` if the model has it."""
        if name not in self._marts:
            raise NoSuchCubeError(name)
        desc = dict(self._marts[name])
        named = {j["name"]: j for j in self.model.get("joins", []) if isinstance(j, dict) and j.get("name")}
        joins = []
        for j in desc.get("joins") or []:
            key = j if isinstance(j, str) else j.get("name") if isinstance(j, dict) else None
            if key is not None and key not in named and (isinstance(j, str) or "master" not in j):
                raise ModelError(f"cube '{name}' has a join by the unknown template '{key}'")
            joins.append(named.get(key, {}) | (j if isinstance(j, dict) else {}) if key is not None else j)
        desc["joins"] = joins or list(self.model.get("joins", []))
        desc["mappings"] = {**self.model.get("mappings", {}), **(desc.get("mappings") or {})}
        desc["browser_options"] = {**self.model.get("browser_options", {}), **(desc.get("browser_options") or {})}
        desc.setdefault("store", self.store)
        return Cube.from_metadata(desc)

    def translation(self, name: str, locale: str | None) -> dict:
        t = (self.model.get("translations") or {}).get(locale) or {}
        own = dict((t.get("marts") or {}).get(name) or {})
        own["dimensions"] = {**(t.get("dimensions") or {}), **(own.get("dimensions") or {})}
        return own

    def localized(self, cube: Cube, locale: str | None) -> Cube:
        return translated(cube, self.translation(cube.name, locale), locale) if locale else cube


StaticProvider = ModelProvider


def find_dimension(name: str, sources, seen: tuple[str, ...] = ()) -> Dimension:
    """A dimension and the templates that it builds on, from the first of ``sources`` (providers) that has each."""
    if name in seen:
        raise ModelError("dimension templates go in a circle: " + " -> ".join((*seen, name)))
    for source in sources:
        if source.has_dimension(name):
            templates: dict[str, Dimension] = {}
            while True:
                try:
                    return source.dimension(name, templates)
                except TemplateRequired as e:
                    templates[e.template] = find_dimension(e.template, sources, (*seen, name))
    raise NoSuchDimensionError(name)
