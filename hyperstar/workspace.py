"""Workspaces: stores, models, languages and rights together."""

from __future__ import annotations

import configparser
import json
import os

from pyspark.sql import SparkSession

from .auth import Authorizer, SimpleAuthorizer
from .errors import ConfigurationError, NotAuthorized
from .model import Cube, ModelProvider
from .model.dimension import Dimension
from .namespace import Namespace
from .operators.browser import Browser
from .plans.calendar import Calendar
from .plans.cells import Cell
from .sources.store import SparkStore


class Workspace:
    """Configured by a dictionary, or an INI file, with the sections workspace, models, model, store or ``store NAME``, browser, authorization and translations."""

    def __init__(self, spark: SparkSession, config: dict | str | None = None, authorizer: Authorizer | None = None):
        self.spark = spark
        self.config = _read_config(config)
        own = self.config.get("workspace", {})
        self.root = own.get("root_directory", "")
        self.calendar = Calendar(own.get("first_weekday", 0), own.get("timezone"))
        self.browser_options = {k: _typed(v) for k, v in self.config.get("browser", {}).items()}
        self.namespace = Namespace()
        self.stores: dict[str, SparkStore] = {}
        self._marts: dict[tuple, Cube] = {}
        for section, options in self.config.items():
            if section == "store" or section.startswith("store "):
                self.register_store(section.removeprefix("store").strip() or "default", **{k: _typed(v) for k, v in options.items() if k != "type"})
        self.authorizer = authorizer or self._configured_authorizer(own)
        folder = own.get("models_directory", own.get("models_path", ""))
        for name, path in {**self.config.get("models", {}), **({"main": self.config["model"]["path"]} if self.config.get("model", {}).get("path") else {})}.items():
            self.import_model(os.path.join(self.root, folder, path), namespace=None if name == "main" else self.config.get("namespaces", {}).get(name))

    def _configured_authorizer(self, own: dict) -> Authorizer | None:
        if own.get("authorization") != "simple":
            if own.get("authorization"):
                raise ConfigurationError(f"unknown authorization '{own['authorization']}'")
            return None
        options = self.config.get("authorization", {})

        def loaded(what: str) -> dict:
            if options.get(f"{what}_file"):
                with open(os.path.join(self.root, options[f"{what}_file"]), encoding="utf-8") as f:
                    return json.load(f)
            return options.get(what) or {}

        return SimpleAuthorizer(loaded("rights"), loaded("roles"), options.get("order", "deny_allow"), options.get("identity_dimension"), options.get("guest"))

    # Stores and models

    def register_store(self, name: str = "default", store: SparkStore | None = None, **options) -> SparkStore:
        if name in self.stores:
            raise ConfigurationError(f"store '{name}' is there already")
        self.stores[name] = store or SparkStore(self.spark, **options)
        return self.stores[name]

    def store(self, name: str | None = None) -> SparkStore:
        if (name or "default") not in self.stores:
            raise ConfigurationError(f"no store '{name or 'default'}'")
        return self.stores[name or "default"]

    def import_model(self, model: str | dict | ModelProvider, store: str | None = None, namespace: str | None = None, translations: dict | None = None) -> None:
        provider = model if isinstance(model, ModelProvider) else ModelProvider(model, store)
        if translations:
            provider.model = provider.model | {"translations": {**provider.model.get("translations", {}), **translations}}
        (self.namespace.create_namespace(namespace) if namespace else self.namespace).add_provider(provider)
        self._marts.clear()

    # Marts

    def list_marts(self, identity=None) -> list[dict]:
        found = self.namespace.list_marts(recursive=True)
        if self.authorizer is not None:
            names = set(self.authorizer.authorize(identity, [c["name"] for c in found]))
            found = [c for c in found if c["name"] in names]
        return found

    def cube(self, ref: str, identity=None, locale: str | None = None) -> Cube:
        if self.authorizer is not None and not self.authorizer.authorize(identity, [ref]):
            raise NotAuthorized(f"no right to cube '{ref}'")
        key = (ref, identity, locale)
        if key not in self._marts:
            cube = self.namespace.cube(ref, locale)
            if isinstance(self.authorizer, SimpleAuthorizer):
                cube = self.authorizer.limited(identity, cube)
            self._marts[key] = cube
        return self._marts[key]

    def dimension(self, name: str, locale: str | None = None) -> Dimension:
        return self.namespace.find_dimension(name)

    def browser(self, cube: str | Cube, locale: str | None = None, identity=None, **options) -> Browser:
        """Options of the store hold unless the workspace, the cube or the call has others, in that order."""
        c = self.cube(cube, identity, locale) if isinstance(cube, str) else cube
        store = self.store(c.store)
        merged = {**self.browser_options, **c.browser_options, **options}
        if merged.pop("denormalized", False) or merged.pop("is_denormalized", False):
            made = store.wide_browser(c, merged.pop("denormalized_table", None), locale, calendar=self.calendar, **merged)
        else:
            made = store.browser(c, locale, calendar=self.calendar, **merged)
        return _Restricted.of(made, self.authorizer, identity) if self.authorizer is not None else made

    def cell(self, cube: str, cell=None, identity=None) -> Cell:
        return self.browser(cube, identity=identity).cell(cell)


class _Restricted(Browser):
    """Every cell is cut to what the identity may see."""

    @classmethod
    def of(cls, browser: Browser, authorizer: Authorizer, identity) -> _Restricted:
        browser.__class__ = cls
        browser.authorizer, browser.identity = authorizer, identity
        browser.visible = authorizer.restricted_cell(identity, browser.cube, Cell(browser.cube))
        return browser

    def cell(self, cell=None) -> Cell:
        made = super().cell(cell)
        return made & Cell(self.cube, [c for c in self.visible.cuts if c not in made.cuts])


def _read_config(config: dict | str | None) -> dict:
    if config is None or isinstance(config, dict):
        return config or {}
    if not os.path.exists(config):
        raise ConfigurationError(f"no configuration at '{config}'")
    parser = configparser.ConfigParser()
    parser.read(config)
    return {s: dict(parser.items(s)) for s in parser.sections()}


def _typed(value):
    """Configured texts as booleans and numbers where they look like them."""
    if not isinstance(value, str):
        return value
    low = value.lower()
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    return int(value) if value.lstrip("-").isdigit() else value
