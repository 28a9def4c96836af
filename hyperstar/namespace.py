"""Namespaces: a tree of model providers."""

from __future__ import annotations

from .errors import NoSuchCubeError, NoSuchDimensionError
from .model import Cube, Dimension, ModelProvider
from .model.provider import find_dimension


class Namespace:
    def __init__(self, name: str | None = None, parent: Namespace | None = None):
        self.name, self.parent = name, parent
        self.children: dict[str, Namespace] = {}
        self.providers: list[ModelProvider] = []
        self.translations: dict[str, dict] = {}

    def namespace(self, path: str | list[str], create: bool = False) -> tuple[Namespace, list[str]]:
        """The deepest namespace on a dotted path, and what of the path is left."""
        parts = path.split(".") if isinstance(path, str) else list(path)
        here = self
        while parts and (parts[0] in here.children or create):
            here = here.children.setdefault(parts[0], Namespace(parts[0], here))
            parts = parts[1:]
        return here, parts

    def create_namespace(self, path: str) -> Namespace:
        return self.namespace(path, create=True)[0]

    def add_provider(self, provider: ModelProvider) -> None:
        self.providers.append(provider)

    @property
    def path(self) -> str:
        up = self.parent.path if self.parent else ""
        return ".".join(x for x in (up, self.name) if x)

    def find_cube(self, ref: str) -> tuple[Namespace, ModelProvider, str]:
        """The namespace and provider of ``cube`` or ``namespace.cube``, and the cube's own name, which may hold dots."""
        here, rest = self.namespace(ref)
        for space, name in ((here, ".".join(rest)), (self, ref)):
            for p in space.providers:
                if any(c["name"] == name for c in p.list_marts()):
                    return space, p, name
        raise NoSuchCubeError(ref)

    def find_dimension(self, name: str, provider: ModelProvider | None = None, locale: str | None = None) -> Dimension:
        """From the cube's own provider, then this namespace's public dimensions, then those of the namespaces above."""
        sources = [provider] if provider is not None else []
        here: Namespace | None = self
        while here is not None:
            sources += [_Public(p) for p in here.providers]
            here = here.parent
        return find_dimension(name, sources)

    def cube(self, ref: str, locale: str | None = None) -> Cube:
        space, provider, name = self.find_cube(ref)
        cube = provider.cube(name, locale)

        def find(n: str) -> Dimension:
            try:
                return space.find_dimension(n, provider)
            except NoSuchDimensionError:
                if any(x["name"] == n and len(x) == 1 for x in cube.links) and not provider.model.get("dimensions"):
                    return Dimension.from_metadata(n)
                raise

        cube.link(find)
        cube.namespace = space.path or None
        return provider.localized(cube, locale)

    def list_marts(self, recursive: bool = False) -> list[dict]:
        found = [c for p in self.providers for c in p.list_marts()]
        if recursive:
            found += [c | {"name": f"{n}.{c['name']}"} for n, child in self.children.items() for c in child.list_marts(True)]
        return found


class _Public:
    """The public dimensions of a provider."""

    def __init__(self, provider: ModelProvider):
        self.provider = provider

    def has_dimension(self, name: str) -> bool:
        return self.provider.has_dimension(name) and name in self.provider.public_dimensions

    def dimension(self, name: str, templates=None) -> Dimension:
        return self.provider.dimension(name, templates)
