"""Dimensions with their levels and hierarchies."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from ..errors import ArgumentError, HierarchyError, ModelError, ModelInconsistencyError, NoSuchAttributeError, TemplateRequired
from .attributes import Attribute

#: Level names that are calendar units, and cardinalities.
CALENDAR_ROLES = ("year", "quarter", "month", "week", "weekday", "day", "hour", "minute", "second")
TIME_ROLES = ("time", "date")
CARDINALITIES = (None, "tiny", "low", "medium", "high")


@dataclass
class Level:
    """Attributes that belong together; the key tells members apart, the label is shown, the order attribute sorts."""

    name: str
    attributes: list[Attribute]
    key: Attribute | None = None
    label_attribute: Attribute | None = None
    order_attribute: Attribute | None = None
    order: str | None = None
    label: str | None = None
    description: str | None = None
    info: dict = field(default_factory=dict)
    role: str | None = None
    cardinality: str | None = None
    nonadditive: str | None = None

    @property
    def has_details(self) -> bool:
        return len(self.attributes) > 1

    @classmethod
    def from_metadata(cls, desc, dimension: str) -> Level:
        if isinstance(desc, str):
            desc = {"name": desc}
        if not desc.get("name"):
            raise ModelError(f"a level of dimension '{dimension}' has no name")
        attributes = [Attribute.from_metadata(a, dimension=dimension) for a in desc.get("attributes") or [desc["name"]]]
        by_name = {a.name: a for a in attributes}
        if len(by_name) != len(attributes):
            raise ModelError(f"attributes repeat in level '{desc['name']}' of dimension '{dimension}'")

        def pick(what: str, default: Attribute) -> Attribute:
            name = desc.get(what)
            if name and name not in by_name:
                raise NoSuchAttributeError(name, f"{what} of level '{desc['name']}' in dimension '{dimension}'")
            return by_name[name] if name else default

        key = pick("key", attributes[0])
        if desc.get("cardinality") not in CARDINALITIES:
            raise ModelError(f"level '{desc['name']}' has unknown cardinality '{desc['cardinality']}'")
        return cls(
            desc["name"], attributes, key, pick("label_attribute", attributes[1] if len(attributes) > 1 else key), pick("order_attribute", attributes[0]), desc.get("order"),
            desc.get("label"), desc.get("description"), desc.get("info") or {}, desc.get("role"), desc.get("cardinality"), desc.get("nonadditive"),
        )

    def to_dict(self) -> dict:
        found = {"name": self.name, "label": self.label, "attributes": [a.to_dict() for a in self.attributes], "key": self.key.name, "label_attribute": self.label_attribute.name, "order_attribute": self.order_attribute.name, "order": self.order, "role": self.role, "cardinality": self.cardinality, "info": self.info}
        return {k: v for k, v in found.items() if v}


@dataclass
class Hierarchy:
    """An order of levels from coarse to fine. Its paths are keys of its first levels."""

    name: str
    levels: list[Level]
    label: str | None = None
    info: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.levels)

    @property
    def level_names(self) -> list[str]:
        return [x.name for x in self.levels]

    def level(self, name: str | Level) -> Level:
        return self.levels[self.level_index(name)]

    def level_index(self, level: str | Level) -> int:
        name = level if isinstance(level, str) else level.name
        for i, x in enumerate(self.levels):
            if x.name == name:
                return i
        raise HierarchyError(f"hierarchy '{self.name}' has no level '{name}'")

    def next_level(self, level: str | Level | None) -> Level | None:
        at = 0 if level is None else self.level_index(level) + 1
        return self.levels[at] if at < len(self.levels) else None

    def previous_level(self, level: str | Level | None) -> Level | None:
        at = -1 if level is None else self.level_index(level) - 1
        return self.levels[at] if at >= 0 else None

    def is_last(self, level: str | Level) -> bool:
        return self.level_index(level) == len(self.levels) - 1

    def levels_for_depth(self, depth: int, drilldown: bool = False) -> list[Level]:
        """The first ``depth`` levels, one more with ``drilldown``."""
        depth += bool(drilldown)
        if depth > len(self.levels):
            raise HierarchyError(f"depth {depth} is beyond the {len(self.levels)} levels of hierarchy '{self.name}'")
        return self.levels[:depth]

    def levels_for_path(self, path, drilldown: bool = False) -> list[Level]:
        return self.levels_for_depth(len(path or ()), drilldown)

    def path_is_base(self, path) -> bool:
        return path is not None and len(path) == len(self.levels)

    def rollup(self, path, level: str | Level | None = None) -> list:
        """The path shortened to ``level``, or by one element."""
        if level is None:
            if not path:
                raise HierarchyError("an empty path cannot be rolled up")
            return list(path[:-1])
        depth = self.level_index(level) + 1
        if depth > len(path):
            raise HierarchyError(f"path {list(path)} is above level '{level if isinstance(level, str) else level.name}'")
        return list(path[:depth])

    @property
    def keys(self) -> list[Attribute]:
        return [x.key for x in self.levels]

    @property
    def attributes(self) -> list[Attribute]:
        return [a for x in self.levels for a in x.attributes]

    def to_dict(self) -> dict:
        return {k: v for k, v in {"name": self.name, "label": self.label, "levels": self.level_names, "info": self.info}.items() if v}


@dataclass
class Dimension:
    name: str
    levels: list[Level]
    hierarchies: dict[str, Hierarchy]
    default_hierarchy_name: str | None = None
    label: str | None = None
    description: str | None = None
    info: dict = field(default_factory=dict)
    role: str | None = None
    cardinality: str | None = None
    nonadditive: str | None = None
    category: str | None = None
    master: str | None = None

    def hierarchy(self, name: str | Hierarchy | None = None) -> Hierarchy:
        """The named hierarchy; by default the one that the model names, else "default", else the first."""
        if isinstance(name, Hierarchy):
            return name
        name = name or self.default_hierarchy_name or ("default" if "default" in self.hierarchies else next(iter(self.hierarchies), None))
        if name not in self.hierarchies:
            raise HierarchyError(f"dimension '{self.name}' has no hierarchy '{name}'")
        return self.hierarchies[name]

    def level(self, name: str) -> Level:
        for x in self.levels:
            if x.name == name:
                return x
        raise HierarchyError(f"dimension '{self.name}' has no level '{name}'")

    @property
    def attributes(self) -> list[Attribute]:
        return [a for x in self.levels for a in x.attributes]

    @property
    def key_attributes(self) -> list[Attribute]:
        return [x.key for x in self.levels]

    def attribute(self, name: str) -> Attribute:
        for a in self.attributes:
            if name in (a.name, a.ref):
                return a
        raise NoSuchAttributeError(name, f"in dimension '{self.name}'")

    @property
    def is_flat(self) -> bool:
        return len(self.levels) == 1

    @property
    def has_details(self) -> bool:
        return any(x.has_details for x in self.levels)

    @property
    def is_time(self) -> bool:
        return self.role in TIME_ROLES

    @classmethod
    def from_metadata(cls, desc, templates: dict[str, Dimension] | None = None) -> Dimension:
        """From a name (a flat dimension) or a dictionary, which may build on a template."""
        if isinstance(desc, str):
            desc = {"name": desc}
        desc = dict(desc)
        name = desc.get("name") or desc.get("template")
        if not name:
            raise ModelError(f"dimension without a name: {desc}")
        master = None
        if desc.get("template"):
            template = (templates or {}).get(desc["template"])
            if template is None:
                raise TemplateRequired(desc["template"])
            own = {"levels": [x.to_dict() for x in template.levels], "hierarchies": [h.to_dict() for h in template.hierarchies.values()]}
            own |= {k: getattr(template, k) for k in ("default_hierarchy_name", "label", "description", "info", "role", "cardinality", "nonadditive", "category") if getattr(template, k)}
            if "hierarchy" in desc:
                own.pop("hierarchies")
                own.pop("default_hierarchy_name", None)
            desc, master = own | desc, template.name
        if "hierarchy" in desc and "hierarchies" in desc:
            raise ModelError(f"dimension '{name}' has both hierarchy and hierarchies")
        if desc.get("cardinality") not in CARDINALITIES:
            raise ModelError(f"dimension '{name}' has unknown cardinality '{desc['cardinality']}'")
        if desc.get("levels") is not None and not desc["levels"]:
            raise ModelError(f"dimension '{name}' has no levels")
        if desc.get("attributes") and desc.get("levels"):
            raise ModelError(f"dimension '{name}' has both attributes and levels")
        levels = [Level.from_metadata(x, name) for x in desc.get("levels") or [{"name": name, "attributes": desc.get("attributes")}]]
        by_name = {x.name: x for x in levels}
        if len(by_name) != len(levels):
            raise ModelError(f"levels repeat in dimension '{name}'")
        specs = desc.get("hierarchies") or [desc.get("hierarchy") or [x.name for x in levels]]
        hierarchies: dict[str, Hierarchy] = {}
        for spec in specs:
            if isinstance(spec, (list, tuple)):
                spec = {"name": "default", "levels": list(spec)}
            own_name = spec.get("name") or "default"
            if not spec.get("levels"):
                raise ModelError(f"hierarchy '{own_name}' of dimension '{name}' has no levels")
            if missing := [x for x in spec["levels"] if (x if isinstance(x, str) else x["name"]) not in by_name]:
                raise ModelError(f"hierarchy '{own_name}' of dimension '{name}' has unknown levels {missing}")
            if own_name in hierarchies:
                raise ModelError(f"hierarchy '{own_name}' repeats in dimension '{name}'")
            hierarchies[own_name] = Hierarchy(own_name, [by_name[x if isinstance(x, str) else x["name"]] for x in spec["levels"]], spec.get("label"), spec.get("info") or {})
        used = {x.name for h in hierarchies.values() for x in h.levels}
        levels = [x for x in levels if x.name in used]
        names = [a.name for x in levels for a in x.attributes]
        if len(set(names)) != len(names):
            raise ModelError(f"attributes repeat in dimension '{name}'")
        if desc.get("role") in TIME_ROLES:
            for x in levels:
                if x.role is None and x.name in CALENDAR_ROLES:
                    x.role = x.name
        for x in levels:
            x.nonadditive = x.nonadditive or desc.get("nonadditive")
        default = desc.get("default_hierarchy_name")
        if default and default not in hierarchies:
            raise HierarchyError(f"dimension '{name}' has no hierarchy '{default}'")
        return cls(name, levels, hierarchies, default, desc.get("label"), desc.get("description"), desc.get("info") or {}, desc.get("role"), desc.get("cardinality"), desc.get("nonadditive"), desc.get("category"), master)

    def clone(self, hierarchies=None, exclude_hierarchies=None, nonadditive=None, default_hierarchy_name=None, cardinality=None, alias=None) -> Dimension:
        """A copy as a cube links it: fewer hierarchies, other properties, another name."""
        if hierarchies == []:
            raise ModelInconsistencyError(f"no hierarchy of dimension '{self.name}' is linked")
        if hierarchies and exclude_hierarchies:
            raise ArgumentError("both hierarchies and exclude_hierarchies are given")
        names = list(hierarchies or self.hierarchies)
        chosen = [self.hierarchy(h) for h in names if h not in (exclude_hierarchies or [])]
        if not chosen:
            raise ModelInconsistencyError(f"no hierarchy of dimension '{self.name}' is left")
        used = {x.name for h in chosen for x in h.levels}
        name = alias or self.name
        levels = {}
        for x in self.levels:
            if x.name in used:
                y = copy.copy(x)
                y.attributes = [a.owned_by(name) for a in x.attributes]
                at = {a.name: a for a in y.attributes}
                y.key, y.label_attribute, y.order_attribute = at[x.key.name], at[x.label_attribute.name], at[x.order_attribute.name]
                y.nonadditive = nonadditive or x.nonadditive
                levels[x.name] = y
        out = copy.copy(self)
        out.name, out.levels = name, list(levels.values())
        out.hierarchies = {h.name: Hierarchy(h.name, [levels[x.name] for x in h.levels], h.label, h.info) for h in chosen}
        kept = default_hierarchy_name or self.default_hierarchy_name
        if default_hierarchy_name and kept not in out.hierarchies:
            raise HierarchyError(f"dimension '{self.name}' has no hierarchy '{kept}'")
        out.default_hierarchy_name = kept if kept in out.hierarchies else next(iter(out.hierarchies))
        out.nonadditive = nonadditive or self.nonadditive
        out.cardinality = cardinality or self.cardinality
        out.master = self.name
        return out

    def to_dict(self) -> dict:
        found = {"name": self.name, "label": self.label, "description": self.description, "role": self.role, "cardinality": self.cardinality, "nonadditive": self.nonadditive, "category": self.category, "info": self.info, "levels": [x.to_dict() for x in self.levels], "hierarchies": [h.to_dict() for h in self.hierarchies.values()], "default_hierarchy_name": self.hierarchy().name}
        return {k: v for k, v in found.items() if v} | {"is_flat": self.is_flat, "has_details": self.has_details}


def split_dimension_spec(spec: str) -> tuple[str, str | None, str | None]:
    """``dimension[@hierarchy][:level]`` in its parts."""
    rest, _, level = spec.partition(":")
    name, _, hierarchy = rest.partition("@")
    if not name.strip() or (":" in spec and not level) or ("@" in rest and not hierarchy):
        raise ArgumentError(f"'{spec}' is not of the form dimension@hierarchy:level")
    return name.strip(), hierarchy or None, level or None
