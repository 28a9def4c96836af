"""Cells: conjunctions of cuts over dimensions, and their texts and dictionaries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from ..errors import ArgumentError, HierarchyError
from ..model import Cube, Dimension
from ..model.dimension import split_dimension_spec

Path = list
NULL = "__null__"


@dataclass(frozen=True)
class Cut:
    """A restriction of one dimension. ``hierarchy`` None is the default one."""

    dimension: str
    hierarchy: str | None = None
    invert: bool = False
    hidden: bool = False

    def _value(self) -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return f"{'!' if self.invert else ''}{self.dimension}{'@' + self.hierarchy if self.hierarchy else ''}:{self._value()}"

    def level_depth(self) -> int:
        raise NotImplementedError

    def to_dict(self) -> dict:
        return {"type": self.type, "dimension": self.dimension, "hierarchy": self.hierarchy, "level_depth": self.level_depth(), "invert": self.invert, "hidden": self.hidden}


@dataclass(frozen=True)
class PointCut(Cut):
    path: tuple = ()
    type = "point"

    def __init__(self, dimension, path, hierarchy=None, invert=False, hidden=False):
        _init(self, dimension, hierarchy, invert, hidden, path=tuple(path))

    def _value(self) -> str:
        return string_from_path(self.path)

    def level_depth(self) -> int:
        return len(self.path)

    def to_dict(self) -> dict:
        return super().to_dict() | {"path": list(self.path)}


@dataclass(frozen=True)
class SetCut(Cut):
    paths: tuple = ()
    type = "set"

    def __init__(self, dimension, paths, hierarchy=None, invert=False, hidden=False):
        _init(self, dimension, hierarchy, invert, hidden, paths=tuple(tuple(p) for p in paths))

    def _value(self) -> str:
        return ";".join(map(string_from_path, self.paths))

    def level_depth(self) -> int:
        return max((len(p) for p in self.paths), default=0)

    def to_dict(self) -> dict:
        return super().to_dict() | {"paths": [list(p) for p in self.paths]}


@dataclass(frozen=True)
class RangeCut(Cut):
    """Both ends count; an empty end is open."""

    from_path: tuple = ()
    to_path: tuple = ()
    type = "range"

    def __init__(self, dimension, from_path, to_path, hierarchy=None, invert=False, hidden=False):
        _init(self, dimension, hierarchy, invert, hidden, from_path=tuple(from_path or ()), to_path=tuple(to_path or ()))

    def _value(self) -> str:
        return f"{string_from_path(self.from_path)}-{string_from_path(self.to_path)}"

    def level_depth(self) -> int:
        return max(len(self.from_path), len(self.to_path))

    def to_dict(self) -> dict:
        return super().to_dict() | {"from": list(self.from_path), "to": list(self.to_path)}


def _init(cut, dimension, hierarchy, invert, hidden, **own) -> None:
    if not isinstance(dimension, str):
        dimension = dimension.name
    if hierarchy is not None and not isinstance(hierarchy, str):
        hierarchy = hierarchy.name
    for k, v in {"dimension": dimension, "hierarchy": hierarchy, "invert": bool(invert), "hidden": bool(hidden), **own}.items():
        object.__setattr__(cut, k, v)


# Texts

_SPECIAL = re.compile(r"([\\:;,|\-])")


def _scan(text: str, at: str) -> list[str]:
    """``text`` split at the character ``at`` where no backslash takes its meaning; backslashes stay."""
    parts, i = [""], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            parts[-1] += text[i : i + 2]
            i += 2
        elif text[i] == at:
            parts.append("")
            i += 1
        else:
            parts[-1] += text[i]
            i += 1
    return parts


def path_from_string(text: str | None) -> list:
    if not text:
        return []
    values = [re.sub(r"\\(.)", r"\1", x) for x in _scan(text, ",")]
    return [None if v == NULL else v for v in values]


def string_from_path(path: Iterable | None) -> str:
    return ",".join(NULL if v is None else _SPECIAL.sub(r"\\\1", str(v)) for v in path or ())


#: (dimension, hierarchy, path) -> path
Converter = Callable[[Any, Any, list], list]


def cut_from_string(text: str, cube: Cube | None = None, converters: dict[str, Converter] | None = None, role_converters: dict[str, Converter] | None = None) -> Cut:
    """A cut from ``[!]dimension[@hierarchy]:value``: ``a,b`` is a point, ``a,b;c`` a set, and ``a-b``, ``a-`` or ``-b`` a range. A backslash takes its meaning from a character."""
    head, *rest = _scan(text, ":")
    if not rest:
        raise ArgumentError(f"cut '{text}' has no value")
    value = ":".join(rest)
    invert = head.startswith("!")
    name, hierarchy, _ = split_dimension_spec(re.sub(r"\\(.)", r"\1", head.lstrip("!")))
    convert = (converters or {}).get(name)
    if cube is not None:
        dimension = cube.dimension(name)
        hierarchy = dimension.hierarchy(hierarchy).name
        convert = convert or (role_converters or {}).get(dimension.role)
    else:
        dimension = name

    def path(x: str) -> list:
        found = path_from_string(x)
        return convert(dimension, cube.dimension(name).hierarchy(hierarchy) if cube is not None else hierarchy, found) if convert and found else found

    if value == "":
        return PointCut(name, [""], hierarchy, invert)
    several, ends = _scan(value, ";"), _scan(value, "-")
    if len(several) > 1:
        if len(ends) > 1:
            raise ArgumentError(f"cut '{text}' is both a set and a range")
        return SetCut(name, [path(x) for x in several], hierarchy, invert)
    if len(ends) == 1:
        return PointCut(name, path(value), hierarchy, invert)
    if len(ends) > 2:
        raise ArgumentError(f"cut '{text}' has more than two ends")
    return RangeCut(name, path(ends[0]), path(ends[1]), hierarchy, invert)


def cuts_from_string(text: str | None, cube: Cube | None = None, converters=None, role_converters=None) -> list[Cut]:
    return [cut_from_string(x, cube, converters, role_converters) for x in _scan(text, "|")] if text else []


def string_from_cuts(cuts: Iterable[Cut]) -> str:
    return "|".join(map(str, cuts))


def cut_from_dict(desc: dict | str, cube: Cube | None = None) -> Cut:
    """The inverse of ``Cut.to_dict``; JSON will do."""
    if isinstance(desc, str):
        desc = json.loads(desc)
    name = desc["dimension"]
    if cube is not None:
        cube.dimension(name)
    rest = (desc.get("hierarchy"), desc.get("invert", False), desc.get("hidden", False))
    kind = (desc.get("type") or "").lower()
    if kind == "point":
        return PointCut(name, desc["path"], *rest)
    if kind == "set":
        return SetCut(name, desc["paths"], *rest)
    if kind == "range":
        return RangeCut(name, desc.get("from"), desc.get("to"), *rest)
    raise ArgumentError(f"unknown kind of cut '{desc.get('type')}'")


# Cells


class Cell:
    """Cuts of one cube, all of which hold. Operations return new cells."""

    def __init__(self, cube: Cube | None = None, cuts: Iterable[Cut] | str | None = None):
        self.cube = cube
        self.cuts: list[Cut] = cuts_from_string(cuts, cube) if isinstance(cuts, str) else list(cuts or [])

    def _name(self, dimension) -> str:
        d = self.cube.dimension(dimension) if self.cube is not None else dimension
        return d if isinstance(d, str) else d.name

    def _dimension(self, name) -> Dimension:
        if self.cube is None:
            raise ArgumentError("the cell has no cube")
        return self.cube.dimension(name)

    def __and__(self, other: Cell) -> Cell:
        if self.cube is not None and other.cube is not None and self.cube.name != other.cube.name:
            raise ArgumentError(f"cells of marts '{self.cube.name}' and '{other.cube.name}' do not combine")
        return Cell(self.cube or other.cube, [*self.cuts, *other.cuts])

    def slice(self, cut: Cut) -> Cell:
        """With ``cut`` in the place of an earlier one of its dimension."""
        if not isinstance(cut, Cut):
            raise ArgumentError(f"{cut!r} is not a cut")
        self._name(cut.dimension)
        cuts = list(self.cuts)
        for i, old in enumerate(cuts):
            if old.dimension == cut.dimension:
                cuts[i] = cut
                return Cell(self.cube, cuts)
        return Cell(self.cube, [*cuts, cut])

    def point_slice(self, dimension, path) -> Cell:
        return self.slice(PointCut(self._name(dimension), path))

    def multi_slice(self, cuts: Iterable[Cut]) -> Cell:
        if isinstance(cuts, dict):
            raise ArgumentError("cuts are a list")
        out = self
        for c in cuts:
            out = out.slice(c)
        return out

    def drilldown(self, dimension, value, hierarchy=None) -> Cell:
        """One level deeper: the dimension's point cut with ``value`` after its path."""
        d = self._dimension(dimension)
        old = self.point_cut_for_dimension(d.name)
        h = d.hierarchy(hierarchy or (old.hierarchy if old else None))
        path = [*(old.path if old else ()), value]
        if len(path) > len(h):
            raise HierarchyError(f"dimension '{d.name}' has nothing below {list(old.path)}")
        return self.slice(PointCut(d.name, path, old.hierarchy if old and not hierarchy else h.name if hierarchy else None))

    def cut_for_dimension(self, dimension) -> Cut | None:
        name = self._name(dimension)
        return next((c for c in self.cuts if c.dimension == name), None)

    def point_cut_for_dimension(self, dimension) -> PointCut | None:
        name = self._name(dimension)
        return next((c for c in self.cuts if c.dimension == name and isinstance(c, PointCut)), None)

    def dimension_cuts(self, dimension, exclude: bool = False) -> list[Cut]:
        name = self._name(dimension)
        return [c for c in self.cuts if (c.dimension == name) != exclude]

    def rollup_dim(self, dimension, level=None, hierarchy=None) -> Cell:
        """With the dimension's point cut shortened to ``level``, by default by one; without it at the top."""
        d = self._dimension(dimension)
        old = self.point_cut_for_dimension(d.name)
        if old is None:
            return Cell(self.cube, self.cuts)
        path = d.hierarchy(hierarchy or old.hierarchy).rollup(old.path, level)
        if path:
            return self.slice(replace_path(old, path))
        return Cell(self.cube, [c for c in self.cuts if c is not old])

    def rollup(self, rollup: str | list | dict) -> Cell:
        """Rolls up one dimension, several, or each to the level that a dictionary names (None: by one). Other cuts stay."""
        items = [(rollup, None)] if isinstance(rollup, str) else rollup.items() if isinstance(rollup, dict) else [(x, None) for x in rollup]
        out = self
        for name, level in items:
            out = out.rollup_dim(name, level)
        return out

    def level_depths(self) -> dict[str, int]:
        depths: dict[str, int] = {}
        for c in self.cuts:
            depths[c.dimension] = max(depths.get(c.dimension, 0), c.level_depth())
        return depths

    def deepest_levels(self, include_empty: bool = False) -> list[tuple]:
        """(dimension, hierarchy, level) of each cut's deepest level."""
        found = []
        for c in self.cuts:
            d = self._dimension(c.dimension)
            h = d.hierarchy(c.hierarchy)
            depth = c.level_depth()
            if depth or include_empty:
                found.append((d, h, h.levels[depth - 1] if depth else None))
        return found

    def contains_level(self, dimension, level, hierarchy=None) -> bool:
        d = self._dimension(dimension)
        h = d.hierarchy(hierarchy)
        return any(x[0].name == d.name and x[1].name == h.name and h.level_index(level) <= h.level_index(x[2]) for x in self.deepest_levels())

    def is_base(self, dimension, hierarchy=None) -> bool:
        """Whether the dimension is cut down to a single member of its last level."""
        c = self.point_cut_for_dimension(dimension)
        return bool(c) and self._dimension(dimension).hierarchy(hierarchy or c.hierarchy).path_is_base(c.path)

    def public_cell(self) -> Cell:
        return Cell(self.cube, [c for c in self.cuts if not c.hidden])

    def to_dict(self) -> dict:
        return {"cube": self.cube.name if self.cube is not None else None, "cuts": [c.to_dict() for c in self.cuts]}

    def to_str(self) -> str:
        return string_from_cuts(self.cuts)

    def __eq__(self, other) -> bool:
        same = lambda a, b: len(a) == len(b) and all(a.count(x) == b.count(x) for x in a)
        return isinstance(other, Cell) and (self.cube.name if self.cube else None) == (other.cube.name if other.cube else None) and same(self.cuts, other.cuts)

    __hash__ = None

    def __bool__(self) -> bool:
        return bool(self.cuts)

    def __str__(self) -> str:
        return self.to_str()

    def __repr__(self) -> str:
        return f"Cell({self.to_str() or 'all'})"


def replace_path(cut: PointCut, path) -> PointCut:
    return PointCut(cut.dimension, path, cut.hierarchy, cut.invert, cut.hidden)


def hidden(cut: Cut) -> Cut:
    return type(cut)(**(cut.__dict__ | {"hidden": True}))
