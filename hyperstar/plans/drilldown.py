"""What to group by: dimensions and the levels down to which each is shown."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ArgumentError, HierarchyError
from ..model import Attribute, Cube, Dimension, Hierarchy, Level
from ..model.dimension import split_dimension_spec
from .cells import Cell, PointCut, SetCut


@dataclass(frozen=True)
class DrilldownItem:
    dimension: Dimension
    hierarchy: Hierarchy
    levels: list[Level]

    @property
    def keys(self) -> list[str]:
        return [x.key.ref for x in self.levels]

    @property
    def attributes(self) -> list[Attribute]:
        return [a for x in self.levels for a in x.attributes]

    def __str__(self) -> str:
        return f"{self.dimension.name}@{self.hierarchy.name}:{self.levels[-1].name if self.levels else ''}"


class Drilldown:
    """Resolved against a cube and a cell. An item is ``dimension[@hierarchy][:level]``, a dimension (down to its last level), or a tuple of dimension, hierarchy and level; a dictionary maps dimensions to levels. Without a level a flat dimension is shown whole, any other one level below its point cut."""

    def __init__(self, drilldown, cell: Cell):
        if isinstance(drilldown, Drilldown):
            self.items = drilldown.items
            return
        if isinstance(drilldown, str):
            drilldown = [x for x in drilldown.split("|") if x]
        if isinstance(drilldown, dict):
            drilldown = [(d, None, x) for d, x in drilldown.items()]
        self.items: list[DrilldownItem] = [self._resolved(x, cell) for x in drilldown or []]
        names = [x.dimension.name for x in self.items]
        if len(set(names)) != len(names):
            raise ArgumentError(f"dimensions repeat in the drilldown: {names}")

    @staticmethod
    def _resolved(item, cell: Cell) -> DrilldownItem:
        cube: Cube = cell.cube
        if isinstance(item, DrilldownItem):
            return item
        if isinstance(item, Dimension):
            h = item.hierarchy()
            return DrilldownItem(item, h, h.levels)
        name, hierarchy, level = split_dimension_spec(item) if isinstance(item, str) else (tuple(item) + (None, None))[:3]
        d = cube.dimension(name)
        h = d.hierarchy(hierarchy)
        if level is not None:
            return DrilldownItem(d, h, h.levels[: h.level_index(level) + 1])
        if d.is_flat:
            return DrilldownItem(d, h, h.levels)
        cut = cell.point_cut_for_dimension(d)
        depth = 1
        if cut is not None:
            if d.hierarchy(cut.hierarchy).name != h.name:
                raise HierarchyError(f"dimension '{d.name}' is cut by hierarchy '{d.hierarchy(cut.hierarchy).name}' and drilled down by '{h.name}'")
            depth = len(cut.path) if cut.invert else len(cut.path) + 1
        if depth > len(h):
            raise HierarchyError(f"hierarchy '{h.name}' of dimension '{d.name}' has no level below its cut")
        return DrilldownItem(d, h, h.levels[:depth])

    def __len__(self) -> int:
        return len(self.items)

    def __iter__(self):
        return iter(self.items)

    def item(self, dimension: str) -> DrilldownItem | None:
        return next((x for x in self.items if x.dimension.name == dimension), None)

    @property
    def attributes(self) -> list[Attribute]:
        return [a for x in self.items for a in x.attributes]

    @property
    def key_attributes(self) -> list[Attribute]:
        return [level.key for x in self.items for level in x.levels]

    def natural_order(self) -> list[tuple[Attribute, str]]:
        return [(level.order_attribute, level.order or level.order_attribute.order or "asc") for x in self.items for level in x.levels]

    def result_levels(self) -> dict[str, list[str]]:
        out = {}
        for x in self.items:
            key = x.dimension.name if x.hierarchy is x.dimension.hierarchy() else f"{x.dimension.name}@{x.hierarchy.name}"
            out[key] = [level.name for level in x.levels]
        return out

    def high_cardinality(self, cell: Cell) -> list[str]:
        """Shown levels that have many members and that no point or set cut restricts."""
        found = []
        for x in self.items:
            cut = cell.cut_for_dimension(x.dimension)
            if isinstance(cut, (PointCut, SetCut)):
                continue
            for level in x.levels:
                if level.cardinality == "high":
                    found.append(f"{x.dimension.name}:{level.name}")
            if x.dimension.cardinality == "high" and not any(n.startswith(x.dimension.name + ":") for n in found):
                found.append(x.dimension.name)
        return found
