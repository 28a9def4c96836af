"""Who may see which marts, and which cells of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import ConfigurationError, NotAuthorized
from .model import Cube
from .model.dimension import split_dimension_spec
from .plans.cells import Cell, PointCut, cut_from_dict, cut_from_string, hidden

ALL = "*"


@dataclass
class Right:
    """Marts by name, by ``prefix*``, by ``*suffix`` or all by ``*``; cuts and hierarchies' deepest levels by cube, ``*`` for all."""

    roles: set[str] = field(default_factory=set)
    allowed: set[str] = field(default_factory=set)
    denied: set[str] = field(default_factory=set)
    cells: dict[str, list] = field(default_factory=dict)
    limits: dict[str, list] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, desc: dict) -> Right:
        return cls(set(desc.get("roles") or ()), set(desc.get("allowed_marts") or ()), set(desc.get("denied_marts") or ()), {k: list(v) for k, v in (desc.get("cell_restrictions") or {}).items()}, {k: list(v) for k, v in (desc.get("hierarchy_limits") or {}).items()})

    def merge(self, other: Right) -> None:
        self.roles |= other.roles
        self.allowed |= other.allowed
        self.denied |= other.denied
        for mine, theirs in ((self.cells, other.cells), (self.limits, other.limits)):
            for cube, items in theirs.items():
                mine[cube] = mine.get(cube, []) + [x for x in items if x not in mine.get(cube, [])]

    @staticmethod
    def _matches(patterns: set[str], name: str) -> bool:
        return any(p in (ALL, name) or (p.endswith(ALL) and name.startswith(p[:-1])) or (p.startswith(ALL) and name.endswith(p[1:])) for p in patterns)

    def allows(self, name: str, allow_after_deny: bool) -> bool:
        """With ``deny_allow`` what is allowed counts over what is denied, with ``allow_deny`` the other way. Without any allowed cube, all are that are not denied."""
        allowed, denied = self._matches(self.allowed, name), self._matches(self.denied, name)
        if allow_after_deny:
            return allowed or (not denied and not self.allowed)
        return not denied and (allowed or not self.allowed)


class Authorizer:
    """Everything for everyone; a base to build on."""

    def authorize(self, identity, marts: list) -> list:
        return list(marts)

    def restricted_cell(self, identity, cube: Cube, cell: Cell | None) -> Cell:
        return cell or Cell(cube)

    def hierarchy_limits(self, identity, cube: str) -> list[tuple]:
        return []


class SimpleAuthorizer(Authorizer):
    """Rights by identity, built from those of its roles. ``identity_dimension`` cuts every cell to the identity's own member; a guest's rights hold for unknown identities."""

    def __init__(self, rights: dict | None = None, roles: dict | None = None, order: str = "deny_allow", identity_dimension: str | None = None, guest: str | None = None):
        if order not in ("deny_allow", "allow_deny"):
            raise ConfigurationError(f"unknown order of rights '{order}'")
        self.allow_after_deny = order == "deny_allow"
        self.guest = guest
        self.identity_dimension = split_dimension_spec(identity_dimension)[:2] if identity_dimension else None
        made = {n: Right.from_dict(d) for n, d in (roles or {}).items()}
        self.roles: dict[str, Right] = {}

        def role(name: str, trail: tuple[str, ...]) -> Right:
            if name in trail:
                raise ConfigurationError("roles go in a circle: " + " -> ".join((*trail, name)))
            if name not in made:
                raise ConfigurationError(f"unknown role '{name}'")
            if name not in self.roles:
                right = made[name]
                for other in sorted(right.roles):
                    right.merge(role(other, (*trail, name)))
                self.roles[name] = right
            return self.roles[name]

        for n in made:
            role(n, ())
        self.rights: dict[str, Right] = {}
        for identity, desc in (rights or {}).items():
            right = Right.from_dict(desc)
            for n in sorted(right.roles):
                right.merge(role(n, ()))
            self.rights[identity] = right

    def right(self, identity) -> Right:
        for name in (identity, self.guest):
            if name is not None and name in self.rights:
                return self.rights[name]
        raise NotAuthorized(f"no rights for '{identity}'")

    def authorize(self, identity, marts: list) -> list:
        try:
            right = self.right(identity)
        except NotAuthorized:
            return []
        return [c for c in marts if right.allows(c if isinstance(c, str) else c.name, self.allow_after_deny)]

    def restricted_cell(self, identity, cube: Cube, cell: Cell | None) -> Cell:
        """The cell with hidden cuts to what the identity may see."""
        right = self.right(identity)
        cuts = [hidden(cut_from_string(x, cube) if isinstance(x, str) else cut_from_dict(x, cube)) for name in (cube.name, ALL) for x in right.cells.get(name, [])]
        if self.identity_dimension and self.identity_dimension[0] in cube.dimensions:
            name, hierarchy = self.identity_dimension
            cuts.append(PointCut(name, [identity], cube.dimension(name).hierarchy(hierarchy).name, hidden=True))
        return (cell or Cell(cube)) & Cell(cube, cuts)

    def hierarchy_limits(self, identity, cube: str) -> list[tuple]:
        """(dimension, hierarchy, level) below which the identity may not see."""
        right = self.right(identity)
        return [split_dimension_spec(x) if isinstance(x, str) else tuple(x) for n in (cube, ALL) for x in right.limits.get(n, [])]

    def limited(self, identity, cube: Cube) -> Cube:
        """The cube without the levels below the identity's limits."""
        import copy

        out = copy.copy(cube)
        out.dimensions = dict(cube.dimensions)
        for name, hierarchy, level in self.hierarchy_limits(identity, cube.name):
            if name not in out.dimensions or level is None:
                continue
            d = copy.deepcopy(out.dimensions[name])
            h = d.hierarchy(hierarchy)
            h.levels = h.levels[: h.level_index(level) + 1]
            used = {x.name for y in d.hierarchies.values() for x in y.levels}
            d.levels = [x for x in d.levels if x.name in used]
            out.dimensions[name] = d
        return out
