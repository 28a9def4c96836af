"""Leaves of the model."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import ArgumentError, ExpressionError, ModelError

NONADDITIVE = (None, "none", "any", "time")


@dataclass
class Attribute:
    """A named value of a fact or of a dimension's level. ``dimension`` is that dimension's name, None for facts."""

    name: str
    label: str | None = None
    description: str | None = None
    order: str | None = None
    info: dict = field(default_factory=dict)
    format: str | None = None
    dimension: str | None = None
    locales: tuple[str, ...] = ()
    expression: str | None = None
    missing_value: Any = None

    #: How the kind is named in messages.
    kind = "attribute"

    @property
    def ref(self) -> str:
        return f"{self.dimension}.{self.name}" if self.dimension else self.name

    @property
    def is_localizable(self) -> bool:
        return bool(self.locales)

    @property
    def is_base(self) -> bool:
        """Whether it is a physical column."""
        return not self.expression

    def owned_by(self, dimension: str | None) -> Attribute:
        return replace(self, dimension=dimension)

    def to_dict(self) -> dict:
        skip = {"dimension"}
        found = {k: v for k, v in self.__dict__.items() if k not in skip and v not in (None, {}, (), [])}
        if "locales" in found:
            found["locales"] = list(found["locales"])
        return found | {"ref": self.ref}

    @classmethod
    def from_metadata(cls, desc, **extra):
        """From a name or a dictionary."""
        if isinstance(desc, str):
            desc = {"name": desc}
        if not isinstance(desc, dict):
            return replace(desc, **extra)
        if not desc.get("name"):
            raise ModelError(f"{cls.kind} has no name: {desc}")
        known = {k: v for k, v in desc.items() if k in cls.__dataclass_fields__ and v is not None}
        order = known.get("order")
        if order is not None:
            known["order"] = order = str(order).lower()
            if not order.startswith(("asc", "desc")):
                raise ArgumentError(f"order of '{desc['name']}' is '{order}', neither asc nor desc")
            known["order"] = "asc" if order.startswith("asc") else "desc"
        if "locales" in known:
            known["locales"] = tuple(known["locales"])
        return cls(**(known | extra))


@dataclass
class Measure(Attribute):
    """A number of a fact."""

    aggregates: list[str] | None = None
    nonadditive: str | None = None
    window_size: int | None = None

    kind = "measure"

    def __post_init__(self):
        if self.nonadditive not in NONADDITIVE:
            raise ModelError(f"measure '{self.name}' is nonadditive in unknown way '{self.nonadditive}'")

    def default_aggregates(self) -> list[MeasureAggregate]:
        """Aggregates by the functions that the measure lists, sum where it lists none. ``identity`` stands for the column itself."""
        return [
            MeasureAggregate(self.name, label=self.label, nonadditive=self.nonadditive, window_size=self.window_size)
            if f == "identity"
            else MeasureAggregate(f"{self.name}_{f}", measure=self.name, function=f, nonadditive=self.nonadditive, window_size=self.window_size)
            for f in self.aggregates or ["sum"]
        ]


@dataclass
class MeasureAggregate(Attribute):
    """A function of a measure over many facts, an expression of other aggregates, or a column that holds aggregated values already."""

    measure: str | None = None
    function: str | None = None
    nonadditive: str | None = None
    window_size: int | None = None

    kind = "aggregate"

    @property
    def is_base(self) -> bool:
        return not self.expression and not self.function


def in_order_of_dependency(attributes: Iterable[Attribute], needs) -> list[Attribute]:
    """The attributes with those that they need before them; ``needs(attribute)`` has names. Stable. Unknown names and circles are errors."""
    found = {a.ref: a for a in attributes}
    done: dict[str, bool] = {}
    out: list[Attribute] = []

    def visit(ref: str, trail: tuple[str, ...]) -> None:
        if ref in trail:
            raise ExpressionError("circular: " + " -> ".join((*trail[trail.index(ref) :], ref)))
        if ref in done:
            return
        if ref not in found:
            raise ExpressionError(f"unknown attribute '{ref}'" + (f" in '{trail[-1]}'" if trail else ""))
        for other in sorted(needs(found[ref])):
            visit(other, (*trail, ref))
        done[ref] = True
        out.append(found[ref])

    for ref in found:
        visit(ref, ())
    return out
