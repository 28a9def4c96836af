"""Marts."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import ArgumentError, ModelError, NoSuchAttributeError, NoSuchDimensionError
from .attributes import Attribute, Measure, MeasureAggregate
from .dimension import Dimension

#: Labels of aggregates that have none.
FUNCTION_LABELS = {
    "count": "Count of {}", "count_nonempty": "Non-empty count of {}", "count_distinct": "Distinct count of {}", "sum": "Sum of {}", "min": "Minimum of {}",
    "max": "Maximum of {}", "avg": "Average of {}", "stddev": "Standard deviation of {}", "variance": "Variance of {}",
}


@dataclass
class Cube:
    name: str
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    measures: list[Measure] = field(default_factory=list)
    aggregates: list[MeasureAggregate] = field(default_factory=list)
    details: list[Attribute] = field(default_factory=list)
    label: str | None = None
    description: str | None = None
    info: dict = field(default_factory=dict)
    category: str | None = None
    fact: str | None = None
    key: str | None = None
    joins: list = field(default_factory=list)
    mappings: dict = field(default_factory=dict)
    links: list[dict] = field(default_factory=list)
    browser_options: dict = field(default_factory=dict)
    store: str | None = None
    locale: str | None = None
    namespace: str | None = None

    @classmethod
    def from_metadata(cls, desc: dict) -> Cube:
        """A cube without its dimensions, which ``link`` adds."""
        if not desc.get("name"):
            raise ModelError("cube without a name")
        measures = [Measure.from_metadata(m, **({} if not isinstance(m, dict) or m.get("nonadditive") else {"nonadditive": desc.get("nonadditive")})) for m in desc.get("measures") or []]
        aggregates = [MeasureAggregate.from_metadata(a) for a in desc.get("aggregates") or []]
        by_measure = {m.name: m for m in measures}
        for a in aggregates:
            if (m := by_measure.get(a.measure)) is not None:
                a.nonadditive = a.nonadditive or m.nonadditive
        if desc.get("implicit_aggregates"):
            names = {a.name: a for a in aggregates}
            for m in measures:
                for a in m.default_aggregates():
                    old = names.get(a.name)
                    if old is None:
                        aggregates.append(a)
                    elif old.function and (old.function, old.measure) != (a.function, a.measure):
                        raise ModelError(f"aggregate '{a.name}' of cube '{desc['name']}' differs from what measure '{m.name}' makes by that name")
        if not measures and not aggregates:
            aggregates = [MeasureAggregate("fact_count", label="Count", function="count")]
        for a in aggregates:
            if a.label is None and a.function in FUNCTION_LABELS and a.measure:
                m = by_measure.get(a.measure)
                a.label = FUNCTION_LABELS[a.function].format(m.label or m.name if m else a.measure)
        names = [x.name for x in (*measures, *aggregates)]
        for kind in (measures, aggregates):
            own = [x.name for x in kind]
            if len(set(own)) != len(own):
                raise ModelError(f"names of measures or aggregates repeat in cube '{desc['name']}': {names}")
        links = [{"name": x} if isinstance(x, str) else dict(x) for x in desc.get("dimensions") or []]
        options = {k: desc[k] for k in ("label", "description", "category", "fact", "key", "store", "locale") if desc.get(k)}
        return cls(
            desc["name"], measures=measures, aggregates=aggregates, details=[Attribute.from_metadata(d) for d in desc.get("details") or []], info=desc.get("info") or {},
            joins=list(desc.get("joins") or []), mappings=dict(desc.get("mappings") or {}), links=links, browser_options=dict(desc.get("browser_options") or {}), **options,
        )

    def link(self, find) -> Cube:
        """Links dimensions; ``find(name)`` has each by its name. One may be linked twice under different aliases."""
        for spec in self.links:
            d = find(spec["name"])
            given = {k: spec[k] for k in ("hierarchies", "exclude_hierarchies", "nonadditive", "default_hierarchy_name", "cardinality", "alias") if spec.get(k) is not None}
            d = d.clone(**given) if given else d
            if d.name in self.dimensions:
                raise ModelError(f"dimension '{d.name}' is linked twice in cube '{self.name}'")
            self.dimensions[d.name] = d
        return self

    def dimension(self, name: str | Dimension) -> Dimension:
        if isinstance(name, Dimension):
            return name
        if name not in self.dimensions:
            raise NoSuchDimensionError(name, f"in cube '{self.name}'")
        return self.dimensions[name]

    def measure(self, name: str) -> Measure:
        return _named(self.measures, name, f"measure of cube '{self.name}'")

    def aggregate(self, name: str) -> MeasureAggregate:
        return _named(self.aggregates, name, f"aggregate of cube '{self.name}'")

    def aggregates_of(self, measures) -> list[MeasureAggregate]:
        chosen = set(measures)
        return [a for a in self.aggregates if a.measure in chosen]

    @property
    def dimension_attributes(self) -> list[Attribute]:
        return [a for d in self.dimensions.values() for a in d.attributes]

    @property
    def fact_attributes(self) -> list[Attribute]:
        return [*self.measures, *self.details]

    @property
    def row_attributes(self) -> list[Attribute]:
        """All that a fact has a value of."""
        return [*self.dimension_attributes, *self.fact_attributes]

    def attribute(self, ref: str | Attribute) -> Attribute:
        """By reference, by name if that is unique, or by the name of a flat dimension."""
        if isinstance(ref, Attribute):
            return ref
        found = {a.ref: a for a in (*self.aggregates, *self.row_attributes)}
        if ref in found:
            return found[ref]
        if ref in self.dimensions and self.dimensions[ref].is_flat:
            return self.dimensions[ref].levels[0].key
        raise NoSuchAttributeError(ref, f"in cube '{self.name}'")

    def attributes(self, refs) -> list[Attribute]:
        return [self.attribute(r) for r in refs]

    def validate(self) -> list[tuple[str, str, str]]:
        """(severity, where, what) of what is odd in the model."""
        issues = []
        if not self.mappings and not self.dimensions:
            issues.append(("warning", self.name, "the cube has no dimensions"))
        names = {m.name for m in self.measures} | {a.name for a in self.aggregates}
        for a in self.aggregates:
            if a.function and a.function != "count" and not a.measure:
                issues.append(("error", a.name, f"function '{a.function}' has no measure"))
            if a.measure and a.measure not in names:
                issues.append(("error", a.name, f"measure '{a.measure}' is not in the cube"))
        for d in self.dimensions.values():
            if len(d.hierarchies) > 1 and not d.default_hierarchy_name:
                issues.append(("warning", d.name, "no default hierarchy is named"))
            for h in d.hierarchies.values():
                if not h.levels:
                    issues.append(("error", d.name, f"hierarchy '{h.name}' has no levels"))
        return issues

    def to_dict(self) -> dict:
        found = {"name": self.name, "label": self.label, "description": self.description, "category": self.category, "info": self.info, "fact": self.fact, "key": self.key, "store": self.store, "locale": self.locale, "browser_options": self.browser_options}
        return {k: v for k, v in found.items() if v} | {
            "dimensions": [d.to_dict() for d in self.dimensions.values()], "measures": [m.to_dict() for m in self.measures], "aggregates": [a.to_dict() for a in self.aggregates], "details": [d.to_dict() for d in self.details],
        }


def _named(items, name, where: str):
    if not isinstance(name, str):
        return name
    for x in items:
        if x.name == name:
            return x
    raise NoSuchAttributeError(name, where)


def check_direction(order: str | None) -> str:
    """"asc" or "desc"; none is ascending."""
    low = (order or "asc").lower()
    if low.startswith("asc"):
        return "asc"
    if low.startswith("desc"):
        return "desc"
    raise ArgumentError(f"unknown order direction '{order}'")
