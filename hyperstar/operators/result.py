"""What an aggregation returns: lazy DataFrames with the means to fetch them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import ArgumentError
from ..plans.cells import Cell
from ..plans.drilldown import Drilldown
from ..plans.star import SPLIT


@dataclass(frozen=True)
class TableRow:
    """A member of a drilled-down dimension with its record."""

    key: Any
    label: Any
    path: list
    is_base: bool
    record: dict


@dataclass
class AggregationResult:
    """``cells_frame`` has a row per cell, ``summary_frame`` one row for the whole. Nothing runs before it is asked for, and each runs once."""

    cell: Cell
    aggregates: list[str]
    drilldown: Drilldown
    summary_frame: DataFrame | None = None
    cells_frame: DataFrame | None = None
    #: The cells before paging; counts them.
    all_cells_frame: DataFrame | None = None
    has_split: bool = False
    attributes: list[str] = field(default_factory=list)
    levels: dict[str, list[str]] = field(default_factory=dict)
    _summary: dict | None = None
    _cells: list[dict] | None = None
    _total: int | None = None

    @property
    def summary(self) -> dict:
        if self._summary is None:
            self._summary = self.summary_frame.first().asDict() if self.summary_frame is not None else {}
        return self._summary

    @property
    def cells(self) -> list[dict]:
        """All cells on the driver. ``iter_cells`` streams them."""
        if self._cells is None:
            self._cells = [r.asDict() for r in self.cells_frame.collect()] if self.cells_frame is not None else []
        return self._cells

    def iter_cells(self) -> Iterator[dict]:
        if self._cells is not None or self.cells_frame is None:
            yield from self._cells or ()
        else:
            for r in self.cells_frame.toLocalIterator():
                yield r.asDict()

    __iter__ = iter_cells

    @property
    def total_cell_count(self) -> int | None:
        """Cells before paging; None without a count."""
        if self._total is None and self.all_cells_frame is not None:
            self._total = self.all_cells_frame.count()
        return self._total

    @property
    def labels(self) -> list[str]:
        return [*([SPLIT] if self.has_split else []), *self.attributes, *self.aggregates]

    def table_rows(self, dimension: str, depth: int | None = None, hierarchy: str | None = None) -> Iterator[TableRow]:
        """The cells as members of one drilled-down dimension, by default at its deepest shown level."""
        item = self.drilldown.item(dimension)
        if item is None:
            raise ArgumentError(f"dimension '{dimension}' is not drilled down")
        if hierarchy and hierarchy != item.hierarchy.name:
            raise ArgumentError(f"dimension '{dimension}' is drilled down by hierarchy '{item.hierarchy.name}'")
        levels = item.levels[:depth] if depth else item.levels
        last = levels[-1]
        for record in self.iter_cells():
            yield TableRow(record.get(last.key.ref), record.get(last.label_attribute.ref), [record.get(x.key.ref) for x in levels], item.hierarchy.is_last(last), record)

    def to_dict(self) -> dict:
        return {"summary": self.summary, "cells": self.cells, "total_cell_count": self.total_cell_count, "aggregates": self.aggregates, "cell": [c.to_dict() for c in self.cell.cuts], "levels": self.levels, "attributes": self.attributes, "has_split": self.has_split}
