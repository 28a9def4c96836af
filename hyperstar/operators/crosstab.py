"""Cross tables: cells with some attributes on rows and some on columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from .result import AggregationResult

PLACES = ("columns", "rows", "cells")


@dataclass
class CrossTable:
    """``rows`` and ``columns`` are headings, tuples in order of appearance; ``data`` has a list per row. A cell that is not there is None."""

    columns: list[tuple]
    rows: list[tuple]
    data: list[list[Any]]

    def to_dict(self) -> dict:
        return {"columns": [list(x) for x in self.columns], "rows": [list(x) for x in self.rows], "data": self.data}


def cross_table(cells: Iterable[dict], rows: list[str], columns: list[str], aggregates: list[str], place: str = "columns") -> CrossTable:
    """``place`` says where the aggregates' names go: on columns, on rows, or nowhere, with a tuple of values in each cell."""
    if place not in PLACES:
        raise ArgumentError(f"aggregates go on {PLACES}, not '{place}'")
    row_at: dict[tuple, int] = {}
    column_at: dict[tuple, int] = {}
    values: dict[tuple[int, int], Any] = {}
    for cell in cells:
        row, column = tuple(cell.get(r) for r in rows), tuple(cell.get(c) for c in columns)
        if place == "cells":
            entries = [(row, column, tuple(cell.get(a) for a in aggregates))]
        elif place == "rows":
            entries = [((*row, a), column, cell.get(a)) for a in aggregates]
        else:
            entries = [(row, (*column, a), cell.get(a)) for a in aggregates]
        for r, c, v in entries:
            values[row_at.setdefault(r, len(row_at)), column_at.setdefault(c, len(column_at))] = v
    data = [[values.get((i, j)) for j in range(len(column_at))] for i in range(len(row_at))]
    return CrossTable(list(column_at), list(row_at), data)


def of_result(result: AggregationResult, rows: list[str], columns: list[str], place: str = "columns") -> CrossTable:
    return cross_table(result.iter_cells(), rows, columns, result.aggregates, place)


def pivoted(cells: DataFrame, rows: list[str], column: str, values: list[Any], aggregates: list[str]) -> DataFrame:
    """The same on the cluster, for results too large for the driver: a column for each of the given ``values`` and aggregate. The cells have one row per combination, so any aggregate of it will do."""
    key = F.col(f"`{column}`")
    made = [F.max(F.when(key == v if v is not None else key.isNull(), F.col(f"`{a}`"))).alias(f"{v}_{a}") for v in values for a in aggregates]
    return cells.groupBy(*(F.col(f"`{r}`") for r in rows)).agg(*made)
