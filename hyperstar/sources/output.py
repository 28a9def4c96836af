"""Results as CSV, JSON, JSON lines, HTML and spreadsheets."""

from __future__ import annotations

import csv
import datetime
import decimal
import html
import io
import json
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row

from ..errors import ArgumentError
from ..operators.crosstab import of_result
from ..operators.result import AggregationResult

#: Records of a JSON array that are put out at most.
RECORD_LIMIT = 1000


def records(source: DataFrame | AggregationResult | Iterable[dict]) -> Iterator[dict]:
    """The rows of a result, streamed."""
    if isinstance(source, DataFrame):
        return (r.asDict() for r in source.toLocalIterator())
    return source.iter_cells() if isinstance(source, AggregationResult) else iter(source)


class JSONEncoder(json.JSONEncoder):
    """Decimals become numbers, dates ISO texts, results dictionaries, and iterators lists of at most ``RECORD_LIMIT`` items."""

    def default(self, o: Any):
        if isinstance(o, decimal.Decimal):
            return float(o)
        if isinstance(o, (datetime.date, datetime.datetime, datetime.time)):
            return o.isoformat()
        if isinstance(o, Row):
            return o.asDict()
        if isinstance(o, DataFrame):
            return [r.asDict() for r in o.limit(RECORD_LIMIT).collect()]
        if hasattr(o, "to_dict"):
            return o.to_dict()
        if isinstance(o, (set, frozenset, Iterator)):
            return list(islice(o, RECORD_LIMIT))
        return super().default(o)


def to_json(value: Any, **options) -> str:
    return json.dumps(value, cls=JSONEncoder, **options)


def json_lines(source, separator: str = "\n") -> Iterator[str]:
    for r in records(source):
        yield to_json(r) + separator


def csv_lines(source, fields: list[str], header: list[str] | None = None, include_header: bool = True, **dialect) -> Iterator[str]:
    """Lines of CSV, the heading first: ``header``, or the fields' names."""
    buffer = io.StringIO()
    writer = csv.writer(buffer, **dialect)

    def line(values) -> str:
        buffer.seek(0)
        buffer.truncate()
        writer.writerow(values)
        return buffer.getvalue()

    if include_header:
        yield line(header or fields)
    for r in records(source):
        yield line([r.get(f) for f in fields])


def to_xlsx(source, fields: list[str], header: list[str] | None = None) -> bytes:
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise ArgumentError("spreadsheets need the package openpyxl") from e
    book = Workbook(write_only=True)
    sheet = book.create_sheet("result")
    sheet.append(header or fields)
    for r in records(source):
        sheet.append([r.get(f) for f in fields])
    out = io.BytesIO()
    book.save(out)
    return out.getvalue()


def labels_of(cube, refs: list[str]) -> list[str]:
    """What a heading calls references."""
    found = []
    for r in refs:
        try:
            a = cube.attribute(r)
            found.append(a.label or r)
        except Exception as e:
            if "unknown" not in str(e):
                raise
            found.append(r)
    return found


def html_cross_table(result: AggregationResult, rows: list[str], columns: list[str], place: str = "columns", table_class: str | None = None) -> str:
    t = of_result(result, rows, columns, place)
    text = lambda x: html.escape("" if x is None else str(x))
    depth = len(t.columns[0]) if t.columns else 0
    wide = len(t.rows[0]) if t.rows else 0
    heads = ["".join(["<th></th>" * wide, *(f"<th>{text(c[i])}</th>" for c in t.columns)]) for i in range(depth)]
    body = ["".join([*(f"<th>{text(x)}</th>" for x in head), *(f"<td>{text(', '.join(map(str, v)) if isinstance(v, tuple) else v)}</td>" for v in data)]) for head, data in zip(t.rows, t.data, strict=True)]
    kind = f' class="{text(table_class)}"' if table_class else ""
    return f"<table{kind}>" + "".join(f"<tr>{x}</tr>" for x in (*heads, *body)) + "</table>"


def _csv(result: AggregationResult, **options) -> str:
    return "".join(csv_lines(result, options.pop("fields", None) or result.labels, **options))


FORMATTERS = {
    "cross_table": lambda result, rows, columns, place="columns": to_json(of_result(result, rows, columns, place)),
    "html_cross_table": html_cross_table,
    "csv": _csv,
    "xlsx": lambda result, fields=None, header=None: to_xlsx(result, fields or result.labels, header),
    "json": lambda result: to_json(result.to_dict()),
    "json_lines": lambda result: "".join(json_lines(result)),
}


def formatted(name: str, result: AggregationResult, **options):
    if name not in FORMATTERS:
        raise ArgumentError(f"unknown format '{name}'")
    return FORMATTERS[name](result, **options)


def write_rows(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Large results, written by the executors in parallel: csv, json (lines), parquet or orc."""
    if format not in ("csv", "json", "parquet", "orc"):
        raise ArgumentError(f"unknown format '{format}'")
    writer = df.write.mode(mode).format(format)
    (writer.option("header", True) if format == "csv" else writer).save(path)
