"""Logs of requests, to the console, a file or a table."""

from __future__ import annotations

import csv
import datetime
import json
import queue
import threading
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..errors import ArgumentError

FIELDS = ("timestamp", "method", "cube", "cell", "identity", "elapsed_time", "attributes", "split", "drilldown", "page", "page_size", "format", "headers")


class Handler:
    def write(self, record: dict) -> None:
        raise NotImplementedError


class ConsoleHandler(Handler):
    def write(self, record: dict) -> None:
        print(f"{record['timestamp']} {record['method']} {record['cube']} cell='{record['cell']}' {record['elapsed_time']:.3f}s")


class CSVHandler(Handler):
    def __init__(self, path: str):
        self.path = path

    def write(self, record: dict) -> None:
        with open(self.path, "a", newline="", encoding="utf-8") as f:
            csv.writer(f).writerow([record.get(k) for k in FIELDS])


class JSONHandler(Handler):
    def __init__(self, path: str):
        self.path = path

    def write(self, record: dict) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(record) + "\n")


class TableHandler(Handler):
    """Appends to Parquet files, ``batch`` records at a time."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 100):
        self.spark, self.path, self.batch, self.waiting = spark, path, batch, []

    def write(self, record: dict) -> None:
        self.waiting.append({k: None if record.get(k) is None else str(record[k]) for k in FIELDS})
        if len(self.waiting) >= self.batch:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            schema = ", ".join(f"{k} string" for k in FIELDS)
            self.spark.createDataFrame([[r[k] for k in FIELDS] for r in self.waiting], schema).coalesce(1).write.mode("append").parquet(self.path)
            self.waiting = []


class RequestLog:
    def __init__(self, *handlers: Handler):
        self.handlers = list(handlers)

    @contextmanager
    def request(self, method: str, cube: str, cell="", identity=None, **more):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.emit({"timestamp": datetime.datetime.now().isoformat(), "method": method, "cube": cube, "cell": str(cell or ""), "identity": identity, "elapsed_time": time.perf_counter() - start, **more})

    def emit(self, record: dict) -> None:
        for h in self.handlers:
            h.write(record)


class AsyncRequestLog(RequestLog):
    """Writes in a thread of its own."""

    def __init__(self, *handlers: Handler):
        super().__init__(*handlers)
        self._queue: queue.Queue = queue.Queue()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def emit(self, record: dict) -> None:
        self._queue.put(record)

    def _run(self) -> None:
        while (record := self._queue.get()) is not None:
            RequestLog.emit(self, record)

    def close(self) -> None:
        self._queue.put(None)
        self._thread.join()


def handler(kind: str, **options) -> Handler:
    kinds = {"default": ConsoleHandler, "console": ConsoleHandler, "csv": CSVHandler, "json": JSONHandler, "table": TableHandler}
    if kind not in kinds:
        raise ArgumentError(f"unknown kind of request log '{kind}'")
    return kinds[kind](**options)
