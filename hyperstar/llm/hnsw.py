"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are one node of the index that knows its smallest ids, so a
vector that fills a third of the table is inserted once. The nodes are dealt
over shards by hash; each shard builds a hierarchical graph whose neighbour
lists are flat arrays, and becomes one row of an index table in the shared
folder. Queries go in blocks to every shard; each shard returns its best few,
which are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Vectors of a shard, queries of a block, about.
SHARD, BLOCK = 4096, 512
#: Links of a node on upper layers and on the lowest; width of the search when building and when searching.
LINKS, LINKS_0, BUILD_WIDTH, SEARCH_WIDTH = 12, 24, 64, 80


class Graph:
    """``levels[l]`` has a row of neighbours, -1 where there is none, for each node of layer l; ``place[l]`` is the row of a node there, -1 if it is not there."""

    def __init__(self, unit: np.ndarray, height: np.ndarray, levels: list[np.ndarray], place: list[np.ndarray], entry: int):
        self.unit, self.height, self.levels, self.place, self.entry = unit, height, levels, place, entry

    @staticmethod
    def heights(n: int) -> np.ndarray:
        """Geometric heights from a fixed sequence: the same shard builds the same graph."""
        u = (np.arange(1, n + 1) * 0.6180339887498949) % 1.0
        return np.minimum(8, (-np.log(np.maximum(u, 1e-12)) / math.log(LINKS)).astype(np.int64))

    @classmethod
    def build(cls, unit: np.ndarray) -> Graph:
        n = len(unit)
        height = cls.heights(n)
        top = int(height.max())
        place, levels = [], []
        for level in range(top + 1):
            there = height >= level
            at = np.full(n, -1, dtype=np.int32)
            at[there] = np.arange(int(there.sum()))
            place.append(at)
            levels.append(np.full((int(there.sum()), LINKS_0 if level == 0 else LINKS), -1, dtype=np.int32))
        g = cls(unit, height, levels, place, 0)
        for i in range(1, n):
            g._insert(i)
        return g

    def _insert(self, i: int) -> None:
        q = self.unit[i]
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(int(self.height[self.entry]), -1, -1):
            if level > self.height[i]:
                at = self._layer(q, at, 1, level)
                continue
            at = self._layer(q, at, BUILD_WIDTH, level)
            links = self._diverse(at, LINKS)
            row = self.levels[level][self.place[level][i]]
            row[: len(links)] = links
            for j in links:
                self._link(level, j, i)
        if self.height[i] > self.height[self.entry]:
            self.entry = i

    def _link(self, level: int, j: int, i: int) -> None:
        row = self.levels[level][self.place[level][j]]
        free = int((row >= 0).sum())
        if free < len(row):
            row[free] = i
            return
        near = np.append(row, np.int32(i))
        sims = self.unit[near] @ self.unit[j]
        links = self._diverse(sorted(zip(sims.tolist(), near.tolist(), strict=True), reverse=True), len(row))
        row[:] = -1
        row[: len(links)] = links

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of ``found``, nearest first, those that are nearer to the centre than to any taken before; then the nearest of the rest."""
        ids = [j for _, j in found]
        if len(ids) <= most:
            return ids
        between = self.unit[ids] @ self.unit[ids].T
        taken: list[int] = []
        rest: list[int] = []
        closest = np.full(len(ids), -2.0)
        for k, (sim, _) in enumerate(found):
            if len(taken) == most:
                break
            if sim >= closest[k]:
                taken.append(k)
                np.maximum(closest, between[k], out=closest)
            else:
                rest.append(k)
        return [ids[k] for k in [*taken, *rest][:most]]

    def _layer(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest that a best-first walk on a layer finds, nearest first."""
        rows, place, unit = self.levels[level], self.place[level], self.unit
        seen = {j for _, j in start}
        ahead = [(-s, j) for s, j in start]
        best = list(start)
        heapq.heapify(ahead)
        heapq.heapify(best)
        while ahead:
            s, j = heapq.heappop(ahead)
            if len(best) >= width and -s < best[0][0]:
                break
            near = [k for k in rows[place[j]].tolist() if k >= 0 and k not in seen]
            if not near:
                continue
            seen.update(near)
            for sim, k in zip((unit[near] @ q).tolist(), near, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (sim, k))
                    heapq.heappush(ahead, (-sim, k))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, k))
                    heapq.heappush(ahead, (-sim, k))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, width: int = SEARCH_WIDTH) -> list[int]:
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(int(self.height[self.entry]), 0, -1):
            at = self._layer(q, at, 1, level)
        return [j for _, j in self._layer(q, at, width, 0)]


def cosines(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, the same for equal rows wherever they stand."""
    return (vectors * q).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * math.sqrt(float((q * q).sum())))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v and dim of the rows that take part; of rows that share a vec_id, one."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return good.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v")).withColumn("dim", F.size("v"))


def build_index(rows: DataFrame, members: int) -> DataFrame:
    """One row per shard: shard, dim, the nodes' vectors and smallest ids, and the graph as flat arrays."""
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("other seed"), "v").alias("k2")]
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.select("vec_id", "v", "dim", *key).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= members)
    nodes = few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes)
    shards = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(shards), "dim").select("dim", F.pmod(F.col("k1"), F.col("shards")).cast("int").alias("shard"), "k1", "v", "ids")  # a row per dimension

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("k1", "ascending")])
        dim, n = group.column("dim")[0].as_py(), group.num_rows
        vectors = np.array(group.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(n, dim)
        unit = (vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float64)
        unit = (unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))).astype(np.float32)
        g = Graph.build(unit)
        ids = np.full((n, members), -1, dtype=np.int64)
        for r, own in enumerate(group.column("ids").to_pylist()):
            ids[r, : len(own)] = own
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "n": pa.array([n], pa.int32()), "entry": pa.array([g.entry], pa.int32()),
            "vectors": [vectors.tobytes()], "ids": [ids.tobytes()], "height": [g.height.astype(np.int64).tobytes()], "links": pa.array([[a.tobytes() for a in g.levels]], pa.list_(pa.binary())),
        })

    return written(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, n int, entry int, vectors binary, ids binary, height binary, links array<binary>"))


class Shard:
    """A row of the index, opened."""

    def __init__(self, row: dict, members: int):
        n = row["n"]
        self.vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, row["dim"])
        self.ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(n, members)
        height = np.frombuffer(row["height"], dtype=np.int64)
        scale = self.vectors / np.abs(self.vectors).max(axis=1, keepdims=True)
        unit = (scale / np.sqrt((scale * scale).sum(axis=1, keepdims=True))).astype(np.float32)
        place = []
        for level in range(len(row["links"])):
            at = np.full(n, -1, dtype=np.int32)
            at[height >= level] = np.arange(int((height >= level).sum()))
            place.append(at)
        levels = [np.frombuffer(b, dtype=np.int32).reshape(-1, LINKS_0 if k == 0 else LINKS) for k, b in enumerate(row["links"])]
        self.graph = Graph(unit, height, levels, place, row["entry"])

    def nearest(self, own: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        unit = q / np.abs(q).max()
        near = self.graph.search((unit / math.sqrt(float((unit * unit).sum()))).astype(np.float32))
        sims = cosines(self.vectors[near], q)
        found = [(-s, i) for s, ids in zip(sims.tolist(), self.ids[near].tolist(), strict=True) for i in ids if i >= 0 and i != own]
        return [(-s, i) for s, i in heapq.nsmallest(k, found)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of ``vectors`` for each row of ``queries``, its own vec_id left out.

    Both have vec_id and embedding. Rows with a null vec_id and vectors that
    are null, zero or hold null or non-finite components take no part; of rows
    that share a vec_id one counts. Vectors of another length than the query's
    are no candidates. Equal scores go to the smaller vec_id. Further columns
    are ignored. With no usable rows the result is empty.
    """
    members = k + 1
    index = build_index(usable(vectors), members)
    asked = written(usable(queries))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    grouped = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = grouped.join(F.broadcast(shards), "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "asked")  # a row per dimension

    def search(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                shard = Shard(row, members)
                for x in row["asked"]:
                    out += [(x["vec_id"], i, s) for s, i in shard.nearest(x["vec_id"], np.array(x["v"]), k)]
            ids, found, scores = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])

    found = index.join(sent, ["dim", "shard"]).mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
