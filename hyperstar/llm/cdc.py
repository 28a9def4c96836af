"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: it doubles at each byte and adds
the byte's random number, so its 16 bits depend on the last 16 bytes alone.
Where its top five bits are zero a chunk ends, unless it is still too short;
text that moves keeps its chunk ends. Chunks are deduplicated by a 128-bit
digest: the document with the smallest id keeps a chunk, in all others it
repeats, and neighbouring repeated chunks make a span.

Chunks are counted with a partial aggregation over fixed-width columns, and
only chunks that repeat go on to the join. Both sides of it are tables, so
adaptive execution can split a hot chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Bytes of a chunk, bits that make an end, and characters of a span that counts.
#: A passage loses up to a chunk or so at each side, so this is well under the passages that are to be found.
LEAST, MOST, END_BITS, SPAN = 24, 256, 5, 50
_GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b])) & 0xFFFF for b in range(256)], dtype=np.uint16)
_NULL_ID = -(2**63)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte, by doubling the width of the window four times."""
    h = _GEAR[data]
    for k in range(4):
        width = 1 << k
        h[width:] += h[:-width] << np.uint16(width) if len(h) > width else 0
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a text's bytes end; never within a character."""
    n = len(data)
    starts = np.append((data[1:] & 0xC0) != 0x80, True)  # the byte after this one starts a character
    ends, last = [], 0
    for i in (np.flatnonzero((gear_hashes(data) >> np.uint16(16 - END_BITS) == 0) & starts) + 1).tolist() + [n]:
        while i - last > MOST:
            cut = last + MOST
            while not starts[cut - 1]:
                cut -= 1
            ends.append(cut)
            last = cut
        if i - last >= LEAST or i == n and i > last:
            ends.append(i)
            last = i
    return ends


def chunks_of(text: str) -> tuple[list[bytes], list[int], list[int]]:
    """The digests of a text's chunks, and their starts and lengths in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = chunk_ends(data)
    if not ends:
        return [], [], []
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[[0, *ends]]
    digests, last = [], 0
    for e in ends:
        digests.append(xxhash.xxh3_128_digest(raw[last:e]))
        last = e
    return digests, points[:-1].tolist(), np.diff(points).tolist()


def _chunked(batches):
    for batch in batches:
        digests: list[bytes] = []
        ids, places, again = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, starts, sizes = chunks_of(text or "")
            own: dict[bytes, int] = {}
            for d, s, n in zip(found, starts, sizes, strict=True):
                place = s << 10 | n
                again.append(own.setdefault(d, place) if d in own else -1)
                own.setdefault(d, place)
                places.append(place)
            digests += found
            ids += [doc] * len(found)
        halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(again, pa.int64())], names=["h1", "h2", "doc", "place", "earlier"])


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: its digest (h1, h2), doc, its place (start << 10 | length, in code points) and the place of an equal chunk earlier in the text, or -1."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc")
    return docs.select(doc, "text").mapInArrow(_chunked, "h1 long, h2 long, doc long, place long, earlier long")


def _merged(found: Column) -> Column:
    """Spans of touching chunks from an array of (start, end, first, at), sorted."""
    start = F.array().cast("array<struct<start:long,end:long,first:long,at:long>>")

    def step(spans: Column, x: Column) -> Column:
        last = F.try_element_at(spans, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), x["end"].alias("end"), last["first"].alias("first"), last["at"].alias("at"))
        touches = F.coalesce(last["end"] == x["start"], F.lit(False))
        return F.when(touches, F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(spans, F.array(x)))

    return F.aggregate(found, start, step)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per span that a document repeats: doc_id, start and end (code points, end exclusive), and the document and place where its first chunk stood first.

    Rows that share a doc_id count as one document: what they share is no
    repeat. Null doc_ids do as well and come before all others. Null, empty and
    short texts have no spans; further columns are ignored; an empty table
    gives an empty result.
    """
    found = written(chunks(docs))
    again = written(found.where("earlier < 0").groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("place", "doc").alias("at")).where("first < last").drop("last"))
    across = found.where("earlier < 0").join(again, ["h1", "h2"]).where("doc <> first").select("doc", "place", "first", "at")
    within = found.where("earlier >= 0").select("doc", "place", F.col("doc").alias("first"), F.col("earlier").alias("at"))
    begin = lambda c: F.shiftright(c, 10)
    each = F.struct(begin("place").alias("start"), (begin("place") + F.col("place").bitwiseAND(1023)).alias("end"), "first", begin("at").alias("at"))
    spans = across.unionByName(within).groupBy("doc").agg(F.array_sort(F.collect_set(each)).alias("found")).select("doc", F.explode(_merged(F.col("found"))).alias("s"))
    known = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return spans.select("doc", "s.*").where(F.col("end") - F.col("start") >= SPAN).select(known("doc").alias("doc_id"), "start", "end", known("first").alias("first_doc_id"), F.col("at").alias("first_start"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their columns, repeated spans cut out of their texts."""
    spans = repeated_spans(docs).groupBy(F.col("doc_id").alias("_s_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_s_id"]), "left")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("text"))
    rest = F.aggregate("_spans", empty, step, lambda a: F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    return joined.select(*(F.when(F.col("_spans").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
