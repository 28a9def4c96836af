"""Near-duplicates by Order MinHash.

The k-mers of a text are its shingles of five words, each labelled with how
often it came before. A sketch takes the two k-mers with the smallest hashes
under its seed and hashes them in the order in which they stand in the text,
so texts with the same shingles in another order differ. Texts that share one
of ``SKETCHES`` sketches form a bucket. A candidate pair is kept if a banded
alignment of its words finds at most 20 % of the longer text's words edited.
Classes are the connected components of the kept pairs and of equal texts.

1. Every member of a bucket is compared with one of it, so a group of copies
   costs as many comparisons as it has texts.
2. What is left are buckets whose members are not all of one class. Their pairs
   of members of different classes are all judged, block by block, by two bounds
   that no similar pair fails: on the lengths, and on the parities of the texts'
   words (an edit flips two bits at most, and one if it changes the length; long
   texts have more bits). What passes is aligned.
   While that is many more pairs than texts (variants of one text that are
   hardly similar to each other), each bucket's members first meet a few random
   ones of it, and classes are found anew, which leaves fewer pairs across
   classes. No pair of a bucket that could join two classes is left out.

Texts that are equal are one node throughout: copies are counted, not compared.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_key, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES = 32
#: Longs of a text's parities: a power of two that has four bits a word, but these at least and at most.
PARITIES, MOST_PARITIES = 32, 256
#: Members of a bucket's block, about: two blocks meet in one task.
BLOCK = 500
#: Pairs with one text that a task verifies, about.
TOGETHER = 1_000
#: Pairs across classes, for each member of a bucket, up to which all are verified at once.
AT_ONCE = 4
#: Random members of a bucket that all others meet in its first round, about, and by how much each round has more.
PIVOTS = 8
#: Nodes (of two longs) that are sent to every task to pick out their texts; more are joined.
SENT = 250_000
#: Distinct words whose hash a worker remembers, and rows of a batch that are Python objects at a time.
REMEMBERED, ROWS = 200_000, 500
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(f"sketch {j}") for j in range(SKETCHES)], dtype=np.uint64)
_SEEDS_32 = (_SEEDS >> np.uint64(32)).astype(np.uint32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _labelled(x: np.ndarray) -> np.ndarray:
    """The hashes ``x`` in their order, each changed by how often it came before."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    same = np.concatenate(([False], x[order][1:] == x[order][:-1]))
    if same.any():
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(same, 0, at))
        nth = np.empty(n, dtype=np.uint64)
        nth[order] = run.astype(np.uint64)
        x = np.where(nth > 0, _mix(x + nth * _ODD[0]), x)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of a text's word hashes, in order. Fewer than five words are one shingle."""
    n = max(1, len(w) - SHINGLE + 1)
    x = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        x += w[k : k + n] * _ODD[k]
    return _labelled(_mix(x))


def sketch(words: list[bytes]) -> np.ndarray:
    """The order-sensitive sketches of a text with at least one word."""
    return sketch_of(word_hashes(words))


def sketch_of(w: np.ndarray) -> np.ndarray:
    x = shingles(w)
    if len(x) == 1:
        return _mix(x + _SEEDS)
    short = (x >> np.uint64(32)).astype(np.uint32)
    first, second = np.empty(SKETCHES, dtype=np.int64), np.empty(SKETCHES, dtype=np.int64)
    step = max(1, min(SKETCHES, (1 << 18) // len(x)))  # a bounded block of seeds at once
    for j in range(0, SKETCHES, step):
        v = short[None, :] ^ _SEEDS_32[j : j + step, None]
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0xC2B2AE35)
        rows = np.arange(len(v))
        first[j : j + step] = a = v.argmin(axis=1)
        v[rows, a] = np.iinfo(np.uint32).max
        second[j : j + step] = v.argmin(axis=1)
    return _mix(_mix(x[np.minimum(first, second)] + _SEEDS) * _ODD[1] + x[np.maximum(first, second)])


def parities(w: np.ndarray) -> np.ndarray:
    """2048 bits or more, each the parity of the occurrence-labelled words that
    fall on it: to edit a word flips two bits at most. Folded to half, they are
    what half the bits would be, so that texts of other lengths can be compared."""
    longs = PARITIES
    while longs < MOST_PARITIES and 16 * longs < len(w):
        longs *= 2
    bits = np.bincount((_labelled(w) & np.uint64(64 * longs - 1)).view(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _parts(batch: pa.RecordBatch):
    """A batch in parts of ``ROWS`` rows, so that few texts are there twice."""
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _sketched(batches):
    for part in (p for batch in batches for p in _parts(batch)):
        ids, others, sizes, sketches, marks = [], [], [], [], []
        for a, b, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.encode().split()  # at ASCII white space
            if words:
                w = word_hashes(words)
                ids.append(a), others.append(b), sizes.append(len(words)), sketches.append(sketch_of(w).view(np.int64)), marks.append(parities(w))
        flat = lambda x: pa.array(np.concatenate(x)) if x else pa.array([], pa.int64())
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), flat(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64()), lists(sketches), lists(marks)], names=["h1", "h2", "n", "sketches", "marks"])


def within(a: list[bytes], b: list[bytes], most: int) -> bool:
    """Whether at most ``most`` words have to be put in, left out or replaced to
    make ``b`` of ``a``. A first band is little wider than the edits that the
    words alone call for, so the cost is about the length times the edits that
    there are, and the length times ``most`` at worst."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    a, b = a[lo:ha], b[lo:hb]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= most
    apart = max(len(a), len(b)) - (Counter(a) & Counter(b)).total()  # words that have no partner anywhere
    if apart > most:
        return False
    narrow = apart + apart // 4 + 4
    return narrow < most and _banded(a, b, narrow) or _banded(a, b, most)


def _banded(a: list[bytes], b: list[bytes], most: int) -> bool:
    """The alignment in a band of ``most`` cells on either side of the diagonal, a
    column (a word of ``b``) at a time. Bit k of a column's numbers is its cell
    in row column - most + k; set bits say that the distance grows (``plus``) or
    shrinks (``minus``) from the cell above. The band moves down by a row with
    each column, and ``score`` follows its lowest cell until that is the last row."""
    rows, columns = len(a), len(b)
    if columns - rows > most:
        return False
    top = 2 * most
    full = (1 << (top + 1)) - 1
    plus, minus, score = full ^ ((1 << most) - 1), 0, min(most, rows)
    block = max(1024, top)
    at: dict[bytes, int] = {}
    for j in range(columns):
        off = j % block
        if not off:  # the words of a that the next columns can meet, by their rows from the band's first on
            at = {}
            for i in range(max(0, j - most), min(rows, j + block + most)):
                at[a[i]] = at.get(a[i], 0) | 1 << (i - j + most)
        eq = at.get(b[j], 0) >> off & full
        same = ((eq & plus) + plus ^ plus) | eq | minus  # the distance does not grow along the diagonal
        up = minus | (full & ~(same | plus))
        down = same & plus
        last = rows - 1 - j + most  # the bit of the last row
        if last >= top:
            score += not same >> top & 1
            least = score - (columns - rows + most)
        else:
            score += (up >> last & 1) - (down >> last & 1)
            least = score - (columns - j - 1)
        if least > most:  # each word to come can take one back
            return False
        same = (same & full) >> 1
        plus = down | (full & ~(same | up))
        minus = same & up
    return score <= most


def similar(a: str, b: str) -> bool:
    x, y = a.encode().split(), b.encode().split()
    return within(x, y, int(max(len(x), len(y)) * (1 - SIMILARITY) + 1e-9))


def _verified(batches):
    for part in (p for batch in batches for p in _parts(batch)):
        a, b = (part.column(i).to_pylist() for i in (4, 5))
        yield part.select(["m1", "m2", "e1", "e2"]).filter(pa.array([similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("other seed"), text).alias("h2")]


def _node(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def _picked(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """h1, h2 and text, once, of the texts that are in ``pairs``."""
    nodes = written(pairs.select(F.col("m1").alias("h1"), F.col("m2").alias("h2")).union(pairs.select("e1", "e2")).distinct())
    return texts.join(F.broadcast(nodes) if nodes.count() <= SENT else nodes, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))


def _kept(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the written ``pairs`` (m1, m2, e1, e2) whose texts are similar, as u and v."""
    # The pairs of one end go to as many tasks as it takes, each with a copy of the end's text.
    parts = written(pairs.groupBy("e1", "e2").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts")))
    dealt = pairs.join(parts, ["e1", "e2"]).withColumn("part", F.pmod(F.col("m1"), F.col("parts")).cast("int")).drop("parts")
    own = _picked(texts, pairs)
    side = lambda x: own.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("text").alias(f"{x}_text"))
    ends = side("e").join(parts, ["e1", "e2"]).select("e1", "e2", "e_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(side("m"), ["m1", "m2"]).join(ends, ["e1", "e2", "part"]).select("m1", "m2", "e1", "e2", "m_text", "e_text")
    return written(both.mapInArrow(_verified, "m1 long, m2 long, e1 long, e2 long").select(_node("m1", "m2").alias("u"), _node("e1", "e2").alias("v")))


def _near(n: Column, m: Column) -> Column:
    """Whether texts of n and m words can be similar."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def _whole_groups(batches):
    """Sorted batches, cut anew so that no group (s, i, j) is in two."""
    one = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    held = []
    for batch in (b for b in batches if b.num_rows):
        keys = [batch.column(k).to_numpy() for k in ("s", "i", "j")]
        others = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        if len(others):
            at = int(others[-1]) + 1
            yield one([*held, batch.slice(0, at)])
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield one(held)


def _apart(marks: pa.ListArray):
    """A function of the row numbers of pairs: how many parities differ, those of the longer text folded."""
    longs, flat = np.diff(marks.offsets.to_numpy()), marks.flatten().to_numpy()
    starts = np.concatenate(([0], np.cumsum(longs)[:-1]))
    folded, at = {}, {}
    for size in np.unique(longs).tolist():
        folded[size], at[size] = [], np.zeros(len(longs), dtype=np.int64)
        filled = 0
        for own in np.unique(longs[longs >= size]).tolist():
            rows = np.flatnonzero(longs == own)
            whole = flat[starts[rows][:, None] + np.arange(own)].reshape(len(rows), own // size, size)
            folded[size].append(np.bitwise_xor.reduce(whole, axis=1).view(np.uint64))
            at[size][rows] = filled + np.arange(len(rows))
            filled += len(rows)
        folded[size] = np.concatenate(folded[size])

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sizes, found = np.minimum(longs[a], longs[b]), np.zeros(len(a), dtype=np.int64)
        for size in np.unique(sizes).tolist():
            k = np.flatnonzero(sizes == size)
            x, y = at[size][a[k]], at[size][b[k]]
            found[k] = np.bitwise_count(folded[size][x] ^ folded[size][y]).sum(axis=1)
        return found

    return apart


def _passing(group: pa.RecordBatch):
    """Row numbers of the pairs within groups (s, i, j) that both bounds let pass, a part at a time."""
    s, i, j, n, label, side = (group.column(k).to_numpy() for k in ("s", "i", "j", "n", "label", "side"))
    chosen = group.column("chosen").to_numpy(zero_copy_only=False)
    sketches = group.column("sketches").flatten().to_numpy().reshape(-1, SKETCHES)
    apart = _apart(group.column("marks"))
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    sizes = np.diff(np.append(first, len(s)))
    end = np.repeat(first + sizes, sizes)
    at = np.arange(len(s))
    for step in count(1):
        at = at[at + step < end[at]]
        if not len(at):
            return
        a, b = at, at + step
        longer = np.maximum(n[a], n[b])
        able = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= SIMILARITY * longer - 1e-9)
        hosts = (side[a] == j[a]) | (side[b] == j[b])
        twice = chosen[a] & chosen[b] & (np.maximum(side[a], side[b]) > j[a])  # it is in the other's block, too
        able &= np.where(i[a] == j[a], (chosen[a] | chosen[b]) & hosts & ~twice, side[a] != side[b])
        a, b, longer = a[able], b[able], longer[able]
        # An edit that puts a word in or leaves one out flips one bit, and there are as many of those as the lengths differ by.
        close = apart(a, b) <= 2 * np.floor(longer * (1 - SIMILARITY) + 1e-9) - np.abs(n[a] - n[b])
        a, b = a[close], b[close]
        common = (sketches[a][:, :, None] == sketches[b][:, None, :]).any(axis=2)
        here = np.where(common, sketches[a], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == s[a]
        if here.any():
            yield a[here], b[here]


def _judged(batches, counted: bool = False):
    for group in _whole_groups(batches):
        h1, h2 = (group.column(k).to_numpy() for k in ("h1", "h2"))
        for a, b in _passing(group):
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([len(a)], pa.int64())], names=["pairs"])
            else:
                more = (h1[a] > h1[b]) | ((h1[a] == h1[b]) & (h2[a] > h2[b]))
                m, e = np.where(more, a, b), np.where(more, b, a)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[m], h2[m], h1[e], h2[e])], names=["m1", "m2", "e1", "e2"])


def _across(members: DataFrame, pivots: int | None, counted: bool = False) -> DataFrame:
    """Pairs (m1, m2, e1, e2) of members of one bucket and different classes that
    both bounds let pass, in the one order that all pairs have, and from one of
    the buckets that they share: that of their least common sketch. Of
    ``pivots`` random members of each bucket, about, with all its members; by
    default of all members. Or only how many there are, in parts (pairs).

    A bucket's members fall into blocks of bounded size. Blocks i and j meet
    in a group (s, i, j); pivots are guests of each block, in (s, i, i)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    own = members.withColumn("side", F.pmod(F.xxhash64("h2", "h1"), blocks).cast("int"))
    if pivots is None:
        dealt = own.withColumn("chosen", F.lit(True)).withColumn("o", F.explode(every))
        i, j = F.least("side", "o"), F.greatest("side", "o")
    else:
        dealt = own.withColumn("chosen", F.shiftrightunsigned(F.xxhash64("h1", "h2", "s"), 11) / F.lit(2.0**53) * F.col("size") < pivots)
        dealt = dealt.withColumn("o", F.explode(F.when(F.col("chosen"), every).otherwise(F.array("side"))))
        i = j = F.col("o")
    keyed = dealt.select("s", i.alias("i"), j.alias("j"), "h1", "h2", "n", F.xxhash64("label").alias("label"), "side", "chosen", "sketches", "marks")
    grouped = keyed.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    return grouped.mapInArrow(partial(_judged, counted=counted), "pairs long" if counted else "m1 long, m2 long, e1 long, e2 long")


def buckets(sketched: DataFrame) -> DataFrame:
    """The members of buckets of several texts, a row for each of their rows: s, h1, h2, n, and the bucket's least text with its length (e1, e2, en)."""
    each = sketched.select("h1", "h2", "n", F.explode("sketches").alias("s"))
    least = each.groupBy("s").agg(F.min("h1").alias("e1"), F.min_by("h2", "h1").alias("e2"), F.min_by("n", "h1").alias("en"), F.max("h1").alias("last")).where("e1 <> last").drop("last")
    return each.join(least, "s")


def links(docs: DataFrame) -> DataFrame:
    """Verified pairs of different texts: u and v, each the hexadecimal digits of
    a text's two hashes. They are not all similar pairs, but join all texts
    that a chain of similar pairs of shared sketches joins.

    ``docs`` needs a text column only. Null texts and texts without words have
    no links; equal texts count once; an empty table gives an empty result.
    """
    texts = docs.select("text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*_keys(F.col("text")), "text")
    sketched = written(texts.mapInArrow(_sketched, "h1 long, h2 long, n long, sketches array<long>, marks array<long>"))
    shared = written(buckets(sketched))
    pairs = written(shared.where((F.col("h1") != F.col("e1")) & _near(F.col("n"), F.col("en"))).select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "e1", "e2").distinct())
    edges = _kept(pairs, texts)
    members = written(shared.select("s", "h1", "h2", "n").distinct().withColumn("node", _node("h1", "h2")))
    pivots = PIVOTS
    while True:
        labelled = members.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = labelled.groupBy("s").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b").select("s", "size")
        members = written(labelled.drop("label").join(mixed.select("s"), "s", "left_semi"))
        marks = sketched.select("h1", "h2", "marks", "sketches").join(members.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("marks").alias("marks"), F.first("sketches").alias("sketches"))
        open_ = written(labelled.join(mixed, "s").join(marks, ["h1", "h2"]))
        rest = _across(open_, None)
        n, most, square = open_.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        last = pivots >= most or square <= 2 * AT_ONCE * n or (_across(open_, None, True).agg(F.sum("pairs")).first()[0] or 0) <= AT_ONCE * n
        more = written((rest if last else _across(open_, pivots)).join(pairs, ["m1", "m2", "e1", "e2"], "left_anti"))
        pairs = pairs.unionByName(more)
        edges = edges.unionByName(_kept(more, texts))
        if last:
            return edges
        pivots *= PIVOTS


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, class_id (the least doc_id of its class), first_key (the row_key that goes with it) and class_rows.

    Equal texts are always in one class. A text without words, or a null one,
    is in no class: its class_id is its own doc_id. Null doc_ids sort last. Rows
    that repeat doc_id and text are one class. Further columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("row_key"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"), *_keys(F.coalesce("text", F.lit(""))))
    rows = written(rows.select("doc_id", "row_key", "worded", _node("h1", "h2").alias("node")))
    labels = components(links(docs))
    marked = rows.where("worded").join(labels, "node", "left").select("doc_id", "row_key", F.coalesce("label", "node").alias("label"))
    marked = written(marked)
    least = written(marked.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min_by("row_key", "doc_id").alias("first_key"), F.min("row_key").alias("any_key"), F.count(F.lit(1)).alias("class_rows")))
    classed = marked.join(least, "label").select("doc_id", "row_key", "class_id", F.coalesce("first_key", "any_key").alias("first_key"), "class_rows")
    return classed.unionByName(rows.where("not worded").select("doc_id", "row_key", F.col("doc_id").alias("class_id"), F.col("row_key").alias("first_key"), F.lit(1).cast("long").alias("class_rows")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, with its own columns; all rows whose text has no words stay."""
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    gone = near_duplicates(docs)
    firsts = gone.where(F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("first_key"))).select(key("doc_id").alias("_k1"), F.col("row_key").alias("_k2")).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = docs.where(worded).select(key("doc_id").alias("_k1"), text_key(F.col("text")).alias("_k2"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    return once.join(firsts, ["_k1", "_k2"], "left_semi").select("_row.*").unionByName(docs.where(~worded))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")
