"""Packing documents into sequences by bin completion.

1. Each task tokenizes its documents, cuts those longer than a sequence, and
   numbers the pieces of each length within the task. The narrow table of
   pieces goes to the shared folder; no text moves.
2. The counts of pieces by length, at most one row per length (2048), are all
   that the packing needs. They go to the driver, which runs bin completion on
   the multiset of lengths: around the largest length left it enumerates
   undominated fillings and branches on the filling and on how often it is
   used, from as often as the counts allow down to once. It prunes by the waste
   that a better packing could still afford; best-fit packings of what is left
   are the incumbents. Branches wait unopened and none is dropped; the search
   ends when they are all done, when a lower bound is met or after a stated
   number of nodes. The plan has one entry per filling and length, so its size
   does not depend on the corpus.
3. A piece's rank among all pieces of its length (its number in its task plus
   the counts of the tasks before) picks its place in the plan.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections import deque
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import single_thread, table, written

CAPACITY = 2048
#: Nodes of the search over sequences, at least, and whole descents that it has nodes for, however deep they are; past them the best found so far stands.
NODES, DESCENTS = 60_000, 8
#: Nodes of the enumeration of fillings for the first branch of a node and for all of its branches, and steps of one
#: test of dominance and of all of one enumeration (a filling that is not tested to the end is kept).
FIRST_NODES, ALL_NODES, STEPS, ALL_STEPS = 400, 4_000, 300, 20_000
#: Fillings without waste that end the first enumeration.
EXACT = 6
#: Strings between spaces whose ids a worker remembers at most.
REMEMBERED = 300_000
END_ID = 0


class _Ids(dict):
    """Remembers the ids, as little-endian bytes, of strings that a space or line end delimits; None for those that their surroundings can change."""

    def __init__(self, lead: str, encode):
        self.lead, self.encode = lead, encode

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        ids = None if word == "" or word[0].isspace() or word[-1].isspace() else self.encode(self.lead + word)
        self[word] = ids
        return ids


class Encoder:
    """Encodes as ``tokenizers`` does with a byte-level BPE file. Its pattern
    never joins characters across a space or line end that stands alone, so
    texts are encoded by the strings between them, which repeat. ``ranks``
    (the same vocabulary for tiktoken) serves strings of Latin letters, for
    which both libraries' character classes agree; all else goes to
    ``tokenizers``."""

    PLAIN = re.compile(r"[\n -~¡-ɏ]*\Z")

    def __init__(self, file: str, ranks: str | None):
        single_thread()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                parts = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=parts, special_tokens={}).encode_ordinary
        self.line_end = self._word("\n")
        self.first, self.rest = _Ids("", self._word), _Ids(" ", self._word)

    def _word(self, word: str) -> bytes:
        if self.fast and self.PLAIN.match(word):
            return array.array("I", self.fast(word)).tobytes()
        return self.whole(word)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, rest, lines = self.first, self.rest.__getitem__, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                lines.append(first[words[0]] + b"".join(map(rest, words[1:])))
        except TypeError:  # two or more space characters meet somewhere
            return self.whole(text)
        return self.line_end.join(lines)


@lru_cache(maxsize=2)
def encoder(file: str, ranks: str | None) -> Encoder:
    return Encoder(file, ranks)


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first may be shorter."""
    head = n % capacity
    full = [(s, capacity) for s in range(head, n, capacity)]
    return [(0, head), *full] if head else full


def pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str | None] | None = None) -> DataFrame:
    """One row per piece of each text (a null one is empty): doc_id, piece, start, length, ids_crc32, and the task and the number among its pieces of that length."""
    file, ranks = files or tokenizer_files()

    def run(batches):
        encode, task, seen = encoder(file, ranks), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)), pa.array([task] * len(rows), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the best of the bounds that let each length above capacity - k, or above half, have a sequence of its own."""
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in {0, *(s for s in sizes if 2 * s <= capacity)}:
        alone = sum(counts[s] for s in sizes if s > capacity - k)
        large = [s for s in sizes if 2 * s > capacity and s <= capacity - k]
        room = sum(counts[s] * (capacity - s) for s in large)
        small = sum(counts[s] * s for s in sizes if k <= s and 2 * s <= capacity)
        best = max(best, alone + sum(counts[s] for s in large) + max(0, -(-(small - room) // capacity)))
    return best


Filling = tuple[tuple[int, int], ...]


def _fits(inner: tuple[int, ...], outer: tuple[int, ...]) -> tuple[bool, int]:
    """Whether the lengths of ``inner`` can be put, several together, into rooms as large as those of ``outer``, as far as ``STEPS`` tell; and the steps that it took."""
    steps = 0

    def go(at: int, rooms: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        if at == len(inner):
            return True
        x, tried = inner[at], set()
        for i, room in enumerate(rooms):
            if room >= x and room not in tried and steps < STEPS:
                tried.add(room)
                if go(at + 1, (*rooms[:i], room - x, *rooms[i + 1 :])):
                    return True
        return False

    return go(0, outer), steps


def fillings(counts: dict[int, int], room: int, nodes: int, enough: int | None = None) -> list[Filling]:
    """Undominated fillings of ``room`` from the lengths in ``counts``, least waste first, then fewest pieces, found with as many ``nodes``; with ``enough``, the search ends with so many that leave no waste."""
    sizes = sorted(counts, reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []
    done = exact = 0

    def search(at: int, left: int, taken: list[int]) -> bool:
        nonlocal done, exact
        done += 1
        lo, hi = at, len(sizes)
        while lo < hi:  # the first length that fits
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if sizes[mid] <= left else (mid + 1, hi)
        if not any(counts[s] > taken.count(s) for s in sizes[lo:]):
            found.append((left, tuple(taken)))
            exact += not left
            return enough is not None and exact >= enough
        for i in range(lo, len(sizes)):
            s = sizes[i]
            if counts[s] > taken.count(s) and (search(i, left - s, [*taken, s]) or done > nodes):
                return True
        return False

    search(0, room, [])
    best: list[tuple[int, ...]] = []
    steps = 0
    for _, f in sorted(found, key=lambda x: (x[0], len(x[1]), [-s for s in x[1]])):
        for b in best if steps < ALL_STEPS else ():
            dominated, more = _fits(f, b)
            steps += more
            if dominated:
                break
        else:
            best.append(f)
    return [tuple((s, f.count(s)) for s in sorted(set(f), reverse=True)) for f in best]


Plan = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """The incumbent: around each largest length, again and again the largest that fits."""
    left, plan = dict(counts), []
    while left:
        largest = max(left)
        taken, room = {largest: 1}, capacity - largest
        while fit := [s for s, n in left.items() if s <= room and n > taken.get(s, 0)]:
            s = max(fit)
            use = min(left[s] - taken.get(s, 0), room // s)
            taken[s] = taken.get(s, 0) + use
            room -= s * use
        plan.append(_apply(left, tuple(sorted(taken.items(), reverse=True))))
    return plan


def _apply(left: dict[int, int], filling: Filling) -> tuple[Filling, int]:
    """Takes ``filling`` out of ``left`` as often as it goes."""
    times = min(left[s] // n for s, n in filling)
    for s, n in filling:
        left[s] -= n * times
        if not left[s]:
            del left[s]
    return filling, times


def size(plan: Plan) -> int:
    return sum(times for _, times in plan)


class _Node(NamedTuple):
    """A packing in part: the node before it, the filling that it adds and how often, and the sequences, waste, depth and branches away from the first ones so far. ``closed`` has fillings that the largest length left may not have again, as they were used less often than they could be."""

    before: _Node | None
    step: tuple[Filling, int] | None
    used: int
    waste: int
    depth: int
    away: int
    largest: int
    closed: frozenset


def _branches(node: _Node, left: dict[int, int], capacity: int, nodes: int, enough: int | None = None) -> list[tuple[Filling, int]]:
    """The fillings around the largest length of ``left``, it included, and how often each can be used."""
    largest = max(left)
    rest = {s: n - (s == largest) for s, n in left.items() if n > (s == largest)}
    out = []
    for f in fillings(rest, capacity - largest, nodes, enough):
        use = dict(f)
        use[largest] = use.get(largest, 0) + 1
        filling = tuple(sorted(use.items(), reverse=True))
        if node.largest != largest or filling not in node.closed:
            out.append((filling, min(left[s] // n for s, n in filling)))
    return out


def _child(node: _Node, filling: Filling, times: int, most: int, capacity: int, away: int) -> _Node:
    largest = filling[0][0]
    closed = node.closed if node.largest == largest else frozenset()
    free = capacity - sum(s * n for s, n in filling)
    return _Node(node, (filling, times), node.used + times, node.waste + free * times, node.depth + 1, node.away + away, largest, closed | {filling} if times < most else closed)


def _others(counts: dict[int, int], node: _Node, first: Filling, capacity: int):
    """The branches of a node but its first: all fillings as often as they go, then all less and less often. What the node leaves is found anew when they are asked for."""
    found = _branches(node, _left(counts, node), capacity, ALL_NODES)
    for f, most in found:
        if f != first:
            yield _child(node, f, most, most, capacity, 1)
    for less in range(1, max((most for _, most in found), default=0)):
        for f, most in found:
            if less < most:
                yield _child(node, f, most - less, most, capacity, 1)


def _hopeless(node: _Node, left: dict[int, int], total: int, best: int, capacity: int) -> bool:
    """Whether no packing that goes on from the node has fewer sequences than ``best``."""
    return total + node.waste > (best - 1) * capacity or node.used + lower_bound_fast(left, capacity) >= best


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for ``counts[length]`` pieces of each length: fillings, each with the times that it is used."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    least, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    incumbent = best_fit(counts, capacity)
    nodes = deepest = 0
    # A descent takes the first branch throughout; the next one starts at a branch with the fewest others before it,
    # by turns one of the earliest and of the latest node that has such.
    waiting: dict[int, deque] = {0: deque([iter([_Node(None, None, 0, 0, 0, 0, 0, frozenset())])])}
    turn = 0
    while waiting and nodes < max(NODES, DESCENTS * deepest) and size(incumbent) > least:
        level = min(waiting)
        turn += 1
        branches = waiting[level].popleft() if turn % 2 else waiting[level].pop()
        node = next(branches, None)
        if node is not None:
            waiting[level].appendleft(branches) if turn % 2 else waiting[level].append(branches)
        if not waiting[level]:
            del waiting[level]
        if node is None:
            continue
        left = _left(counts, node)
        nodes += 1
        if not _hopeless(node, left, total, size(incumbent), capacity):
            rest = best_fit(left, capacity)
            nodes += len(rest)
            if node.used + size(rest) < size(incumbent):
                incumbent = [*_steps(node), *rest]
        while node is not None and left:
            nodes += 1
            deepest = max(deepest, node.depth)
            if _hopeless(node, left, total, size(incumbent), capacity):
                break
            found = _branches(node, left, capacity, FIRST_NODES, EXACT)
            first = found[0] if found else (None, 0)
            waiting.setdefault(node.away + 1, deque()).append(_others(counts, node, first[0], capacity))
            if not found:
                break
            node = _child(node, first[0], first[1], first[1], capacity, 0)
            _apply(left, first[0])
        if not left and node.used < size(incumbent):
            incumbent = _steps(node)
    return incumbent


def _steps(node: _Node) -> Plan:
    steps = []
    while node.before is not None:
        steps.append(node.step)
        node = node.before
    return steps[::-1]


def _left(counts: dict[int, int], node: _Node) -> dict[int, int]:
    """The lengths that the steps to ``node`` leave of ``counts``."""
    left = dict(counts)
    for filling, times in _steps(node):
        for s, n in filling:
            left[s] -= n * times
    return {s: n for s, n in left.items() if n}


def lower_bound_fast(counts: dict[int, int], capacity: int) -> int:
    return max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))


def places(plan: Plan) -> np.ndarray:
    """One row per filling and length, sorted by the first two columns: length, first rank, sequence of that rank, pieces of the length in one sequence, place of the first."""
    rows, ranks, sequence = [], {}, 0
    for filling, times in plan:
        at = 0
        for s, n in filling:
            rows.append((s, ranks.get(s, 0), sequence, n, at))
            ranks[s] = ranks.get(s, 0) + n * times
            at += s * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str | None] | None = None) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is the end id alone. Repeated rows are packed each,
    null doc_ids stay null, further columns are ignored, and an empty table
    gives an empty result. Which of several pieces of one length takes which
    of their places depends on the order in which tasks read them.
    """
    cutted = written(pieces(docs, capacity, files))
    by_task = cutted.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = docs.sparkSession.sparkContext.broadcast(places(bin_completion(counts, capacity)))  # bounded by capacity as well
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cutted.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        p = plan.value
        keys = p[:, 0] * (1 << 48) + p[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = p[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            q = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + q // row[:, 3]), pa.array(row[:, 4] + q % row[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
