"""BPE encoding and decoding through a minimal acyclic transducer.

The words of all texts are counted, and the most frequent ones are compiled
with their ids into an automaton whose equal suffixes are shared. It numbers
its words: each transition carries how many words sort before it, and a word's
number picks its ids from a table. The automaton is a few flat arrays in one
file, which every worker maps into memory; distinct words walk it together, a
byte at a time. Words that it lacks are merged exactly, by the library's own
merges. A worker remembers the codes of the words that it met, across batches
and tasks, so that a word is looked up once while it keeps coming.

Texts of Latin letters are normalised and split here, a run of them at once:
code points become classes, and words begin where the class changes. Arrow's
kernels look up the words of a run, put their codes in their places and join
them. Any other text has the library's own normaliser and splitter, so results
are the library's for every text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import single_thread, table, written

#: Words in the automaton, characters that are split together, words whose codes a worker remembers before it starts anew.
LEXICON, TOGETHER, REMEMBERED = 300_000, 4_000_000, 1_000_000
LONGEST = 48


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
#: Texts of these characters only are normalised and split here: none composes, and both libraries class and lower them alike.
PLAIN = re.compile(r"[\n\t\r -~¡-įı-ɏ]*\Z")
SPLIT = re.compile(rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\s{_L}{_N}]+")
#: The class of each code point of a plain text in lower case: space, letter, digit, or 3 for any other; two letters above U+0250 have capitals below it.
_CLASS = np.full(0x251, 3, dtype=np.uint8)
_CLASS[[ord(c) for c in " \t\n\r"]] = 0
_CLASS[[c for c in range(0x250) if unicodedata.category(chr(c))[0] == "L"] + [0x250]] = 1
_CLASS[[c for c in range(0x250) if unicodedata.category(chr(c))[0] == "N"]] = 2
#: Whether a byte is part of a word.
_SOLID = np.ones(256, dtype=bool)
_SOLID[[ord(c) for c in " \t\n\r"]] = False


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """Encodes and decodes as the library does with a vocabulary file whose words end in a suffix."""

    def __init__(self, file: str):
        single_thread()
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(file)
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.decimal = {i: str(i) for i in self.token}
        self.letters = byte_letters()
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def spelled(self, words: pa.Array) -> pa.Array:
        """Words of plain texts as the vocabulary spells them: a letter per byte. ASCII that prints stands for itself."""
        other = pc.invert(pc.string_is_ascii(words))
        letter = self.letters.__getitem__
        return pc.replace_with_mask(words, other, pa.array(["".join(map(letter, w.encode())) for w in words.filter(other).to_pylist()], pa.string()))

    def words(self, text: str) -> list[str]:
        """The spelled words of any text, by the library; special tokens stand for themselves."""
        out = []
        for i, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                out.append(part)
            elif part:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def plain_words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of plain texts, not yet spelled, and how many each has."""
        if any("'" in t for t in texts):  # contractions are words of their own
            found = [SPLIT.findall(t.lower()) for t in texts]
            return pa.array([w for own in found for w in own], pa.string()), np.array([len(own) for own in found])
        low = "\n".join([*texts, ""]).lower()
        points = np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)
        kind = _CLASS[np.minimum(points, 0x250)]
        starts = (kind != 0) & ((kind == 2) | (kind != np.concatenate(([0], kind[:-1]))))
        sizes = np.where(points < 0x80, 1, np.where(points < 0x800, 2, 3)).astype(np.int32) * (kind != 0)  # bytes, without spaces
        before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int32)), dtype=np.int32)
        offsets = np.append(before[:-1][starts], before[-1]).astype(np.int32)
        raw = np.frombuffer(low.encode(), dtype=np.uint8)
        data = raw[_SOLID[raw]].tobytes()
        each = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        counts = np.diff(np.concatenate(([0], np.cumsum(starts)))[np.concatenate(([0], np.cumsum(each)))])
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), counts

    def is_plain(self, text: str) -> bool:
        return bool(PLAIN.match(text)) and not any(s in text for s in self.special)

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of a spelled word: of all neighbouring pairs that merge, the one with the lowest rank, leftmost first, until none does."""
        if word in self.special:
            return (self.special[word],)
        return tuple(t.id for t in self.library.model.tokenize(word))

    def decode(self, ids) -> str:
        """The file names no decoder: its tokens, with a space between any two."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def word_bpe(file: str) -> WordBpe:
    return WordBpe(file)


def compile_lexicon(entries: dict[str, tuple[int, ...]]) -> bytes:
    """The minimal acyclic transducer of ``entries`` (word -> ids) as the bytes of its arrays. Words go in sorted by their UTF-8; a state is frozen, and replaced by an equal one where there is one, as soon as no later word can pass it."""
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    open_path: list[list] = [[False, []]]  # [ends a word, [(byte, state)]] along the last word
    last = b""

    def freeze(down_to: int) -> None:
        while len(open_path) > down_to:
            ends, arcs = open_path.pop()
            key = (ends, tuple(arcs))
            at = frozen.get(key)
            if at is None:
                at = frozen[key] = len(states)
                states.append(key)
            open_path[-1][1].append((last[len(open_path) - 1], at))

    for word, _ in words:
        common = os.path.commonprefix((last, word))
        freeze(len(common) + 1)
        open_path.extend([False, []] for _ in range(len(word) - len(common)))
        open_path[-1][0] = True
        last = word
    freeze(1)
    root = len(states)
    states.append((open_path[0][0], tuple(open_path[0][1])))
    below = np.zeros(len(states), dtype=np.int64)  # words from a state on; children are frozen first
    rows = []
    for s, (ends, arcs) in enumerate(states):
        n = int(ends)
        for byte, to in arcs:
            rows.append((s << 8 | byte, to, n))
            n += int(below[to])
        below[s] = n
    rows.sort()
    arcs = np.array(rows, dtype=np.int64).reshape(-1, 3)
    ids = [i for _, own in words for i in own]
    offsets = np.concatenate(([0], np.cumsum([len(own) for _, own in words], dtype=np.int64)))
    arrays = [arcs[:, 0], arcs[:, 1], arcs[:, 2], np.array([e for e, _ in states]), offsets, np.array(ids)]
    head = np.array([root, len(arrays), *map(len, arrays)])
    return b"".join(a.astype(np.int32).tobytes() for a in (head, *arrays))


class Lexicon:
    """A compiled lexicon, mapped from a file of this worker's machine. The file loses its name at once, so nothing is left when the worker ends."""

    def __init__(self, data: bytes):
        with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:
            f.write(data)
            f.flush()
            whole = np.asarray(np.memmap(f.name, dtype=np.int32, mode="r"))
        n = int(whole[1])
        ends = np.cumsum([2 + n, *whole[2 : 2 + n].tolist()])
        self.root = int(whole[0])
        self.keys, self.to, self.skip, self.ends, self.offsets, self.ids = (whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that are not in it."""
        n = len(words)
        number = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return number
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        at = np.flatnonzero((size > 0) & (size <= LONGEST))
        state, before = np.full(len(at), self.root, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        step = 0
        while len(at):
            done = size[at] == step
            if done.any():
                ended = done & (self.ends[state] == 1)
                number[at[ended]] = before[ended]
                at, state, before = at[~done], state[~done], before[~done]
            key = (state << 8 | text[start[at] + step]).astype(np.int32)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            at, arc = at[on], arc[on]
            state, before = self.to[arc].astype(np.int64), before[on] + self.skip[arc]
            step += 1
        return number

    def ids_of(self, numbers: np.ndarray) -> list[list[int]]:
        """The ids of words by their numbers."""
        start, end = self.offsets[numbers].astype(np.int64), self.offsets[numbers + 1].astype(np.int64)
        size = end - start
        at = np.cumsum(size)
        flat = self.ids[np.repeat(start - at + size, size) + np.arange(at[-1] if len(at) else 0)].tolist()
        return [flat[b - n : b] for b, n in zip(at.tolist(), size.tolist(), strict=True)]


@lru_cache(maxsize=2)
def lexicon(data: bytes) -> Lexicon:
    return Lexicon(data)


#: Of a text: its number of ids, the ids as decimals with a space between, and what they decode to.
Code = tuple[int, str, str]


class Known:
    """Words whose codes a worker remembers, as Arrow arrays: the words, their numbers of ids, and their codes as decimals and decoded."""

    def __init__(self):
        self.words, self.decimals, self.decoded = (pa.array([], pa.string()) for _ in range(3))
        self.sizes = np.array([], dtype=np.int64)

    def learn(self, words: pa.Array, codes: list[Code]) -> None:
        sizes, decimals, decoded = zip(*codes, strict=True)
        self.words = pa.concat_arrays([self.words, words])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, dtype=np.int64)])
        self.decimals = pa.concat_arrays([self.decimals, pa.array(decimals, pa.string())])
        self.decoded = pa.concat_arrays([self.decoded, pa.array(decoded, pa.string())])


class Coder:
    """Codes texts with a lexicon, and remembers the codes of up to ``REMEMBERED`` words, or those of one run."""

    def __init__(self, bpe: WordBpe, words: Lexicon):
        self.bpe, self.words = bpe, words
        self.known = {False: Known(), True: Known()}  # by whether the words are spelled already

    def _codes(self, words: list[str]) -> list[Code]:
        """Of distinct spelled words: what the lexicon has, and exact merges."""
        numbers = self.words.numbers([w.encode() for w in words])
        known = iter(self.words.ids_of(numbers[numbers >= 0]))
        decimal, token, merge = self.bpe.decimal.__getitem__, self.bpe.token.__getitem__, self.bpe.merge
        each = (next(known) if number >= 0 else merge(w) for w, number in zip(words, numbers.tolist(), strict=True))
        return [(len(ids), " ".join(map(decimal, ids)), " ".join(map(token, ids))) for ids in each]

    def _coded(self, words: pa.Array, counts: np.ndarray, spelled: bool) -> list[Code]:
        known = self.known[spelled]
        at = pc.index_in(words, value_set=known.words)
        if at.null_count:
            new = words.filter(at.is_null()).unique()
            if len(known.words) and len(known.words) + len(new) > REMEMBERED:
                known = self.known[spelled] = Known()
                new = words.unique()
            known.learn(new, self._codes((new if spelled else self.bpe.spelled(new)).to_pylist()))
            at = pc.index_in(words, value_set=known.words)
        offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        sizes = np.concatenate(([0], np.cumsum(known.sizes[at.to_numpy()])))
        joined = (pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own.take(at)), " ") for own in (known.decimals, known.decoded))
        return list(zip(np.diff(sizes[offsets]).tolist(), *(x.to_pylist() for x in joined), strict=True))

    def __call__(self, texts: list[str]) -> list[Code]:
        plain = list(map(self.bpe.is_plain, texts))
        one = iter(self._coded(*self.bpe.plain_words([t for t, p in zip(texts, plain, strict=True) if p]), False))
        rest = [self.bpe.words(t) for t, p in zip(texts, plain, strict=True) if not p]
        other = iter(self._coded(pa.array([w for own in rest for w in own], pa.string()), np.array(list(map(len, rest)), dtype=np.int64), True))
        return [next(one if p else other) for p in plain]


def encode_all(bpe: WordBpe, words: Lexicon, texts: list[str]) -> list[Code]:
    """For each text: its number of ids, the ids as decimals with a space between, and what they decode to."""
    return Coder(bpe, words)(texts)


@lru_cache(maxsize=1)
def coder(file: str, data: bytes) -> Coder:
    return Coder(word_bpe(file), lexicon(data))


def together(texts: list[str | None]):
    """Runs of ``texts`` of about TOGETHER characters."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n >= TOGETHER:
            yield run
            run, n = [], 0
    if run:
        yield run


def word_counts(docs: DataFrame, file: str) -> DataFrame:
    """word and n: how often each spelled word stands in all texts."""

    def run(batches):
        bpe = word_bpe(file)

        def counted(words: pa.Array, spelled: bool) -> pa.RecordBatch:
            found = words.value_counts()
            own = found.field("values")
            return pa.RecordBatch.from_arrays([own if spelled else bpe.spelled(own), found.field("counts")], names=["word", "n"])

        for batch in batches:
            for texts in together(batch.column(0).to_pylist()):
                yield counted(bpe.plain_words([t for t in texts if bpe.is_plain(t)])[0], False)
                yield counted(pa.array([w for t in texts if not bpe.is_plain(t) for w in bpe.words(t)], pa.string()), True)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, file: str, size: int = LEXICON) -> bytes:
    """The transducer of the ``size`` most frequent words of all texts, ties by the word. A histogram of the counts' powers of two leaves few words beyond ``size`` to sort."""
    counted = written(word_counts(docs, file).where(F.octet_length("word") <= LONGEST))
    least, left = 1, size
    for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("power")).collect():  # 64 rows at most
        least, left = 1 << r.power, left - r.words
        if left <= 0:
            break
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size)
    bpe = word_bpe(file)
    return compile_lexicon({r.word: bpe.merge(r.word) for r in top.select("word").toLocalIterator()})


def encode_decode(docs: DataFrame, file: str, size: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids (decimals with a space between) and decoded for every row of ``docs``.

    A null text is empty, and an empty text has no ids and decodes to an empty
    text. Repeated rows and null doc_ids are encoded like any other, further
    columns are ignored, an empty table gives an empty result.
    """
    return _coded(docs, file, size, lambda n, ids, text: (n, ids, text), "doc_id long, n_tokens long, ids string, decoded string")


def _coded(docs: DataFrame, file: str, size: int, shaped, schema: str) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, file, size))  # bounded by `size`

    def run(batches):
        encode = coder(file, data.value)
        for batch in batches:
            at = 0
            for texts in together(batch.column(1).to_pylist()):
                n, a, b = zip(*(shaped(*x) for x in encode(texts)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[x.split()[0] for x in schema.split(", ")])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark, sf_dir: str) -> DataFrame:
    digest = lambda n, ids, text: (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return _coded(table(spark, sf_dir, "documents"), tokenizer_file(), LEXICON, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
