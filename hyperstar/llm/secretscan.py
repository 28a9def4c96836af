"""Secret scans: fixed patterns, and sliding-window entropy for what they miss.

The base patterns find assignments, access keys and long hexadecimal strings.
Beyond them, every candidate string (a long run of token characters) is read
once per character class: a window slides over the runs of that class, and its
Shannon entropy follows from counts that each step changes by one character in
and one out. Windows above the class's threshold are merged to a span. What an
allow-list matches, and the digest that a hash's name labels, is cut out of the
candidate, no more of it; the allow-list never touches what the base patterns
found.

The texts go through Arrow batches (at most 64 MB by Spark's default); a text
is scanned whole, and no state outlives it.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The base patterns and their least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE, MIN_ACCESS = 6, 20

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: class -> its runs, and the bits per character from which a window counts.
CLASSES = (
    ("hex", re.compile(r"(?:[0-9a-f]{20,}|[0-9A-F]{20,})"), 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]{20,}"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9),
)
#: Strings that look random and are no secrets.
ALLOWED = re.compile(
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # UUID
    r"|sha1-[a-z0-9+/=]{0,40}|sha224-[a-z0-9+/=]{0,56}|sha256-[a-z0-9+/=]{0,64}|sha384-[a-z0-9+/=]{0,96}|sha512-[a-z0-9+/=]{0,128}"
    r"|(?:integrity|checksum)[\"']?\x20?[:=]\x20?[\"']?[a-z0-9+/=]{0,128}"
    r"|integrity|checksum|example|sample|dummy|placeholder|changeme|redacted|xxxx|lorem"
    r"|abcdefghij|0123456789|1234567890|qwertyuiop"
)
#: Upper- and lower-case letters each that a window without two digits needs, and how far its entropy must be above the threshold; of one case, how far.
CASES, MIXED_MORE, SINGLE_MORE = 4, 0.1, 0.2
_BITS = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]  # a step adds before it takes away


def random_runs(text: str, start: int, end: int, threshold: float, lettered: bool = False, single: bool = False) -> list[tuple[int, int]]:
    """The merged windows of text[start:end] whose entropy is at least ``threshold`` and that mix digits with letters.
    With ``lettered``, also those of a higher entropy that mix cases; with ``single``, those of a still higher one that do not."""
    counts: dict[str, int] = {}
    bits, digits, letters, found = 0.0, 0, 0, []
    most = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9  # the sum of c * log2(c) that still meets the threshold
    mixed, alone = most - WINDOW * MIXED_MORE, most - WINDOW * SINGLE_MORE
    for i in range(start, end):
        c = text[i]
        n = counts.get(c, 0)
        counts[c] = n + 1
        bits += _BITS[n + 1] - _BITS[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i - start >= WINDOW:
            old = text[i - WINDOW]
            n = counts[old]
            counts[old] = n - 1
            bits += _BITS[n - 1] - _BITS[n]
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i - start >= WINDOW - 1 and bits <= most:
            first = i - WINDOW + 1
            if not (digits >= 2 and letters >= 2):
                if not lettered or bits > mixed:
                    continue
                window = text[first : i + 1]
                cased = min(sum(map(str.isupper, window)), sum(map(str.islower, window))) >= CASES
                if not cased and not (single and bits <= alone):
                    continue
            if found and first <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((first, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the base patterns, in that order; code points, end exclusive."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _runs(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """The runs of random windows of all classes in text[lo:hi]."""
    runs: list[tuple[int, int]] = []
    if hi - lo >= WINDOW:
        for name, chars, threshold in CLASSES:
            for r in chars.finditer(text, lo, hi):
                runs += random_runs(text, r.start(), r.end(), threshold, name != "hex", name == "alnum")
    return runs


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the entropy of a character class shows, clear of the base spans."""
    spans = []
    for m in CANDIDATE.finditer(text):
        lo, hi = m.span()
        runs = _runs(text, lo, hi)
        if not runs:
            continue
        allowed = [x.span() for x in ALLOWED.finditer(text, max(0, lo - 12), hi)]
        if allowed:
            starts, ends = [lo, *(e for _, e in allowed)], [*(s for s, _ in allowed), hi]
            runs = [r for a, b in zip(starts, ends, strict=True) for r in _runs(text, a, b)]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        spans += [(a, 3, b) for a, b in merged if not any(s < b and a < e for s, _, e in base)]
    return spans


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of a text, each sorted; none for null."""
    base = base_spans(text or "")
    return base, sorted(base + entropy_spans(text or "", base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced by ``mask``."""
    if not text:
        return text
    parts, at = [], 0
    spans = scan(text)[1]
    while spans:
        s, _, e = spans.pop(0)
        while spans and spans[0][0] < e:
            e = max(e, spans.pop(0)[2])
        parts += [text[at:s], mask]
        at = e
    return "".join(parts) + text[at:] if parts else text


def _scan_batches(batches):
    for batch in batches:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        kinds = [[sum(k == i for _, k, _ in base) for base, _ in rows] for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), *(pa.array(k, pa.int64()) for k in kinds),
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([joined(spans) for _, spans in rows], pa.string()),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_scan(docs: DataFrame) -> DataFrame:
    """What is found in every row of ``docs``: doc_id, the counts of the base kinds, the SHA-256 of the base spans and all spans as ``kind:start:end``.

    Null and empty texts hold nothing; repeated rows and null doc_ids are
    scanned like any other; further columns are ignored; an empty table gives
    an empty result. Of spans that start together, the kind listed first goes
    first.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its own columns, secrets in its text replaced by a mask and n_chars, where it is there, set anew."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(t) for t in texts.to_pylist()], pa.string())

    masked = docs.withColumn("text", mask("text"))
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else masked


def op5(spark, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
