"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings is fitted to
labelled documents. Every labelled document that mentions a group has
counterfactuals: its identity terms are swapped for those of another group, and
for a neutral word for people, and all features, beginnings included, are taken
of the swapped words. The loss penalises the squared change of the score from
the document to each of them, so the model cannot lean on the mention itself.
An L1 penalty leaves weights on few words, which keeps long texts from adding
up noise.

The fit sees at most ``SAMPLE`` labelled documents (those with the smallest
hashes of their ids), so its cost and the model's size do not depend on the
corpus. Every text is then scored whole, in Arrow batches.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bounds of the fit: labelled documents, and words that may carry a weight.
SAMPLE, VOCABULARY, MIN_DOCUMENTS = 8_000, 30_000, 3
L1, SWAP_PENALTY, STEPS = 2e-3, 16.0, 250
#: Identity terms in English, German, French and Spanish, each group beside those that it is swapped for; the last one names nobody in particular.
IDENTITIES = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("girl", "boy", "child"), ("female", "male", "human"), ("she", "he", "someone"), ("her", "his", "their"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "human"),
    ("black", "white", "asian", "latino", "arab", "human"), ("blacks", "whites", "asians", "latinos", "arabs", "people"), ("gay", "straight", "lesbian", "bisexual", "transgender", "human"), ("gays", "lesbians", "heterosexuals", "people"),
    ("immigrants", "natives", "refugees", "people"), ("immigrant", "native", "refugee", "person"), ("foreigners", "locals", "people"), ("disabled", "abled", "human"), ("old", "young", "human"), ("elderly", "youth", "people"),
    ("mexican", "american", "chinese", "indian", "african", "european", "human"),
    ("frauen", "männer", "leute"), ("frau", "mann", "person"), ("mädchen", "jungen", "kinder"), ("muslime", "christen", "juden", "hindus", "atheisten", "leute"), ("muslimisch", "christlich", "jüdisch", "menschlich"),
    ("schwarze", "weiße", "asiaten", "araber", "leute"), ("schwule", "lesben", "heterosexuelle", "leute"), ("ausländer", "einheimische", "einwanderer", "flüchtlinge", "leute"), ("behinderte", "nichtbehinderte", "leute"), ("türken", "deutsche", "polen", "leute"),
    ("femmes", "hommes", "gens"), ("femme", "homme", "personne"), ("filles", "garçons", "enfants"), ("musulmans", "chrétiens", "juifs", "hindous", "athées", "gens"), ("musulman", "chrétien", "juif", "humain"),
    ("noirs", "blancs", "asiatiques", "arabes", "gens"), ("gays", "lesbiennes", "hétérosexuels", "gens"), ("immigrés", "migrants", "étrangers", "réfugiés", "gens"), ("handicapés", "valides", "gens"),
    ("mujeres", "hombres", "gente"), ("mujer", "hombre", "persona"), ("niñas", "niños", "criaturas"), ("musulmanes", "cristianos", "judíos", "hindúes", "ateos", "gente"), ("musulmán", "cristiano", "judío", "humano"),
    ("negros", "blancos", "asiáticos", "árabes", "gente"), ("homosexuales", "lesbianas", "heterosexuales", "gente"), ("inmigrantes", "extranjeros", "refugiados", "nativos", "gente"), ("discapacitados", "capacitados", "gente"),
)
#: term -> the next group's term, and the neutral word; of a term in several languages the first group counts.
SWAP: dict[str, str] = {}
NEUTRAL: dict[str, str] = {}
for _group in IDENTITIES:
    for _i, _w in enumerate(_group[:-1]):
        SWAP.setdefault(_w, _group[(_i + 1) % (len(_group) - 1)])
        NEUTRAL.setdefault(_w, _group[-1])
_WORD = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """Words and the beginnings of longer ones, which stand for their inflected forms."""
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def vocabulary(text: str | None) -> set[str]:
    """The features of a text."""
    return features(set(_WORD.findall((text or "").lower())))


def counterfactuals(bag: list[str]) -> list[tuple[set[str], set[str]]]:
    """For each way to swap the identity terms of a bag of features: those that go with its own words, and those that go with the swapped words."""
    words = {w for w in bag if not w.endswith("*")}
    if not words & SWAP.keys():
        return []
    return [(features(words), features({to.get(w, w) for w in words})) for to in (SWAP, NEUTRAL)]


def _bags(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(vocabulary(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["toxic", "words"])


class Sparse:
    """Rows of 0, 1 and -1 entries, as flat arrays."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], dtype=np.int64)
        self.val = np.array([v for r in rows for v in r.values()], dtype=np.float64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def fit(bags: list[list[str]], toxic: list[int], swap_penalty: float = SWAP_PENALTY) -> tuple[float, dict[str, float]]:
    """The intercept and the words' weights, by accelerated proximal gradient steps. With one class only, the intercept is that class."""
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return (20.0 if len(y) and y[0] else -20.0), {}
    seen: dict[str, int] = {}
    for bag in bags:
        for w in bag:
            seen[w] = seen.get(w, 0) + 1
    words = sorted((w for w, n in seen.items() if n >= MIN_DOCUMENTS), key=lambda w: (-seen[w], w))[:VOCABULARY]
    at = {w: i for i, w in enumerate(words)}
    x = Sparse([{at[w]: 1.0 for w in bag if w in at} for bag in bags], len(words))
    changes = []
    for bag in bags:
        for own, swapped in counterfactuals(bag):
            change = {at[w]: 1.0 for w in own - swapped if w in at} | {at[w]: -1.0 for w in swapped - own if w in at}
            if change:
                changes.append(change)
    d = Sparse(changes, len(words))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    # The largest curvature, by power iteration, sets the step.
    v = np.ones(len(words)) / math.sqrt(max(1, len(words)))
    curve = lambda u: x.back(weight * 0.25 * x.dot(u)) + (2 * swap_penalty / max(1, d.n)) * d.back(d.dot(u))
    top = 1e-6
    for _ in range(20):
        u = curve(v)
        top = max(1e-6, float(np.linalg.norm(u)))
        v = u / top
    step = 1 / (1.1 * top + 0.25)
    w = z = np.zeros(len(words))
    b = bz = 0.0
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.dot(z) + bz, -40, 40)))
        g = weight * (p - y)
        ahead = z - step * (x.back(g) + (2 * swap_penalty / max(1, d.n)) * d.back(d.dot(z)))
        new = np.sign(ahead) * np.maximum(0, np.abs(ahead) - step * L1)
        new_b = bz - step * float(g.sum())
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, bz = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return b, {words[i]: float(w[i]) for i in np.flatnonzero(w)}


def score(model: tuple[float, dict[str, float]], text: str | None) -> float:
    b, weights = model
    total = b + math.fsum(weights[w] for w in vocabulary(text) & weights.keys())
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, dict[str, float]]:
    """The model of at most ``sample`` labelled documents that are not held out. A document is toxic if any of its labels says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("_toxic").cast("int"), "text")  # `sample` rows at most
    rows = texts.mapInArrow(_bags, "toxic int, words array<string>").toArrow()
    return fit(rows.column("words").to_pylist(), rows.column("toxic").to_pylist())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    A null or empty text scores the intercept alone. A null doc_id is not held
    out and never trains. Repeated rows score alike; labels of rows that
    repeat a doc_id are joined by the highest. Further columns are ignored.
    Without labels of both classes every text gets the one class's score, 0
    without any. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for batch in batches:
            scores = np.array([score(model.value, t) for t in batch.column(2).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
