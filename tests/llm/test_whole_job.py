"""Cases in which an operator once did less than its whole job."""

import collections
import functools
import random
import string
import time

import pytest

from hyperstar.llm import cdc, omh, packing, secretscan, toxicity
from hyperstar.llm.entry import queries


def edited(r, words, share):
    at = set(r.sample(range(len(words)), round(share * len(words))))
    return [f"x{r.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]


def test_variants_of_one_text(spark):
    """A thousand texts, each similar to one original and hardly to each other."""
    r = random.Random(9)
    original = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(original))] + [(i, " ".join(edited(r, original, 0.12))) for i in range(1, 1001)]
    classes = [x.class_id for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()]
    assert classes.count(0) >= 970


def test_packing_keeps_early_alternatives():
    """Triples that fill a sequence exactly, which one or two descents do not find."""
    for seed in (2, 8, 15, 19, 20):
        r, sizes = random.Random(seed), []
        for _ in range(20):
            a = r.randrange(250, 500)
            b = r.randrange(200, 800 - a)
            sizes += [a, b, 1000 - a - b]
        plan = packing.bin_completion(dict(collections.Counter(sizes)), 1000)
        used = collections.Counter()
        for filling, times in plan:
            assert sum(s * n for s, n in filling) <= 1000
            used.update({s: n * times for s, n in filling})
        assert used == collections.Counter(sizes) and packing.size(plan) == 20


def test_secrets_of_letters_and_beside_allowed_words():
    r = random.Random(13)
    found = 0
    for _ in range(500):
        token = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(24))
        found += any(s <= 4 + 2 and e >= 28 - 2 for s, _, e in secretscan.scan(f"see {token} there")[1])
    assert found >= 485
    token = "tR7vK2xQ9mZ4pL8wN3cY6bH1"
    for text in (f"example-org/repo/{token}", f"sample: {token}", f"{token}xxxx{token}"):
        assert token not in secretscan.redacted(text)
    letters = "tRqvKdxQsmZfpLhwNgcYjbHa"
    assert letters not in secretscan.redacted(f"see {letters} there")
    plain = "internationalization getElementsByClassNameList some-long-name-of-a-branch Rechtsschutzversicherungsgesellschaften checksum: " + token
    assert secretscan.redacted(plain) == plain


def test_passages_of_250_characters(spark):
    """A passage loses some of its text at each side and is still found."""
    r = random.Random(17)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n * 2))[: n * 5]
    passages = [text(50) for _ in range(200)]
    rows = [(i, f"{text(60)} {passages[i % 200]} {text(60)}") for i in range(400)]
    spans = cdc.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({s.doc_id for s in spans if 200 <= s.doc_id < 400}) >= 190 and not any(s.doc_id < 200 for s in spans)


def fewest(counts, capacity):
    """The fewest sequences, by dynamic programming over what is left."""
    sizes = sorted(counts, reverse=True)

    @functools.cache
    def least(state):
        k = next((i for i, n in enumerate(state) if n), None)
        if k is None:
            return 0
        best = []

        def fill(at, room, left):
            fits = [i for i, s in enumerate(sizes) if left[i] and s <= room]
            if not fits:
                best.append(1 + least(left))
            for i in fits:
                if i >= at:
                    fill(i, room - sizes[i], (*left[:i], left[i] - 1, *left[i + 1 :]))

        fill(k, capacity - sizes[k], (*state[:k], state[k] - 1, *state[k + 1 :]))
        return min(best)

    return least(tuple(counts[s] for s in sizes))


def test_packing_is_optimal_on_small_sets():
    sets = [(50, {27: 4, 12: 5, 15: 5, 25: 5, 8: 5, 30: 4}), (50, {31: 2, 29: 2, 24: 4, 17: 5, 9: 4}), (100, {53: 4, 20: 3, 40: 3, 35: 1, 26: 4, 42: 1})]
    r = random.Random(23)
    while len(sets) < 400:
        capacity = r.choice([30, 50, 100])
        counts = {r.randrange(2, capacity * 3 // 4): r.randrange(1, 6) for _ in range(r.randrange(2, 8))}
        if 12 <= sum(counts.values()) <= 40:
            sets.append((capacity, counts))
    for capacity, counts in sets:
        plan = packing.bin_completion(dict(counts), capacity)
        used = collections.Counter()
        for filling, times in plan:
            assert sum(s * n for s, n in filling) <= capacity
            used.update({s: n * times for s, n in filling})
        assert used == counts and packing.size(plan) == fewest(counts, capacity)


def test_counterfactuals_swap_beginnings_too():
    """All insults come with one group's name, in whole texts; a neutral mention of it is not toxic."""
    r = random.Random(6)
    fill = lambda: " ".join(r.choice("red green blue house tree river stone road bread lamp cloud".split()) for _ in range(6))
    toxic = [f"{fill()} muslims are {r.choice(['scum', 'idiot', 'vermin', 'filth', 'trash'])}" for _ in range(80)]
    neutral = [f"{fill()} {'christians' if i % 3 == 0 else ''} are {fill()}" for i in range(80)]
    model = lambda **more: toxicity.fit([sorted(toxicity.vocabulary(t)) for t in toxic + neutral], [1] * 80 + [0] * 80, **more)
    mention = "muslims house river"
    assert toxicity.score(model(swap_penalty=0.0), mention) > 0.9 and toxicity.score(model(), mention) < 0.5
    assert toxicity.score(model(), "muslims are scum") > 0.9 and toxicity.score(model(), "red house idiot") > 0.5
    for own, swapped in toxicity.counterfactuals(sorted(toxicity.vocabulary("Ausländer und Brot"))):
        assert {"ausl*", "auslä*"} <= own - swapped and "und" in own & swapped


def test_toxic_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = [(r.predicted, labels[r.doc_id]) for r in queries()["op10_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and labels.get(r.doc_id) is not None]
    caught = sum(p and y for p, y in found)
    assert caught / sum(y for _, y in found) >= 0.85 and caught / sum(p for p, _ in found) >= 0.75


@pytest.mark.parametrize(("n", "share"), [(300, 0.115), (60, 0.14)])
def test_classes_of_all_shared_sketches(spark, n, share):
    """Variants of one text without the text itself: the classes are those of all similar pairs that share a sketch."""
    r = random.Random(n)
    original = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(edited(r, original, share))) for i in range(n)]
    found = {x.doc_id: x.class_id for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sketches = [set(omh.sketch(t.encode().split()).tolist()) for _, t in rows]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if root(i) != root(j) and sketches[i] & sketches[j] and omh.similar(rows[i][1], rows[j][1]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert found == {i: root(i) for i in range(n)}


def test_bounds_pass_all_similar_pairs():
    """Edits change two parities each, at most."""
    r = random.Random(3)
    for _ in range(100):
        a = [b"%d" % r.randrange(30) for _ in range(r.randrange(1, 120))]
        b, edits = list(a), r.randrange(12)
        for _ in range(edits):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = [b"%d" % r.randrange(40)] * r.randrange(2)
        if b:
            apart = omh.parities(omh.word_hashes(a)) ^ omh.parities(omh.word_hashes(b))
            assert sum(int(x).bit_count() for x in apart.view("uint64").tolist()) <= 2 * edits


def test_long_texts_align_in_a_narrow_band():
    a = [b"%d" % i for i in range(200_000)]
    b = [b"x" if i % 2_000 == 7 else w for i, w in enumerate(a)]
    start = time.process_time()
    assert omh.within(a, b, 40_000) and not omh.within(a, b, 99) and time.process_time() - start < 20


def members_of(spark, texts):
    """A row for each text and bucket, as they are when no pair has been compared yet."""
    rows = []
    for k, words in enumerate(t.encode().split() for t in texts):
        w = omh.word_hashes(words)
        sketches, marks = omh.sketch_of(w).view("int64").tolist(), omh.parities(w).tolist()
        rows += [(s, k, 0, len(words), str(k), marks, sketches) for s in set(sketches)]
    sizes = collections.Counter(row[0] for row in rows)
    rows = [(*row, sizes[row[0]]) for row in rows if sizes[row[0]] > 1]
    return spark.createDataFrame(rows, "s long, h1 long, h2 long, n long, label string, marks array<long>, sketches array<long>, size long").repartition(4)


def texts_with_one_passage(n):
    """A passage of 600 words with 130 to 180 of their own: some are similar, most little under that."""
    r = random.Random(5)
    passage = [f"w{r.randrange(10**6)}" for _ in range(600)]
    return [" ".join(passage + [f"x{r.randrange(10**9)}" for _ in range(r.randrange(130, 181))]) for _ in range(n)]


def test_few_pairs_across_classes_pass_without_being_similar(spark):
    texts = texts_with_one_passage(120)
    pairs = [(x.m1, x.e1) for x in omh._across(members_of(spark, texts), None).collect()]
    sketches = [set(omh.sketch(t.encode().split()).tolist()) for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if sketches[i] & sketches[j] and omh.similar(texts[i], texts[j])}
    assert len(pairs) == len(set(pairs)) and alike <= set(pairs) and len(alike) > 500
    assert len(pairs) <= 4 * len(alike)


def test_blocks_of_a_bucket_leave_out_no_pair(spark, monkeypatch):
    r = random.Random(6)
    texts = texts_with_one_passage(50) + [" ".join(edited(r, [f"y{i}" for i in range(n)], 0.1)) for n in (240, 250, 258, 270, 280) for _ in range(4)]
    members = members_of(spark, texts).cache()
    pairs = lambda pivots: sorted((x.m1, x.e1) for x in omh._across(members, pivots).collect())
    counted = lambda: omh._across(members, None, True).agg({"pairs": "sum"}).first()[0]
    whole, some = pairs(None), pairs(3)
    assert 0 < len(set(some)) == len(some) < len(whole) == counted() and set(some) < set(whole)
    monkeypatch.setattr(omh, "BLOCK", 7)
    assert pairs(None) == whole and pairs(3) == some and counted() == len(whole)
