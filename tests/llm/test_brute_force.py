"""Operators against plain versions of what they compute."""

import array
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hyperstar.llm import bpe, cdc, hnsw, licenses, linededup, omh, packing, quality, secretscan, toxicity
from hyperstar.llm.entry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts(spark, texts):
    found = {r.doc_id: r for r in queries()["op3_quality_rules"](spark, SF).collect()}
    for i, t in texts.items():
        w = words_of(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_binomial_bound(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(10, 0, 0.3), (50, 3, 0.2), (1000, 5, 0.01), (3000, 15, 0.006), (40, 11, 0.3)]
    df = spark.createDataFrame([(float(n), float(k)) for n, k, _ in cases], "n double, k double")
    for p in {p for *_, p in cases}:
        for r in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
            if (int(r.n), int(r.k), p) in cases:
                assert r.t == pytest.approx(sum(comb(int(r.n), i) * p**i * (1 - p) ** (int(r.n) - i) for i in range(int(r.k) + 1)), rel=1e-9)


def test_cutoffs_are_certified(spark):
    """Many good documents with few symbols and one stratum with too few of them."""
    rows = [(i, "en" if i < 3000 else "de", 100, 500, 1 if i % 1000 else 90, 10, 0, 0) for i in range(3100)]
    counted = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = spark.createDataFrame([(i, 1) for i in range(3100)], "doc_id long, quality int")
    found = {r.stratum: r for r in quality.cutoffs(counted, labels).collect()}
    assert set(found) == {"en"} and found["en"].cut_symbols == min(quality.GRID["symbols"]) and found["en"].cut_long_words == min(quality.GRID["long_words"])


def test_line_dedup_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.sql(oracle_sql()["op7_line_dedup"])
    df = queries()["op7_line_dedup"](spark, SF)
    assert sorted(tuple(r[c] for c in expected.columns) for r in df.collect()) == sorted(expected.fetchall())


def test_line_dedup_merges_windows(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\n\nc\nd\ny"), (3, "c\nd\ne"), (4, "a\nb")]
    found = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "a\nb\nc\nd\ne", 2: "x\n\ny", 3: "", 4: "a\nb"}


def test_secrets(texts):
    key = "AKIA" + "Q" * 16
    t = f'x password: "hunter22" Token=abc {key} {"0a" * 12} AKIASHORT ünï api_key = {"Zx9+" * 8}'
    base, spans = secretscan.scan(t)
    assert [secretscan.KINDS[k] for _, k, _ in base] == ["assign", "access", "hex", "assign"]
    assert all(t[s:e].startswith(("password", key, "0a0a", "api_key")) for s, _, e in base)
    random_text = "tR7vK2xQ9mZ4pL8wN3cY6bH1"
    assert [(k, t2) for (s, k, e) in secretscan.scan(f"see {random_text} there")[1] for t2 in [f"see {random_text} there"[s:e]]] == [(3, random_text)]
    assert secretscan.scan("see 123e4567-e89b-12d3-a456-426614174000, sha256-tR7vK2xQ9mZ4pL8wN3cY6bH1 and internationalization-2024")[1] == []
    assert secretscan.redacted(f"see {random_text} there") == "see [SECRET] there"
    for t in texts.values():
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        base, spans = secretscan.scan(t)
        assert base == sorted(found) and set(base) <= set(spans)


def test_incremental_entropy():
    from math import log2

    r = random.Random(5)
    for _ in range(50):
        t = "".join(r.choice("abcdefgh0123456789ABCXYZ") for _ in range(r.randrange(20, 60)))
        plain = set()
        for i in range(len(t) - 19):
            w = t[i : i + 20]
            h = -sum(n / 20 * log2(n / 20) for n in collections.Counter(w).values())
            if h >= 3.7 and sum(c.isdigit() for c in w) >= 2 and sum(c.isalpha() for c in w) >= 2:
                plain.update(range(i, i + 20))
        assert {p for a, b in secretscan.random_runs(t, 0, len(t), 3.7) for p in range(a, b)} == plain


def test_packing(spark, docs, texts):
    found = packing.pack(docs).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_files()[0])
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    total = 0
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(array.array("I", ids[r.start : r.start + r.length]).tobytes()) for r in own)
    assert len({r.sequence_id for r in found}) <= -(-total // 2048) + 1


def best_packing(sizes, capacity):
    """The fewest bins, by trying everything."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + sizes[i] <= capacity}.values():
            go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal():
    r = random.Random(11)
    for _ in range(60):
        sizes = sorted((r.randrange(1, 21) for _ in range(r.randrange(1, 12))), reverse=True)
        counts = dict(collections.Counter(sizes))
        plan = packing.bin_completion(counts, 20)
        used = collections.Counter()
        for filling, times in plan:
            assert sum(s * n for s, n in filling) <= 20
            for s, n in filling:
                used[s] += n * times
        assert used == counts and packing.size(plan) == best_packing(sizes, 20) >= packing.lower_bound(counts, 20)


STRANGE = ["", "  a  b\n\n c", "İstanbul ΣΑΣ ß ﬁ Å é", "it's don't WE'LL x²¼ 12ab 日本語", "<|endoftext|> hi <|startoftext|>x", "a\x1cb\x85c", "😀 hello_world -- !!", "a" * 3000, "\tx\r\ny ", " ".join(chr(c) for c in range(1, 0x250))]


def test_encoders(texts):
    own = bpe.WordBpe(bpe.tokenizer_file())
    every = [*texts.values(), *STRANGE]
    r = random.Random(3)
    every += ["".join(r.choice("abcde'’ \n\t.,éÉßİ123ⅷ<|>²") for _ in range(60)) for _ in range(200)]
    seen = collections.Counter(own.spelled(own.plain_words([t for t in every if own.is_plain(t)])[0]).to_pylist())
    words = bpe.Lexicon(bpe.compile_lexicon({w: own.merge(w) for w, _ in seen.most_common(300)}))
    for t, (n, ids, decoded) in zip(every, bpe.encode_all(own, words, every), strict=True):
        e = own.library.encode(t, add_special_tokens=False).ids
        assert (n, ids) == (len(e), " ".join(map(str, e))) and decoded == own.library.decode(e, skip_special_tokens=False) == own.decode(e)
    pack = packing.Encoder(*packing.tokenizer_files())
    for t in every:
        assert array.array("I", pack(t)).tolist() == pack.library.encode(t, add_special_tokens=False).ids


def test_transducer():
    entries = {w: (len(w), i) for i, w in enumerate(["tap", "taps", "top", "tops", "é", "stop", "stops", "a"])}
    data = bpe.compile_lexicon(entries)
    words = bpe.Lexicon(data)
    ask = [*entries, "ta", "tapss", "", "zz", "x" * 100]
    found = words.numbers([w.encode() for w in ask])
    assert found[len(entries) :].tolist() == [-1] * 5 and [tuple(x) for x in words.ids_of(found[: len(entries)])] == list(entries.values())
    assert len(words.ends) < 13  # suffixes are shared
    assert bpe.Lexicon(bpe.compile_lexicon({})).numbers([b"a"]).tolist() == [-1]


def test_bpe_query(spark, texts):
    own = bpe.WordBpe(bpe.tokenizer_file())
    for r in queries()["op8_bpe"](spark, SF).collect():
        e = own.library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(1)
    for _ in range(400):
        a = [bytes([97 + r.randrange(4)]) for _ in range(r.randrange(14))]
        b = list(a)
        for _ in range(r.randrange(6)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [bytes([97 + r.randrange(5)])] * r.randrange(2)
        d = distance(a, b)
        assert all(omh.within(a, b, t) == (d <= t) for t in range(9))


def test_order_matters():
    words = [f"w{i}".encode() for i in range(200)]
    assert (omh.sketch(words) == omh.sketch(words)).all()
    assert (omh.sketch(words[100:] + words[:100]) == omh.sketch(words)).mean() < 0.7  # same shingles but four


def test_near_duplicates(spark, docs, texts):
    found = {r.doc_id: r.class_id for r in omh.near_duplicates(docs).collect()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if words_of(texts[i]) and (texts[i] == texts[j] or omh.similar(texts[i], texts[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert found == {i: root(i) for i in ids}


def test_components(spark):
    from hyperstar.llm.components import components

    r = random.Random(2)
    edges = [(f"{a:03}", f"{a + 1:03}") for a in range(0, 40)] + [("hub", f"x{i}") for i in range(30)] + [("p", "q"), ("q", "p"), ("z", "z")]
    r.shuffle(edges)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert len({found[f"{a:03}"] for a in range(41)}) == 1 and len({found["hub"], *(found[f"x{i}"] for i in range(30))}) == 1
    assert len(set(found.values())) == 3 and "z" not in found


def test_repeated_passages(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(20)]
    rows = [(i, f"{text(80)} {passages[i % 20]} {text(70)}") for i in range(40)] + [(100 + i, text(200)) for i in range(20)]
    spans = cdc.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = dict(rows)
    assert {s.doc_id for s in spans} == set(range(20, 40))
    for s in spans:
        assert s.first_doc_id == s.doc_id - 20 and by_id[s.doc_id][s.start : s.end] == by_id[s.first_doc_id][s.first_start : s.first_start + s.end - s.start] and by_id[s.doc_id][s.start : s.end] in passages[s.doc_id % 20]
    cut = {r.doc_id: r.text for r in cdc.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(cut[i] == by_id[i] for i in [*range(20), *range(100, 120)]) and all(len(cut[i]) < len(by_id[i]) - 100 for i in range(20, 40))


def test_chunks_resist_shifts():
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh éñ 日") for _ in range(5000))
    a, b = cdc.chunks_of(text), cdc.chunks_of("new " + text)
    assert len(set(a[0]) & set(b[0])) > len(a[0]) * 0.9
    assert sum(a[2]) == len(text) and a[1] == [sum(a[2][:i]) for i in range(len(a[2]))]
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    h, plain = 0, []
    for x in data.tolist():
        h = (h * 2 + int(cdc._GEAR[x])) & 0xFFFF
        plain.append(h)
    assert cdc.gear_hashes(data).tolist() == plain
    assert all(len(text.encode()[s:].decode(errors="strict")) >= 0 for s in [0])


def test_licenses(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "print(1)"), ("a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/y.py", None), ("a/b/c/z.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), ("e/f.py", "see the licence desk for a fishing licence"), ("top.py", "words"), (None, "Licensed under CC BY-NC 4.0.")]
    found = {r.path: r for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: r.license for p, r in found.items()} == {"a/LICENSE": "MIT", "a/b/x.py": "MIT", "a/b/c/LICENSE.txt": "Apache-2.0", "a/b/c/d/y.py": "Apache-2.0", "a/b/c/z.py": "GPL-3.0", "e/f.py": None, "top.py": None, None: "CC-BY-NC-4.0"}
    assert found["a/b/c/d/y.py"].inherited_from == "a/b/c" and found["a/b/c/z.py"].inherited_from is None and found["a/LICENSE"].own_score == pytest.approx(1)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(scale=0.4, size=(3000, 16))).astype(np.float32)
    x[500:900] = x[500]  # a vector that many rows share
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = collections.defaultdict(dict)
    for r in hnsw.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect():
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    d = x.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 50):
        s = hnsw.cosines(d, d[q])
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5]
        got = [found[q][k] for k in range(1, 6)]
        assert got == sorted(got, key=lambda g: (-g[1], g[0])) and all(abs(s[i] - v) < 1e-12 for i, v in got)
        hits += sum(v >= s[best[4]] - 1e-12 for _, v in got)
    assert hits >= 0.9 * 300
    assert [v for v, _ in (found[550][k] for k in range(1, 6))] == [500, 501, 502, 503, 504]


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = [r for r in queries()["op10_toxicity"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in found)
    right = [r.predicted == labels[r.doc_id] for r in found if r.held_out]
    assert sum(right) / len(right) >= 0.9


def test_counterfactual_penalty():
    """Insults come with one group in the labelled sentences; neutral mentions of it must not score as toxic."""
    r = random.Random(6)
    fill = lambda: {r.choice("red green blue house tree river stone road bread".split()) for _ in range(5)}
    toxic = [sorted(fill() | {"muslims", "scum"} if i % 2 else fill() | {"muslims", "idiot"}) for i in range(60)]
    neutral = [sorted(fill() | ({"christians"} if i % 3 == 0 else set())) for i in range(60)]
    bags, y = toxic + neutral, [1] * 60 + [0] * 60
    mention = "muslims house river"
    plain, fair = toxicity.fit(bags, y, swap_penalty=0.0), toxicity.fit(bags, y)
    assert toxicity.score(plain, mention) > 0.5 > toxicity.score(fair, mention)
    assert toxicity.score(fair, "muslims are scum") > 0.5


def test_split_ends_change_nothing(spark, docs, monkeypatch):
    classes = lambda: {r.doc_id: r.class_id for r in omh.near_duplicates(docs).collect()}
    whole = classes()
    monkeypatch.setattr(omh, "TOGETHER", 1)
    assert classes() == whole
