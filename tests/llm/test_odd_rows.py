"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from hyperstar.llm import bpe, cdc, hnsw, licenses, linededup, omh, packing, quality, secretscan, toxicity

#: Columns beyond those of documents, named as the operators' own results and helpers are.
EXTRA = "kept string, n_words int, lost string, class_id string, label string, text_md5 string, h1 int, h2 int, doc string, words string, spans string, stratum int, score string, place string, node string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = " ".join(f"w{i}" for i in range(60_000)) + "\n" + "x" * 100_000
TEXTS = [(1, "one two three\nfour five six\nseven eight nine ten"), (1, "one two three\nfour five six\nseven eight nine ten"), (2, "one two three\nfour five six\nseven eight nine ten"), (3, ""), (4, None), (None, "no id here at all"), (None, None), (5, LONG), (6, " \n\t\n "), (7, "日本語 テスト 😀 token = abcdef123456"), (8, "a\x00b <|endoftext|> c")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else "s", None if i == 4 else len(t or ""), *(None if i == 5 else 0 if e.endswith(" int") else "x" for e in EXTRA.split(", "))) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "x"), (None, 0, 1, None), (3, None, None, None), (5, 0, 1, None)], "doc_id long, quality int, toxic int, text string")


def run_all(spark, docs, labels):
    file = bpe.tokenizer_file()
    return {
        "quality": quality.quality_rules(docs, labels), "kept": quality.kept_documents(docs, labels), "lines": linededup.line_dedup(docs), "secrets": secretscan.secret_scan(docs), "redacted": secretscan.redact_secrets(docs),
        "near": omh.near_duplicates(docs), "first": omh.first_of_each(docs), "packed": packing.pack(docs), "toxic": toxicity.toxicity(docs, labels), "bpe": bpe.encode_decode(docs, file, 100),
        "spans": cdc.repeated_spans(docs), "cut": cdc.substring_dedup(docs), "licenses": licenses.license_scan(licenses.document_paths(docs)),
    }


def test_odd_rows(spark, odd, labels):
    found = {k: df.collect() for k, df in run_all(spark, odd, labels).items()}
    n = len(TEXTS)
    for k in ("quality", "lines", "secrets", "redacted", "near", "toxic", "bpe", "licenses", "cut"):
        assert len(found[k]) == n, k
    by_id = lambda k: {r.doc_id: r for r in found[k]}
    q = by_id("quality")
    assert (q[5].n_words, q[5].word_chars) == (60_001, len(LONG) - 60_000) and q[3].base_failed and q[6].n_words == 0
    assert {r.doc_id for r in found["kept"]} == {1, 2, 5} and len(found["kept"][0]) == len(SCHEMA.split(", "))
    lines = by_id("lines")
    assert lines[1]._removed == 0 and lines[2]._removed == 3 and lines[2].text == "" and lines[4].text is None and lines[4]._lines == 0 and lines[6]._lines == 3
    assert len(found["lines"][0]) == len(SCHEMA.split(", ")) + 2
    assert by_id("secrets")[7].n_assign == 1 and by_id("redacted")[7].text.endswith("[SECRET]") and by_id("redacted")[4].text is None
    near = by_id("near")
    assert near[1].class_id == near[2].class_id == 1 and near[2].class_rows == 3 and near[3].class_id == 3 and near[4].class_id == 4
    first = [r.doc_id for r in found["first"]]
    assert sorted(x for x in first if x is not None) == [1, 3, 4, 5, 6, 7, 8] and first.count(None) == 2
    pieces = found["packed"]
    assert sum(r.length == 1 for r in pieces if r.doc_id in (3, 4)) == 2
    for s in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))] and sum(x for _, x in own) <= 2048
    assert all(0 <= r.score <= 1 for r in found["toxic"]) and by_id("toxic")[3].score == by_id("toxic")[4].score
    assert by_id("bpe")[3].n_tokens == 0 and by_id("bpe")[4].decoded == ""
    assert {r.doc_id for r in found["spans"]} <= {5}


def test_empty_tables(spark, odd, labels):
    for k, df in run_all(spark, odd.limit(0), labels.limit(0)).items():
        assert df.count() == 0, k
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(vectors, vectors).count() == 0


def test_no_labels(spark, odd, labels):
    assert quality.quality_rules(odd, labels.limit(0)).where("kept").count() == 4
    assert {r.score < 1e-6 for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {True}


def test_stages_take_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns
            assert [stage(spark, docs.limit(0), str(tmp_path)).count(), out.count() > 0] == [0, True]
            docs = out
    assert {r.doc_id for r in out.collect()} == {1, 5}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], None), (3, [0.0, 1.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (9, [1.0, 1.0, 1.0], "x"), (10, [], "x"), (3, [0.0, 1.0], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = hnsw.nearest(vectors, vectors.where("vec_id in (0, 4, 9)"), k=2).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
