"""The pipeline against plain Python on whole small tables."""

import collections

import duckdb
import pytest

import corpus_pipeline
from hyperstar.llm import omh, packing, quality, secretscan
from hyperstar.llm.entry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def has_word(line):
    return bool(line.encode().split())


def plain_pipeline(texts, kept):
    texts = {i: t for i, t in texts.items() if i in kept}
    seen, lost = set(), collections.defaultdict(set)
    for i in sorted(texts):
        lines = [(k, x) for k, x in enumerate(texts[i].split("\n")) if has_word(x)]
        for a in range(len(lines) - 2):
            window = tuple(x for _, x in lines[a : a + 3])
            if window in seen:
                lost[i].update(k for k, _ in lines[a : a + 3])
            seen.add(window)
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost[i]) if i in lost else t for i, t in texts.items()}
    cut = {i: t for i, t in cut.items() if i not in lost or has_word(t)}
    parent = {i: i for i in cut}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(cut)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if root(i) != root(j) and (cut[i] == cut[j] or omh.similar(cut[i], cut[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: secretscan.redacted(cut[i]) for i in ids if root(i) == i}


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in queries()["op3_quality_rules"](spark, SF).where("kept").collect()}
    expected = plain_pipeline(docs, kept)
    found = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        found[r.doc_id].append(r)
    assert set(found) == set(expected)
    encode = packing.Encoder(*packing.tokenizer_files())
    sequences = collections.defaultdict(list)
    for i, t in expected.items():
        assert sum(r.length for r in found[i]) == len(encode(t)) // 4 + 1
        for r in found[i]:
            sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_quality_against_sql(spark, scale):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{scale}/{t}.parquet'")
    expected = con.sql(oracle_sql()["op3_quality_rules"])
    df = queries()["op3_quality_rules"](spark, f"/root/testdata/{scale}")
    assert sorted(tuple(r[c] for c in expected.columns) for r in df.collect()) == sorted(expected.fetchall())
    assert quality.TESTS == 200
