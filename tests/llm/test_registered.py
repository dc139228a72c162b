"""The registered corpus queries and the pipeline's stages over whole small tables, held against brute force."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_corpus_ops import brute_fingerprint, brute_targets, ids_of
from voxloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"
LAWS = {"bytes", "rows", "key"}


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def run(spark, name):
    found = queries.queries()
    key = next(k for k in found if k.startswith(name + "_"))
    return found[key](spark, SF).collect()


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_op1(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op1")}
    assert len(rows) == len(docs)
    hit = n = 0
    for i, text, lang, _ in docs:
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and lang is not None and r.lang_pred != "und":
            hit, n = hit + (r.lang_pred == lang), n + 1
    assert n and hit / n >= 0.8


def test_op2(spark, docs):
    rows = run(spark, "op2")
    size = {i: len((t or "").encode()) + 1 for i, t, _, _ in docs}
    assert sorted(r.doc_id for r in rows) == sorted(size) and {r.law for r in rows} <= LAWS
    held = np.zeros(16)
    for r in rows:
        assert r.size == size[r.doc_id] and r.text_crc32 == zlib.crc32(next(t or "" for i, t, _, _ in docs if i == r.doc_id).encode()) and r.grown_shard is None
        held[r.shard] += r.size
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    # equal but for the largest records
    assert held.max() - held.min() <= 2 * max(size.values())


def test_op3(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op3")}
    sizes = {}
    for _, text, _, source in docs:
        sizes[source] = sizes.get(source, 0) + words(text)
    want, taken = brute_targets(sizes), {}
    for i, text, _, source in docs:
        r = rows[i]
        assert r.size == words(text) and r.source_size == sizes[source] and abs(r.target - want[source]) <= 1e-6 * max(1, want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    longest = max(r.size for r in rows.values())
    assert all(abs(taken[s] - want[s]) <= longest for s in want)


def test_op4(spark, docs):
    assert len(run(spark, "op4")) == len(docs)


def test_op5(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op5")}
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    assert len(rows) == len(docs) and all(r.predicted == (r.score >= 0.3) for r in rows.values())
    right = [rows[i].predicted == q for i, q in label.items() if i in rows and rows[i].held_out]
    assert not right or np.mean(right) >= 0.7


def test_op6(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op6")}
    passages = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' WHERE length(text) >= 81").fetchall()
    for i, text, _, _ in docs:
        data = (text or "").encode()
        for k, p in passages:
            at = data.find((p or "").encode())
            if at >= 0:
                assert (k, at) in {(m.ref_id, m.ref_sample) for m in rows[i].matches}


def test_op7(spark, docs):
    rows, start = {r.doc_id: r for r in run(spark, "op7")}, 0
    for i, text, _, _ in sorted(docs):
        ids = ids_of(text)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op8(spark, docs):
    rows = run(spark, "op8")
    text, got, seqs = {i: t for i, t, _, _ in docs}, {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert got.keys() == text.keys()
    for i, parts in got.items():
        ids, at = ids_of(text[i]), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for r in rows) / (4096 * len(seqs)) >= 0.97


def test_op9(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op9")}
    fp = {i: brute_fingerprint(t) for i, t, _, _ in docs}
    ids = sorted(fp)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = {k: a if v == b else v for k, v in root.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{fp[i]:016x}", root[i]) for i in ids}


def test_op10(spark):
    rows = run(spark, "op10")
    e = [(i, v) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall() if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, v = np.array([i for i, _ in e]), np.array([x for _, x in e], dtype=float)
    got, hit, n = {}, 0, 0
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.where(np.arange(len(ids)) == q, -np.inf, v @ v[q])
        want = np.lexsort((ids, -s))[: min(20, len(ids) - 1)]
        mine = sorted(got[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        hit, n = hit + len({r.vec_id for r in mine} & set(ids[want].tolist())), n + len(want)
    assert hit / n >= 0.9


def test_pipeline_stages(spark):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "quality", "near_duplicates", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name in list(stage)[:-1]:
        out = stage[name](spark, seen, SF).cache()
        assert out.columns == list(corpus_pipeline.COLUMNS) and [f.dataType for f in out.schema] == [docs.schema[c].dataType for c in out.columns]
        if name in ("language_id", "quality"):
            assert out.exceptAll(seen.select(*out.columns)).count() == 0 and out.count() >= 0.5 * seen.count()
        if name == "near_duplicates":
            rows = [(r.doc_id, set(simhash.shingle_hashes(r.text, 5).tolist())) for r in seen.collect()]
            root = {i: i for i, _ in rows}
            for i, a in rows:
                for j, b in rows:
                    if j < i and ((not a and not b) or (a | b and len(a & b) / len(a | b) >= 0.8)) and root[i] != root[j]:
                        low, high = min(root[i], root[j]), max(root[i], root[j])
                        root = {k: low if v == high else v for k, v in root.items()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, r in root.items() if i == r)
        if name == "mix":
            sizes, taken = {}, {}
            for r in seen.collect():
                sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
            for r in out.collect():
                taken[r.source] = taken.get(r.source, 0) + words(r.text)
            longest = max(words(r.text) for r in seen.collect())
            assert all(abs(taken.get(s, 0) - t) <= longest for s, t in brute_targets(sizes).items())
        seen = out
    packed = stage["pack"](spark, seen, SF).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(r.text)) for r in seen.collect())


def test_pipeline_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, size int, component string"
    rows = [(1, "the cat sat on the mat and looked at the moon tonight", "en", "a", 1, 1, 1, "x"), (1, "the cat sat on the mat and looked at the moon tonight", "en", "a", 1, 1, 1, "x"), (None, None, None, None, None, None, None, None), (2, "", "en", None, 0, 0, 0, ""), (None, "other words are here and there for all of us", "en", "b", 1, 1, 1, "y"), (3, "z " * 50_000, "en", "b", 1, 1, 1, "y")]
    odd = spark.createDataFrame(rows, schema)
    for table, n in ((odd, len(rows)), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF).collect()
            assert name in ("mix", "pack") or len(out) <= n
            if name == "near_duplicates":
                # one of the two equal rows and one of the two texts without words
                assert len(out) == max(0, n - 2)
            if n == 0:
                assert out == []
