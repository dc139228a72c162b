"""Repeated rows and ids in sampling and sharding; vectors of any length in the search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import graph_ann, langid, sharding


def lengths(kind, rng, n):
    v = rng.normal(size=(n, 64))
    if kind == "clusters":
        v = rng.normal(size=(25, 64))[rng.integers(0, 25, n)] + 0.35 * v
    v /= np.linalg.norm(v, axis=1)[:, None]
    if isinstance(kind, float):
        return v * np.exp(rng.normal(0, kind, n))[:, None]
    if kind == "scales":
        return v * 10.0 ** rng.integers(-3, 4, n)[:, None]
    return v


@pytest.mark.parametrize("kind", [0.0, 0.3, 0.7, "clusters", "scales"])
def test_recall_at_any_length(spark, kind):
    v = lengths(kind, np.random.default_rng(12), 4000).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in graph_ann.nearest(df, F.col("vec_id") % 50 == 0, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 4000, 50):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(4000), -s))[:20].tolist()))
    assert hit / (80 * 20) >= 0.9, hit / (80 * 20)


def test_copies_of_a_record_spread_over_shards(spark):
    rows = [(7, "x" * 100)] * 2000 + [(i, "y" * 50) for i in range(100, 2100)] + [(None, None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size = np.zeros(16)
    found = sharding.shard_documents(df, 16).collect()
    for r in found:
        size[r.shard] += r.size
    assert len(found) == len(rows) and size.max() - size.min() <= 101
    for s in range(16):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    # copies are numbered alike however the table is cut up, and copy 0 has the record's own slot
    slots = lambda d: sorted((r.doc_id or -1, r.virtual_slot) for r in sharding.sized(d).collect())
    assert slots(df) == slots(df.repartition(2)) and len({v for d, v in slots(df) if d == 7}) > 1000
    own = spark.createDataFrame([(7, "x" * 100)], "doc_id long, text string").select(sharding.shard_of(F.col("doc_id"), F.crc32(F.col("text").cast("binary")))).first()[0]
    assert (7, own) in slots(df)


GERMAN = ["der Hund läuft über die Straße und bellt laut", "wir haben gestern einen schönen Abend verbracht", "die Kinder spielen im Garten mit dem Ball"]
ENGLISH = ["the dog runs across the street and barks", "we had a lovely evening yesterday with friends", "children are playing in the garden with a ball"]


@pytest.mark.parametrize("same_text", [False, True])
def test_a_language_of_one_repeated_id_is_learned(spark, same_text):
    trained = next(i for i in range(1, 99) if spark.range(1).select(langid.fold(F.lit(i))).first()[0] > 1)
    rows = [(trained, GERMAN[0 if same_text else k % 3] + ("" if same_text else f" {k % 50}"), "de") for k in range(3000)]
    rows += [(1000 + k, ENGLISH[k % 3] + f" {k}", "en") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_model(df)
    assert model.classes == ["de", "en"]
    assert model.predict(GERMAN[0])[0] == "de" and model.predict(ENGLISH[1])[0] == "en"


def test_numbers_are_no_letters():
    assert [langid.has_letter(t) for t in ("½ ² Ⅷ ٣ 12", "½a", "_ ー", "漢", "", None)] == [False, True, True, True, False, False]
    assert all(langid.has_letter(c) == c.isalpha() for c in map(chr, range(0x3000)))
