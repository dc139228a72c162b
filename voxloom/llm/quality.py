"""Quality classifier (operator 5).

Logistic regression over hashed word n-grams, trained by follow-the-regularised-leader
with elastic-net penalties, scored as a sparse dot product. Words are runs of letters,
single digits and single marks. Two views of the same word sequence are hashed: the
words themselves (1- and 2-grams) and their shapes (1- to 3-grams; a shape is the case
pattern and length class of a letter run, the mark itself, or a repeat of the word
before), so that layout and noise carry over to words never seen. The value of an n-gram
is the square root of its share among the n-grams of its kind, which makes texts of any
length comparable.

The weights are fitted on a sample of at most FIT_ROWS labelled documents outside the
held-out fold (crc32 of the id's text mod 5 = 0), all of the rarer label first, with rows
weighted back to the labels' true shares, so that scores are probabilities. Labels are
held against the documents before any count or pick, so a label without a document
(labels may cover much more than the documents given) weighs nothing.

Edge cases: null and empty texts score by the bias alone; without labels of both kinds
among the documents every score is the share of label 1 (1 without labels); a document
labelled twice counts by its mean label, a tie as 1; null labels are skipped; of rows that
repeat an id the least text is learned from; repeated rows score alike; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, fold, materialise
from voxloom.llm.ftrl import FTRL

WIDTH = 1 << 18
FIT_ROWS = 2500
EPOCHS = 5
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+|\d|[^\w\s]|_")
#: Words kept in a worker's hash cache.
CACHE = 100_000



def _shape(word: str) -> str:
    if not word[0].isalpha():
        return "0" if word[0].isdigit() else word
    case = "a" if word.islower() else "A" if word.isupper() else "Aa" if word[1:].islower() or len(word) == 1 else "aA"
    return case + str(min(4, len(word).bit_length()))


class _Hashes(dict):
    """word -> its hash (low half) and its shape's (high half)."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) | zlib.crc32(_shape(word).encode("utf-8", "surrogatepass"), 7) << 32
        self[word] = found
        return found


_cache = _Hashes()
REPEAT = np.uint32(zlib.crc32(b"again", 7))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint32(salt)) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (x ^ (x >> np.uint32(16))) & np.uint32(WIDTH - 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the text's hashed n-grams."""
    words = TOKEN.findall(text or "")
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    if len(_cache) > CACHE:
        _cache.clear()
    both = np.fromiter(map(_cache.__getitem__, words), dtype=np.uint64, count=len(words))
    w, s = both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
    s[1:] = np.where(w[1:] == w[:-1], REPEAT, s[1:])
    p = np.uint32(0x9E3779B1)
    kinds = [_mix(w, 1), _mix(s, 3)]
    if len(w) > 1:
        s2 = s[:-1] * p + s[1:]
        kinds += [_mix(w[:-1] * p + w[1:], 2), _mix(s2, 4)]
        if len(w) > 2:
            kinds.append(_mix(s2[:-1] * p + s[2:], 5))
    at, v = [], []
    for k in kinds:
        u, n = np.unique(k, return_counts=True)
        at.append(u)
        v.append(np.sqrt(n / len(k)))
    return np.concatenate(at).astype(np.int64), np.concatenate(v)


def merged(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same vector with each place once: n-grams of two kinds may share one, and an update must see their sum."""
    u, back = np.unique(at, return_inverse=True)
    return u, np.bincount(back, v, minlength=len(u))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, v = features(text)
        x = float((self.weights[at] * v).sum()) + self.bias
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def train_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from labelled rows outside the held-out fold; ``labels``: (doc_id, quality)."""
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    usable = materialise(usable.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 1.0
        return QualityModel(np.zeros(WIDTH), 35.0 if share == 1 else -35.0)
    rare = min(counts, key=lambda y: (counts[y], y))
    take = {rare: min(counts[rare], fit_rows // 2)}
    take[1 - rare] = min(counts[1 - rare], fit_rows - take[rare])
    key = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    picked = None
    for y, n in take.items():  # an ordered limit keeps at most n short rows
        part = usable.where(F.col("y") == y).select("doc_id", "y", key.alias("_key")).orderBy("_key", "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)

    def vectors(frames):
        for frame in frames:
            made = [merged(*features(t)) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "_key": frame["_key"], "y": frame["y"], "at": [a.astype(np.int32) for a, _ in made], "v": [v.astype(np.float32) for _, v in made]})

    # fit_rows rows at most on the small side
    texts = bounded(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_key", "y").agg(F.min("text").alias("text"))
    rows = texts.mapInPandas(vectors, "doc_id long, _key long, y int, at array<int>, v array<float>")
    found = rows.orderBy("_key", "doc_id").limit(fit_rows).toPandas()
    x = list(zip(found["at"], found["v"], strict=True))  # 32-bit arrays: 8 bytes an n-gram
    y = found["y"].tolist()
    del found
    have = {k: max(1, y.count(k)) for k in (0, 1)}
    weight = {k: (counts[k] / total) / (have[k] / max(1, len(y))) for k in (0, 1)}
    fit = FTRL(WIDTH, 2, alpha=0.3, l1=2e-3, l2=1e-3).fit(x, y, EPOCHS, [weight[k] for k in y])
    w, b = fit.weights()
    return QualityModel(w[:, 0], float(b[0]))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of ``docs`` and _quality, in one map-only pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype="float64")

    return bounded(docs).withColumn("_quality", score(F.col("text")))


def op5_word_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text of ``documents``, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, model)
    return found.select(F.col("doc_id"), (fold("doc_id") == 0).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"))
