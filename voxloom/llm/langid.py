"""Language identification (operator 1).

Sparse multinomial logistic regression on TF-IDF of character 1- to 3-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by one
temperature. Document frequencies cover every training document; the weights are fitted
on a sample of at most FIT_ROWS documents, spread evenly over the languages (each gets
the same quota; what a rare one can't fill is shared by the others), and the
temperature on another of at most CALIBRATION_ROWS. Only rows outside the held-out fold
(crc32 of the id's text mod 5 = 0) with a language are learned from.

Scoring runs map-only: the text's n-grams are hashed by array arithmetic, counted into a
vector of fixed width and multiplied with the non-zero weights.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any
training row every text is ``und``; very long texts are counted in blocks, with the same
counts as in one piece; repeated rows and ids are predicted alike; extra columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, fold
from voxloom.llm.ftrl import FTRL, temperature

WIDTH = 1 << 15
FIT_ROWS = 1600
CALIBRATION_ROWS = 400
EPOCHS = 4
BLOCK = 1 << 18
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def gram_indices(codes: np.ndarray, own: int) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams that begin in the first ``own`` of these code points."""
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (codes[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (codes[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    every = np.concatenate([one[:own], two[:own], three[:own]])
    return (every ^ (every >> np.uint32(15))) & np.uint32(WIDTH - 1)


def gram_counts(text: str) -> np.ndarray:
    """Counts by hashed n-gram of the lower-cased text with a blank at either end, block by block."""
    whole = f" {text.lower()} "
    counts = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(whole), BLOCK):
        part = np.frombuffer(whole[at : at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        counts += np.bincount(gram_indices(part, BLOCK), minlength=WIDTH)
    return counts


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero places and values of the unit-length TF-IDF vector."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, v / norm if norm else v


def has_letter(text: str | None) -> bool:
    # the class also holds numbers such as a half or a Roman numeral
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


@dataclass
class LanguageModel:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        at, v = vector(text, self.idf)
        return (self.weights[at] * v[:, None]).sum(axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        s = self.scores(text)
        if self.weights.shape[1] == 1:  # two classes: one margin
            s = np.array([0.0, s[0]])
        s = s / self.temperature
        e = np.exp(s - s.max())
        k = int(e.argmax())
        return self.classes[k], float(e[k] / e.sum())


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """(documents holding each hashed n-gram, documents), over all of ``train``."""

    def count(frames):
        df, n = np.zeros(WIDTH, dtype=np.int64), 0
        for frame in frames:
            for t in frame["text"]:
                if has_letter(t):
                    n += 1
                    df[gram_counts(t) > 0] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.r_[at, -1], "n": np.r_[df[at], n]})

    found = train.select("text").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # WIDTH rows at most
    df, n = np.zeros(WIDTH, dtype=np.int64), 0
    for r in found:
        if r["at"] < 0:
            n = r["n"]
        else:
            df[r["at"]] = r["n"]
    return df, n


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of each language: as even as the languages' own counts allow, ``rows`` in all at most (one each at least)."""
    left, take = rows, {}
    order = sorted(counts, key=lambda k: (counts[k], k))
    for i, lang in enumerate(order):
        take[lang] = min(counts[lang], max(1, left // (len(order) - i)))
        left = max(0, left - take[lang])
    return take


def _sample(train: DataFrame, counts: dict[str, int], rows: int) -> DataFrame:
    """Each language's quota of texts, the first by a hash of id and text.

    A hash threshold of about twice the quota comes first, so that the rank within a
    language sorts a bounded number of rows however many it has; the rows of least hash stay in any case, so
    that a language of one repeated row is not lost. A partition passes on no more than the largest quota.
    """
    take = quotas(counts, rows)
    key = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30))
    keyed = train.withColumn("_key", key)
    least = {r["lang"]: r["k"] for r in keyed.groupBy("lang").agg(F.min("_key").alias("k")).collect()}  # one row a language
    limit, quota = F.lit(0.0), F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(max(min(1.0, (2.0 * take[lang] + 64) / n) * (1 << 30), least[lang] + 1.0))).otherwise(limit)
        quota = F.when(F.col("lang") == lang, F.lit(take[lang])).otherwise(quota)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "doc_id"))
    near = keyed.where(F.col("_key") < limit).withColumn("_n", rank).where(F.col("_n") <= max(take.values(), default=0))
    return near.where(F.col("_n") <= quota).drop("_n")


def train_model(docs: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel:
    """Learn from the rows of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    train = bounded(docs).where(F.col("lang").isNotNull() & (fold("doc_id") != 0)).select("doc_id", "text", "lang")
    by = {(r["lang"], r["c"]): r["n"] for r in train.groupBy("lang", (fold("doc_id") == 1).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a language
    counts = {lang: by.get((lang, False), 0) + by.get((lang, True), 0) for lang, _ in by}
    classes = sorted(counts)
    if not classes:
        return LanguageModel([], np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), 1.0)
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    spread = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(frames):
        for frame in frames:
            keep = frame[[has_letter(t) for t in frame["text"]]]
            made = [vector(t, spread.value) for t in keep["text"]]
            yield pd.DataFrame({"_key": keep["_key"], "doc_id": keep["doc_id"].astype("Int64"), "lang": keep["lang"], "at": [a.astype(np.int32) for a, _ in made], "v": [v.astype(np.float32) for _, v in made]})

    def fetch(rows: DataFrame, limit: int):
        found = rows.mapInPandas(vectors, "_key long, doc_id long, lang string, at array<int>, v array<float>").orderBy("_key", "doc_id", "lang").limit(limit).toPandas()
        return [(np.asarray(a), np.asarray(v, dtype=float)) for a, v in zip(found["at"], found["v"], strict=True)], [classes.index(x) for x in found["lang"]]

    calibrating = fold("doc_id") == 1
    fit_x, fit_y = fetch(_sample(train.where(~calibrating), {k: n for (k, c), n in by.items() if not c}, fit_rows), max(fit_rows, len(classes)))
    cal_x, cal_y = fetch(_sample(train.where(calibrating), {k: n for (k, c), n in by.items() if c}, calibration_rows), max(calibration_rows, len(classes)))
    if len(classes) == 1:
        return LanguageModel(classes, idf, np.zeros((WIDTH, 1)), np.zeros(1), 1.0)
    fit = FTRL(WIDTH, len(classes), alpha=1.0, l1=2e-3, l2=1e-3).fit(fit_x, fit_y, EPOCHS)
    w, b = fit.weights()
    model = LanguageModel(classes, idf, w, b, 1.0)
    raw = np.array([(w[a] * v[:, None]).sum(axis=0) + b for a, v in cal_x]).reshape(-1, w.shape[1])
    if w.shape[1] == 1:
        raw = np.hstack([np.zeros_like(raw), raw])
    model.temperature = temperature(raw, np.array(cal_y, dtype=int))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and _lang, a struct of lang_pred and score, in one map-only pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(text: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t) for t in text]
        return pd.DataFrame({"lang_pred": [p for p, _ in found], "score": [s for _, s in found]})

    return bounded(docs).withColumn("_lang", scored(F.col("text")))


def op1_char_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and calibrated probability of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train_model(docs))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "_lang.lang_pred", "_lang.score")
