"""Benchmark decontamination by winnowing (operator 13).

Texts become words, words become 64-bit hashes, and every run of ten words keeps the least hash of
its five 6-grams as its fingerprint. Two texts that share ten words share that fingerprint, so a
join of training and test fingerprints misses no shared span of ten words or more. A hit is extended to
the whole window by its words (the join's second key), so nothing rests on hashes, and
runs of hit windows grow together to spans. Items of fewer than ten words are one window of their own
length, looked up among the runs of that length.

Only windows whose fingerprint is set in a bit filter of the benchmark's fingerprints leave the
scan. The filter has sixteen bits a fingerprint, up to MAX_BITS (16 MB); past that it lets more
windows through and the join drops them.

A word that a third of all documents share, or a window that many items share, makes no pairs: equal
windows of the benchmark are one row with the digest of their item list, the side of the documents is
salted by row, and item lists are put together once for each distinct set of digests.

Edge cases: a null or empty text, or one without words, has no words and no hits; an item without words is no
window; a null item_id reads as ''; items of one id are one item; null and repeated ids are
rows of their own; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, materialise

#: Words of a window, and of the k-grams whose least hash is its fingerprint.
WINDOW, GRAM = 10, 6
#: Largest bit filter sent to the workers: 16 MB.
MAX_BITS = 1 << 27
#: Bytes of text hashed at once, and parts of the documents that meet one window of the benchmark.
RUN_BYTES, SALTS = 1 << 20, 8

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
_BASE, _MULT = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)

WINDOWS = "array<struct<pos: int, len: int, fp: long, window: string>>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MULT
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo two to the 64."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word crosses a cut."""
    w = _IS_WORD[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] |= w[inner]
    last[inner - 1] |= w[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, taken from prefix sums over runs of whole words."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(ends, starts[at] + RUN_BYTES, side="right")))
        base, n = int(starts[at]), int(ends[until - 1] - starts[at])
        up, down = _powers(max(RUN_BYTES, n) + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        a, b = starts[at:until] - base, ends[at:until] - base
        out[at:until] = _mixed((sums[b] - sums[a]) * down[a])
        at = until
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    count = len(words) - n + 1
    if count < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(count, n, dtype=np.uint64)
    for j in range(n):
        h = h * _MULT + words[j : j + count]
    return _mixed(h)


def window_prints(words: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of every run of ``n`` words: the least hash of its k-grams, or for a shorter run its own."""
    if n < WINDOW:
        return gram_hashes(words, n)
    grams = gram_hashes(words, GRAM)
    count = len(words) - WINDOW + 1
    if count < 1:
        return grams[:0]
    return functools.reduce(np.minimum, (grams[j : j + count] for j in range(WINDOW - GRAM + 1)))


def _texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch and the place where each begins (one more than texts)."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _windows(raw: np.ndarray, cuts: np.ndarray, lengths: list[int], keep):
    """(words of each text, text, place, length, fingerprint, words) of the runs of ``lengths`` words that ``keep`` picks."""
    starts, ends = word_spans(raw, cuts)
    text = np.searchsorted(cuts, starts, side="right") - 1
    count = np.bincount(text, minlength=len(cuts) - 1)
    first = np.cumsum(count) - count
    low = _LOW[raw]
    hashes = word_hashes(low, starts, ends)
    found = []
    for n in lengths:
        prints = window_prints(hashes, n)
        within = text[: len(prints)] == text[n - 1 :] if len(prints) else np.zeros(0, bool)
        for i in np.flatnonzero(within & keep(prints, n, text[: len(prints)], count)).tolist():
            words = b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist()))
            found.append((int(text[i]), int(i - first[text[i]]), n, int(prints[i].view(np.int64)), words.decode()))
    return count, sorted(found)


def _column(found: list[tuple], texts: int) -> pa.Array:
    """Windows as one list a text."""
    n = np.bincount(np.array([f[0] for f in found], dtype=np.int64), minlength=texts) if texts else np.zeros(0, np.int64)
    types = (pa.int32(), pa.int32(), pa.int64(), pa.string())
    names = ["pos", "len", "fp", "window"]
    values = pa.StructArray.from_arrays([pa.array([f[k + 1] for f in found], t) for k, t in enumerate(types)], names)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), values)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, len, fp, window) of every window of every item."""
    lengths = list(range(1, WINDOW + 1))

    def kernel(batches):
        for batch in batches:
            raw, cuts = _texts(batch, "text")
            # an item of fewer words than a window is one window of all its words
            _, found = _windows(raw, cuts, lengths, lambda prints, n, text, count: count[text] == n if n < WINDOW else np.ones(len(prints), bool))
            yield pa.RecordBatch.from_arrays([batch.column("item").cast(pa.string()), _column(found, batch.num_rows)], ["item", "windows"])

    items = bounded(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")))
    return items.mapInArrow(kernel, f"item string, windows {WINDOWS}").select("item", F.explode("windows").alias("w")).select("item", "w.len", "w.fp", "w.window")


def bit_filter(windows: DataFrame) -> np.ndarray:
    """Bits of all fingerprints as 64-bit words: at most MAX_BITS bits reach the driver, whatever the benchmark's size."""
    bits = 1 << 16
    n = windows.count()
    while bits < 16 * n and bits < MAX_BITS:
        bits *= 2
    place = F.col("fp").bitwiseAND(F.lit(bits - 1))
    words = windows.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(fp & 63 AS INT))")).alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def document_windows(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """(_row, doc_id, n_words, windows): the windows of each document whose fingerprint is in the filter."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bits)

    def kernel(batches):
        table = sent.value
        mask = np.uint64(len(table) * 64 - 1)

        def known(prints, n, text, count):
            place = prints & mask
            return ((table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)

        for batch in batches:
            raw, cuts = _texts(batch, "text")
            count, found = _windows(raw, cuts, lengths, known)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(count.astype(np.int64)), _column(found, batch.num_rows)], ["_row", "doc_id", "n_words", "windows"])

    rows = bounded(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(kernel, f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, windows {WINDOWS}")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items): hit spans as word places, end excluded, and the items, sorted as strings, of every document."""
    items = materialise(item_windows(benchmark), "item-windows")
    lists = items.groupBy("len", "fp", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = materialise(lists.withColumn("list", F.sha2(F.to_json("items"), 256)), "benchmark-windows")
    lengths = [r["len"] for r in known.select("len").distinct().collect()]  # ten at most
    found = materialise(document_windows(docs, bit_filter(known), sorted(lengths)), "document-windows")

    runs = found.select("_row", F.explode("windows").alias("w")).select("_row", "w.pos", "w.fp", "w.window", F.pmod(F.xxhash64("_row", "w.pos"), F.lit(SALTS)).alias("salt"))
    salted = known.select("len", "fp", "window", "list", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    met = materialise(runs.join(salted, ["fp", "window", "salt"]).select("_row", "pos", (F.col("pos") + F.col("len")).alias("stop"), "list"), "met")

    # overlapping and touching windows of a document are one span
    order = Window.partitionBy("_row").orderBy("pos", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = met.select("_row", "pos", "stop").distinct().withColumn("new", F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int"))
    spans = begun.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_row", "span").agg(F.min("pos").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    # item lists are joined once for each distinct set of windows, not once a document
    sets = materialise(met.groupBy("_row").agg(F.array_sort(F.collect_set("list")).alias("lists")).withColumn("key", F.sha2(F.array_join("lists", ","), 256)), "sets")
    distinct = sets.groupBy("key").agg(F.first("lists").alias("lists")).select("key", F.explode("lists").alias("list"))
    named = distinct.join(known.groupBy("list").agg(F.first("items").alias("items")), "list").select("key", F.explode("items").alias("item"))
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marked = sets.select("_row", "key").join(named, "key").select("_row", "items").join(spans, "_row")
    kept = found.select("_row", "doc_id", "n_words").join(marked, "_row", "left")
    return kept.select(
        "doc_id", "n_words", F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: int, stop: int>>)")).alias("spans"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items")
    )


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents against the whole benchmark."""
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), {WINDOW}) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i : i + l - 1], ' ') AS win FROM bl, unnest(generate_series(1, len(w) - l + 1)) AS s(i)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, l, i, array_to_string(w[i : i + l - 1], ' ') AS win FROM d, lens, unnest(generate_series(1, len(w) - l + 1)) AS s(i) WHERE len(w) >= l),
m AS (SELECT r, i, l, item FROM dw JOIN bw USING (l, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, l FROM m), unnest(generate_series(i, i + l - 1)) AS s(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN its USING (r)
"""
