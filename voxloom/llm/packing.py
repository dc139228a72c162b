"""Packing token runs into fixed sequences by cutting-stock column generation (operator 8).

Documents longer than a sequence are cut into full sequences and a rest. Lengths are
counted in units of UNIT tokens (rounded up), so a histogram of at most capacity / UNIT
classes describes the whole corpus. On the driver a linear program over packing patterns
is solved by column generation: the restricted master by revised simplex, new columns by
an unbounded knapsack dynamic program over the classes with the master's prices. Pattern
counts are rounded down, what is left over is packed first-fit decreasing, and the n-th
piece of a class (pieces ranked by id) takes the n-th place that the patterns hold for
it. Only the histogram and the pattern table, both bounded by the number of classes,
meet the driver; ranks are taken within (class, salt), with as many salts as keep a part
near PART_ROWS, so no class is one task's. A full piece is a sequence by itself and is
numbered by its row number, without any ranking or shuffle.

Padding: a sequence is padded to the capacity unless its length is a power of two, so
the last underfull sequences are left whole.

Edge cases: a null or empty text is one end token; repeated rows and ids are separate
documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, materialise
from voxloom.llm.tokens import encode_all, read_spec, worker_tokenizer

CAPACITY = 4096
UNIT = 8
END_ID = 2
#: Column generation ends when the bound of the prices is this close to the master's value.
GAP = 2e-4
#: Columns after which the plan is taken as it is, with a warning that states the gap.
MAX_COLUMNS = 6000
#: Pieces of one class that are ranked in one part, about.
PART_ROWS = 200_000

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: tokenize, append the end id, cut at multiples of the capacity."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def cut(frames):
        for frame in frames:
            tok = worker_tokenizer(spec.value)
            end = tok.pack([end_id])
            rows: list[tuple] = []
            for doc_id, raw in zip(frame["doc_id"], encode_all(spec.value, frame["text"], end), strict=True):
                ids = np.frombuffer(raw, dtype=tok.dtype).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Most valuable multiset of items within the capacity; items repeat freely. (value, {item: times})"""
    good = prices > 1e-12
    items, s, p = np.flatnonzero(good), sizes[good], prices[good]
    if not len(items):
        return 0.0, {}
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(s, kind="stable")
    items, s, p = items[order], s[order], p[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = upto[c]
        best[c] = best[c - 1]
        if n:
            v = best[c - s[:n]] + p[:n]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], took[c] = v[k], k
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        k = took[c]
        found[int(items[k])] = found.get(int(items[k]), 0) + 1
        c -= int(s[k])
    return float(best[capacity]), found


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting; elementwise steps only, so no thread pool is started on the driver."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        at = k + int(np.abs(work[k:, k]).argmax())
        work[[k, at]] = work[[at, k]]
        work[k] /= work[k, k]
        rows = np.flatnonzero(work[:, k])
        rows = rows[rows != k]
        work[rows] -= work[rows, k][:, None] * work[k]
    return work[:, n:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[dict[int, int]], np.ndarray]:
    """Basic patterns and their (fractional) counts that meet the demand with few bins."""
    m = len(sizes)
    patterns = [{i: int(capacity // sizes[i])} for i in range(m)]
    basis = np.diag([float(next(iter(p.values()))) for p in patterns])
    inverse = np.diag(1 / basis.diagonal())
    x = basis.diagonal() ** -1.0 * demand
    filled = float(sizes @ demand) / capacity
    step = -1
    while True:
        step += 1
        if step == MAX_COLUMNS:
            warnings.warn(f"column generation stopped after {MAX_COLUMNS} columns: {x.sum():.1f} sequences, no fewer than {max(filled, x.sum() / value):.1f} are needed", stacklevel=2)
            break
        prices = inverse.sum(axis=0)
        value, pattern = knapsack(sizes, prices, capacity)
        # no packing needs fewer bins than the words fill, nor fewer than the scaled prices allow
        if x.sum() <= (1 + gap) * max(filled, x.sum() / value):
            break
        column = np.zeros(m)
        for i, n in pattern.items():
            column[i] = n
        held = list(pattern)
        direction = (inverse[:, held] * column[held]).sum(axis=1)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / direction[up]
        out = int(ratio.argmin())
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        patterns[out] = pattern
        if step % 256 == 255:
            inverse = inverted(basis)
            x = (inverse * demand).sum(axis=1)
    return patterns, np.maximum(x, 0)


def first_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """First-fit decreasing for what rounding left; equal bins are one entry."""
    left = counts.copy()
    order = np.argsort(-sizes, kind="stable")
    out: list[tuple[dict[int, int], int]] = []
    while left.any():
        room, pattern = capacity, {}
        for i in order:
            n = int(min(left[i], room // sizes[i]))
            if n:
                pattern[int(i)] = n
                room -= n * int(sizes[i])
        times = int(min(left[i] // n for i, n in pattern.items()))
        for i, n in pattern.items():
            left[i] -= n * times
        out.append((pattern, times))
    return out


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern by class, times)] that hold every piece; ``counts``: pieces by class."""
    classes = np.array(sorted(counts))
    if not len(classes):
        return []
    demand = np.array([counts[c] for c in classes], dtype=np.int64)
    patterns, x = column_generation(classes, demand.astype(float), capacity)
    whole = np.floor(x + 1e-7).astype(np.int64)
    left = demand.copy()
    plan = []
    for pattern, times in zip(patterns, whole, strict=True):
        times = int(min([times, *(left[i] // n for i, n in pattern.items())]))
        if times > 0:
            plan.append((pattern, times))
            for i, n in pattern.items():
                left[i] -= n * times
    plan += first_fit(classes, left, capacity)
    return [({int(classes[i]): n for i, n in pattern.items()}, times) for pattern, times in plan]


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """class -> rows (first rank, pieces a bin, first sequence, first slot), by first rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for c, n in sorted(pattern.items(), reverse=True):
            out.setdefault(c, []).append((ranks.get(c, 0), n, sequence, slot))
            ranks[c] = ranks.get(c, 0) + n * times
            slot += n
        sequence += times
    return {c: np.array(rows, dtype=np.int64) for c, rows in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (doc_id, start, length, ..., and _piece, a number of its own)."""
    spark = cut.sparkSession
    full = cut.where(F.col("length") == capacity)
    sized = cut.where(F.col("length") < capacity).withColumn("_class", F.ceil(F.col("length") / F.lit(unit)).cast("int"))
    # at most capacity / unit rows
    counts = {r["_class"]: r["n"] for r in sized.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(1, -(-max(counts.values(), default=0) // PART_ROWS))
    sized = sized.withColumn("_salt", F.pmod(F.xxhash64("_piece"), F.lit(salts)).cast("int"))
    # at most capacity / unit rows a salt: one row for PART_ROWS pieces
    parts = materialise(sized.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("_n")), "pack-classes")
    plan = plan_patterns(counts, capacity // unit)
    planned = sum(times for _, times in plan)
    where = spark.sparkContext.broadcast(places(plan))
    before = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_class", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32", "_piece"))
    ranked = sized.withColumn("_rank", rank).join(base, ["_class", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).drop("_base", "_salt")
    names = [f for f in ranked.columns if f not in ("_class", "_rank", "_piece")]
    schema = ", ".join([f"`{f}` {ranked.schema[f].dataType.simpleString()}" for f in names] + ["sequence_id long", "_slot long"])

    def locate(frames):
        table = where.value
        for frame in frames:
            sequence, slot = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            kinds, ranks = frame["_class"].to_numpy(), frame["_rank"].to_numpy()
            for c in np.unique(kinds):
                rows, on = table[int(c)], kinds == c
                k = np.searchsorted(rows[:, 0], ranks[on], side="right") - 1
                inside = ranks[on] - rows[k, 0]
                sequence[on] = rows[k, 2] + inside // rows[k, 1]
                slot[on] = rows[k, 3] + inside % rows[k, 1]
            out = frame[names].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(sequence_id=sequence, _slot=slot)

    placed = ranked.mapInPandas(locate, schema)
    prior = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.withColumn("offset", F.coalesce(F.sum("length").over(prior), F.lit(0)).cast("long")).drop("_slot")
    alone = full.select(*names, (F.col("_piece") + planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece; sequence numbers may have gaps."""
    return pack(materialise(pieces(docs, tokenizer_path, capacity).withColumn("_piece", F.monotonically_increasing_id()), "pieces"), capacity, unit)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_column_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` cut and packed into sequences of at most 4096 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = pack_documents(docs, default_tokenizer())
    return found.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
