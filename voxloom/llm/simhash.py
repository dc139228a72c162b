"""SimHash near-duplicates by exact tiled comparison (operator 9).

Every document gets a fingerprint of one or more 64-bit words from its word shingles;
fingerprints within a radius of differing bits link, and a document's class is its
connected component. Distinct fingerprints are sorted by population count and cut into
tiles; each pair of tiles is compared whole with numpy exclusive-or and bit counts,
unless their population counts lie further apart than the radius, when no pair can
link. A tile first finds its own classes; a pair of tiles then returns a forest of links
between classes, never all links, so a large group of near copies costs about as many rows
as it has members. Components of the forests
come from distributed label propagation over stars with stored rounds.

The comparison is exact and so grows with the square of the distinct fingerprints; the
fingerprinting, which grows with the text, is the larger part until some 10^6 texts.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other;
texts of fewer words than a shingle form one shingle; equal texts share a fingerprint
and so a class; a null id never names a class, and a class of null ids alone has the null
component_id; repeated ids and rows are kept, each with its own text's class; an empty
table gives no rows; extra columns are ignored. Links run between fingerprints, never
between ids, so rows that share an id or have none are not joined by that.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, materialise

WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Fingerprints in a tile: two tiles and a block of comparisons fit in a few MB.
TILE = 16384
#: Rows of one tile held against all of another at once.
BLOCK = 128
#: Most tasks that the pairs of tiles are dealt to.
MAX_TASKS = 20_000
#: Shingle sets in a tile that is verified, and bytes of them.
SET_TILE, SET_BYTES = 2048, 16 << 20
#: Other tiles up to which a tile of sets is sent to each of them.
MEET = 8
TILES = "tile long, low int, high int, fps binary, ids binary, roots binary"


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the text with A-Z in lower case."""
    words = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i : len(words) - k + 1 + i] for i in range(k)), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64-bit hash from h; word 0 is h itself."""
    if word == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, k: int = 3, words: int = 1) -> np.ndarray:
    """``words`` 64-bit numbers; a bit is set if it is in over half of the shingles' hashes."""
    return of_hashes(shingle_hashes(text, k), words)


def of_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of shingle hashes."""
    out = np.zeros(words, dtype=np.uint64)
    for w in range(words if len(h) else 0):
        counts = np.zeros(64, dtype=np.int64)
        mixed = _mixed(h, w)
        for at in range(0, len(h), 1 << 16):
            bits = np.unpackbits(mixed[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp): fp is the words as bytes, most significant first."""

    def run(frames):
        for frame in frames:
            fps = [fingerprint(t, k, words).astype(">u8").tobytes() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": fps})

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp binary")


def forest(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Joins label (a root per node) along the edges; returns the indices of edges that joined two trees."""
    kept = []
    live = np.arange(len(u))
    while len(live):
        a, b = label[u[live]], label[v[live]]
        differ = a != b
        live, a, b = live[differ], a[differ], b[differ]
        if not len(live):
            break
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        # each root hooks below a smaller one, once a round: no cycles
        label[high[first]] = low[first]
        kept.append(live[first])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)


def compare(a: np.ndarray, b: np.ndarray, radius: int, first_radius: int, same: bool, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forest of links between rows of a and of b (n x words).

    ``label`` (a root per row, first of a, then of b) tells what hangs together already;
    it is brought up to date, and only links that join two of its trees come back.
    """
    if label is None:
        label = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    left, right = [], []
    lead = np.ascontiguousarray(b[:, 0])
    for at in range(0, len(a), BLOCK):
        block = a[at : at + BLOCK]
        lo = at if same else 0
        near = np.bitwise_count(block[:, :1] ^ lead[None, lo:]) <= first_radius
        i, j = np.nonzero(near)
        j = j + lo
        if same:
            keep = j > i + at
            i, j = i[keep], j[keep]
        if a.shape[1] > 1 and len(i):
            total = np.bitwise_count(block[i] ^ b[j]).sum(axis=1, dtype=np.int64)
            i, j = i[total <= radius], j[total <= radius]
        if len(i):
            kept = forest(i + at, j + shift, label)
            left.append(i[kept] + at)
            right.append(j[kept])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def tiles(distinct: DataFrame, n_tiles: int, words: int, radius: int, first_radius: int) -> DataFrame:
    """(tile, low, high, fps, ids, roots) of distinct (fp, node), in order of population count.

    A tile is compared with itself at once; roots gives each row the place of its class's
    first row in the tile, so that pairs of tiles only have to link classes.
    """

    def run(frames):
        fps, ids, n = [], [], 0
        tile = None

        def out(fps, ids, tile, n):
            fp = np.frombuffer(b"".join(fps), dtype=">u8").astype("<u8").reshape(-1, words)
            pop = np.bitwise_count(fp).sum(axis=1)
            roots = np.arange(len(fp))
            compare(fp, fp, radius, first_radius, True, roots)
            return pd.DataFrame({"tile": [(tile << 20) + n], "low": [int(pop.min())], "high": [int(pop.max())], "fps": [fp.tobytes()], "ids": [np.array(ids, dtype="<i8").tobytes()], "roots": [roots.astype("<i4").tobytes()]})

        for frame in frames:
            for fp, node, part in zip(frame["fp"], frame["node"], frame["_part"], strict=True):
                tile = int(part)
                fps.append(fp)
                ids.append(node)
                if len(fps) == TILE:
                    yield out(fps, ids, tile, n)
                    fps, ids, n = [], [], n + 1
        if fps:
            yield out(fps, ids, tile, n)

    pop = F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0), lambda acc, i: acc + F.bit_count(F.conv(F.substring(F.hex("fp"), i * 16 + 1, 16), 16, -10).cast("long")))
    ordered = distinct.withColumn("_pop", pop).repartitionByRange(n_tiles, "_pop", "fp").sortWithinPartitions("_pop", "fp").withColumn("_part", F.spark_partition_id())
    return ordered.select("fp", "node", "_part").mapInPandas(run, TILES)


def links(distinct: DataFrame, radius: int, words: int, first_radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Forests (a, b) with the components of all links among distinct (fp, node): nodes and their roots within a tile, and roots across tiles."""
    first_radius = radius if first_radius is None else first_radius
    n = distinct.count()
    stored = materialise(tiles(distinct, max(1, -(-n // TILE)), words, radius, first_radius), "tiles")

    def within(frames):
        for frame in frames:
            for ids, roots in zip(frame["ids"], frame["roots"], strict=True):
                i, r = np.frombuffer(ids, dtype="<i8"), np.frombuffer(roots, dtype="<i4")
                child = np.flatnonzero(r != np.arange(len(r)))
                yield pd.DataFrame({"a": i[child], "b": i[r[child]]})

    def run(frames):
        for frame in frames:
            for fa, ia, ra, fb, ib, rb in frame.itertuples(index=False):
                (fa, fb), (ia, ib), (ra, rb) = ([np.frombuffer(x, dtype=kind) for x in side] for side, kind in (((fa, fb), "<u8"), ((ia, ib), "<i8"), ((ra, rb), "<i4")))
                i, j = compare(fa.reshape(-1, words), fb.reshape(-1, words), radius, first_radius, False, np.concatenate([ra, rb + len(ra)]).astype(np.int64))
                yield pd.DataFrame({"a": ia[ra[i]], "b": ib[rb[j]]})

    near = (F.col("a_low") - F.col("b_high") <= radius) & (F.col("b_low") - F.col("a_high") <= radius)
    across = bounded(tile_pairs(stored, near)).select(*(f"{side}_{c}" for side in "ab" for c in ("fps", "ids", "roots"))).mapInPandas(run, "a long, b long")
    return stored.select("ids", "roots").mapInPandas(within, "a long, b long"), across


def tile_pairs(stored: DataFrame, near: Column) -> DataFrame:
    """Every two different tiles that ``near`` lets meet, once, with their columns as a_.. and b_...

    The stored tiles are read again for every task and not shuffled: a shuffle would hold a copy of a tile
    for each other one, and so grow with the square of the tiles. Of two tiles either may be a, by
    the evenness of their numbers, so that tasks get about as many pairs each.
    """
    a, b = (stored.select(*(F.col(c).alias(f"{side}_{c}") for c in stored.columns)) for side in "ab")
    place = lambda c: F.shiftright(c, 20) + F.col(c).bitwiseAND((1 << 20) - 1)
    once = (F.col("a_tile") < F.col("b_tile")) == ((place("a_tile") + place("b_tile")) % 2 == 0)
    return a.join(b.hint("shuffle_replicate_nl"), (F.col("a_tile") != F.col("b_tile")) & once & near)


def _watched(edges: DataFrame, state: Observation) -> DataFrame:
    """``edges`` whose number and sum of hashes are taken while they are written."""
    return edges.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))


def spread_pairs(dealt: DataFrame, full: int) -> DataFrame:
    """Pairs of tiles over tasks of about one pair of full tiles each (``full``: tiles if all were full).

    The pairs are few and small, but each is much work, so they must not be coalesced by size.
    """
    return dealt.repartition(max(1, min(full * (full + 1) // 2, MAX_TASKS)), "a", "b")


def components(stars: DataFrame, across: DataFrame) -> DataFrame:
    """(node, component) of every node that is not its component's label.

    ``stars``: (a, b) of a node and its root within a tile; ``across``: (a, b) of two roots.
    Only roots take part in the rounds of alternating large and small stars; every round is
    stored, and the loop ends when a round changes nothing. Rounds grow with the logarithm
    of the longest path of roots.
    """
    state = Observation()
    both = materialise(_watched(across.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), state), "edges")
    was = state.get
    while was["n"]:
        around = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = Observation()
        both, now = materialise(_watched(nxt, state), "edges"), state.get
        if now == was:
            break
        was = now
    roots = both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = both.select(F.col("u").alias("b"), F.col("v").alias("top"))
    return roots.union(stars.join(root, "b", "left").select("a", F.coalesce("top", "b")))


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, words: int = 1, first_radius: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``; component_id is the least id of the class."""
    stored = materialise(fingerprints(docs, k, words), "fingerprints")
    # a node is a fingerprint; it is numbered where it is stored, once
    distinct = materialise(stored.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = components(*links(distinct, radius, words, first_radius))
    linked = distinct.join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = linked.groupBy("class").agg(F.min("least").alias("component_id"))
    return stored.join(linked.join(named, "class").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, k: int, words: int, keep: bool) -> DataFrame:
    """(doc_id, fp, digest, n, shingles): fingerprint, hash and size of the set of shingles; the set only on ``keep``."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                h = np.unique(shingle_hashes(text, k))
                rows.append((doc, b"" if keep else of_hashes(h, words).astype(">u8").tobytes(), xxhash.xxh128_digest(h.tobytes()), len(h), h.tobytes() if keep else None))
            yield pd.DataFrame(rows, columns=["doc_id", "fp", "digest", "n", "shingles"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp binary, digest binary, n long, shingles binary")


def similar(a: list[np.ndarray], b: list[np.ndarray], ca: np.ndarray, cb: np.ndarray, least: float, same: bool, label: np.ndarray) -> tuple[list[int], list[int]]:
    """Forest of pairs of sets with one candidate class (ca, cb ascending) and Jaccard of at least ``least``.

    ``label`` as in ``compare``; pairs that hang together already are not looked at again.
    """
    shift = 0 if same else len(a)
    size = np.array([len(x) for x in b], dtype=np.int64)
    # postings of b: each shingle's rows lie together
    flat, row = np.concatenate(b), np.repeat(np.arange(len(b)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    left, right = [], []
    low, high = np.searchsorted(cb, ca, side="left"), np.searchsorted(cb, ca, side="right")
    for i, x in enumerate(a):
        lo = max(int(low[i]), i + 1) if same else int(low[i])
        hi = int(high[i])
        if hi <= lo:
            continue
        near = (label[lo + shift : hi + shift] != label[i]) & (np.minimum(size[lo:hi], len(x)) >= least * np.maximum(size[lo:hi], len(x)))
        j = lo + np.flatnonzero(near)
        if not len(j):
            continue
        # x has each shingle once, so at most all of the postings are gathered
        first = np.searchsorted(flat, x, side="left")
        times = np.searchsorted(flat, x, side="right") - first
        at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        both = np.bincount(row[at], minlength=len(b))[j]
        for k in j[both / (len(x) + size[j] - both) >= least].tolist():
            one, two = label[i], label[k + shift]
            if one != two:
                label[label == max(one, two)] = min(one, two)
                left.append(i)
                right.append(k)
    return left, right


def similar_links(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Forests (a, b), as ``links`` gives them, with the components of all similar pairs of (doc_id, class, n, shingles) within a class.

    Sets lie in tiles in order of class, so that a tile meets only those that share a class
    with it. A tile is bounded in rows and in bytes (one longer set is a tile by itself).
    """
    size = sets.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    n_parts = max(1, -(-size["rows"] // SET_TILE), -(-8 * int(size["n"] or 0) // SET_BYTES))
    schema = "tile long, low long, high long, ids binary, classes binary, sizes binary, sets binary, roots binary"

    def cut(frames):
        rows, part, n, held = [], None, 0, 0

        def out():
            ids, classes = (np.array([r[i] for r in rows], dtype="<i8") for i in (0, 1))
            sets = [np.frombuffer(r[2], dtype="<u8") for r in rows]
            roots = np.arange(len(rows))
            similar(sets, sets, classes, classes, least, True, roots)
            return pd.DataFrame({"tile": [(part << 20) + n], "low": [int(classes[0])], "high": [int(classes[-1])], "ids": [ids.tobytes()], "classes": [classes.tobytes()], "sizes": [np.array([len(x) for x in sets], dtype="<i8").tobytes()], "sets": [b"".join(r[2] for r in rows)], "roots": [roots.astype("<i8").tobytes()]})

        for frame in frames:
            for doc, cls, shingles, at in zip(frame["doc_id"], frame["class"], frame["shingles"], frame["_part"], strict=True):
                part = int(at)
                rows.append((doc, cls, bytes(shingles)))
                held += len(shingles)
                if len(rows) >= SET_TILE or held >= SET_BYTES:
                    yield out()
                    rows, n, held = [], n + 1, 0
        if rows:
            yield out()

    ordered = sets.repartitionByRange(n_parts, "class", "doc_id").sortWithinPartitions("class", "doc_id").withColumn("_part", F.spark_partition_id())
    stored = materialise(ordered.select("doc_id", "class", "shingles", "_part").mapInPandas(cut, schema), "set-tiles")
    # one short row per tile
    meta = np.array([(r["tile"], r["low"], r["high"]) for r in stored.select("tile", "low", "high").collect()], dtype=np.int64).reshape(-1, 3)

    def within(frames):
        for frame in frames:
            for ids, roots in zip(frame["ids"], frame["roots"], strict=True):
                i, r = np.frombuffer(ids, dtype="<i8"), np.frombuffer(roots, dtype="<i8")
                child = np.flatnonzero(r != np.arange(len(r)))
                yield pd.DataFrame({"a": i[child], "b": i[r[child]]})

    columns = ["ids", "classes", "sizes", "sets", "roots"]
    # tiles of a class that fills many are met where they are stored, as copies for each other one would grow with their square
    first, last = np.sort(meta[:, 1]), np.sort(meta[:, 2])
    others = np.searchsorted(first, meta[:, 2], side="right") - np.searchsorted(last, meta[:, 1], side="left") - 1
    wide = meta[others > MEET, 0]

    def pairs(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                near = meta[(meta[:, 1] <= row.high) & (meta[:, 2] >= row.low) & (meta[:, 0] != row.tile), 0]
                near = near[~np.isin(near, wide)] if row.tile in wide else near
                for other in near.tolist():
                    yield pd.DataFrame([(min(other, row.tile), max(other, row.tile), row.tile, *(getattr(row, c) for c in columns))], columns=["a", "b", "tile", *columns])

    def linked(one, two):
        (sa, ca, ia, ra), (sb, cb, ib, rb) = one, two
        i, j = similar(sa, sb, ca, cb, least, False, np.concatenate([ra, rb + len(ra)]))
        return pd.DataFrame({"a": ia[ra[np.array(i, dtype=int)]], "b": ib[rb[np.array(j, dtype=int)]]})

    def unpacked(ids, classes, sizes, sets, roots):
        ids, classes, sizes, roots = (np.frombuffer(x, dtype="<i8") for x in (ids, classes, sizes, roots))
        return np.split(np.frombuffer(sets, dtype="<u8"), np.cumsum(sizes)[:-1]), classes, ids, roots

    def run(key, frame):
        by = {row.tile: unpacked(*(getattr(row, c) for c in columns)) for row in frame.itertuples(index=False)}
        return linked(by[key[0]], by[key[1]])

    def run_wide(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield linked(unpacked(*row[: len(columns)]), unpacked(*row[len(columns) :]))

    dealt = stored.mapInPandas(pairs, "a long, b long, tile long, ids binary, classes binary, sizes binary, sets binary, roots binary")
    across = spread_pairs(dealt, n_parts).groupBy("a", "b").applyInPandas(run, "a long, b long")
    if len(wide):
        many = stored.join(F.broadcast(stored.sparkSession.createDataFrame([(int(t),) for t in wide], "tile long")), "tile", "left_semi")
        both = tile_pairs(many, (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high")))
        across = across.unionByName(bounded(both).select(*(f"{side}_{c}" for side in "ab" for c in columns)).mapInPandas(run_wide, "a long, b long"))
    return stored.select("ids", "roots").mapInPandas(within, "a long, b long"), across


def similar_classes(docs: DataFrame, k: int, least: float, radius: int, words: int, first_radius: int) -> DataFrame:
    """(doc_id, component_id) of every row: components of the pairs whose sets of k-word shingles have Jaccard ``least`` or more.

    Fingerprints of the sets within the radius only give the candidates; each link is
    verified on the sets. doc_id is unique and not null.
    """
    stored = materialise(shingle_sets(docs, k, words, False), "fingerprints")
    distinct = materialise(stored.groupBy("fp", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "distinct")
    near = components(*links(distinct.where("n > 0").select("fp", F.col("doc_id").alias("node")), radius, words, first_radius))
    # the node that names a component is not among its nodes
    candidates = materialise(near.union(near.select("component", "component")).distinct(), "candidates")
    texts = docs.join(candidates, docs["doc_id"] == candidates["node"]).select("doc_id", "text", "component")
    sets = materialise(shingle_sets(texts, k, words, True).select("doc_id", "n", "shingles"), "sets").join(candidates.select(F.col("node").alias("doc_id"), F.col("component").alias("class")), "doc_id")
    found = components(*similar_links(sets, least))
    classes = distinct.join(found, distinct["doc_id"] == found["node"], "left").select("fp", "digest", F.coalesce("component", "doc_id").alias("component_id"))
    return stored.join(classes, ["fp", "digest"]).select("doc_id", "component_id")


def op9_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every row of ``documents``: 3-word shingles, at most 3 differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
