"""Approximate nearest neighbours by a robust-pruned directed graph (operator 10).

Vectors of nearly the same length (a band: lengths within some 5 %) are put in order by their inner product
with a query nearly as by their angle to it, so each band has graphs of its own over unit vectors, however lengths
vary. Distinct vectors of a band are dealt to shards by a hash; each shard builds its own
graph: points enter in batches that double, a greedy beam search over the graph
so far proposes neighbours, and relaxed pruning (an edge goes when a kept neighbour is
closer to its end by the factor ALPHA) keeps few but diverse edges, with pruned reverse
edges. A query runs a beam search in every shard; the beams' ends are scored again in
double precision on the original vectors and merged. A shard returns all that tie with its
last place, and a beam whose own end still ties is widened until it doesn't, so that the
cut by the smaller vec_id is made over all of them.

Vectors keep their component type; only the graph works on unit copies in 32 bits, so neither huge nor tiny
vectors lose their digits there. Where the edges lead to fewer nodes than are asked for, the shard is scanned instead.

Every row is indexed: rows with equal vectors share one node and come back by the k + 1
smallest ids, found by a tree of partial top lists so that no group of copies is one
task's. The graph's memory is bounded by SHARD_ROWS. A query set that is a share of the
rows meets every shard, so the searches grow with rows x rows / SHARD_ROWS; larger shards
lower that, at some recall for a given beam. Bands add a shard each at most: some 100 for lengths that
vary by two powers of ten.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without an id, take no part; vectors of different lengths never meet; rows that
repeat id and vector count once; a score that overflows is infinite (one that is not a
number ranks last); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import materialise

SHARD_ROWS = 8192
DEGREE, BUILD_BEAM, ALPHA = 32, 48, 1.2
SEARCH_BEAM, EXPAND = 96, 4
QUERY_BLOCK = 8192
#: Powers of two in one band of lengths, with 1 in the middle of a band.
BAND = 0.07
#: Scores this close, relative to the largest, may tie in 32 bits.
TIE = 1e-5
#: Searches that run as one array program.
LANES = 512
TREE = (64, 8, 1)
#: Most tasks that shards and query blocks are dealt to.
MAX_TASKS = 20_000


def _distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from q[i] to x[at[i, j]]; at < 0 is infinitely far."""
    v = x[np.maximum(at, 0)]
    d = np.einsum("ijk,ijk->ij", v, v) - 2 * np.einsum("ijk,ik->ij", v, q) + np.einsum("ik,ik->i", q, q)[:, None]
    return np.where(at < 0, np.inf, d)


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances), nearest first, of the beam of each query."""
    n, lanes = len(x), len(q)
    ids = np.full((lanes, beam), -1, dtype=np.int64)
    ids[:, 0] = entry
    dist = np.full((lanes, beam), np.inf, dtype=x.dtype)
    dist[:, :1] = _distances(x, ids[:, :1], q)
    done = np.zeros((lanes, beam), dtype=bool)
    seen = np.zeros((lanes, n + 1), dtype=bool)
    seen[:, entry] = True
    seen[:, n] = True
    live = np.arange(lanes)
    while len(live):
        open_ = ~done[live] & np.isfinite(dist[live])
        rank = np.cumsum(open_, axis=1)
        pick = open_ & (rank <= EXPAND)
        going = pick.any(axis=1)
        live, pick = live[going], pick[going]
        if not len(live):
            break
        done[live] |= pick
        lane, slot = np.nonzero(pick)
        order = np.cumsum(pick, axis=1)[lane, slot] - 1
        near = np.full((len(live), EXPAND, edges.shape[1]), n, dtype=np.int64)
        near[lane, order] = edges[ids[live[lane], slot]]
        near = near.reshape(len(live), -1)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        seen[live[:, None], np.where(fresh, near, n)] = True
        width = int(fresh.sum(axis=1).max())
        if width == 0:
            continue
        near = np.take_along_axis(near, np.argsort(~fresh, axis=1, kind="stable")[:, :width], axis=1)
        d = _distances(x, near, q[live])
        every_d = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(every_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(every_d, best, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(near, dtype=bool)], axis=1), best, axis=1)
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point among its candidates (-1: none)."""
    cand = np.where(cand == points[:, None], -1, cand)
    order = np.sort(cand, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    cand = order
    d = _distances(x, cand, x[points])
    rank = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, rank, axis=1), np.take_along_axis(d, rank, axis=1)
    width = max(1, int((cand >= 0).sum(axis=1).max(initial=0)))
    cand, d = cand[:, :width], d[:, :width]
    v = x[np.maximum(cand, 0)]
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = cand >= 0
    out = np.full((len(points), degree), -1, dtype=np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        first = alive.argmax(axis=1)
        out[has, k] = cand[rows[has], first[has]]
        alive &= ~((alpha * alpha * between[rows, first] <= d) & has[:, None])
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges n x degree padded with -1, entry point) over the rows of x."""
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int64)
    mean = x.mean(axis=0)
    entry = int(((x - mean) ** 2).sum(axis=1).argmin())
    order = np.r_[entry, np.setdiff1d(np.random.default_rng(7).permutation(n), [entry], assume_unique=True)]
    at = 1
    while at < n:
        batch = order[at : at + min(max(1, at), LANES // 2)]
        ids, _ = beam_search(x, edges, entry, x[batch], beam)
        found = robust_prune(x, batch, ids, degree, alpha)
        edges[batch] = found
        src, dst = np.repeat(batch, degree), found.ravel()
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, starts, counts = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(targets), counts.max(initial=1)), -1, dtype=np.int64)
        back[np.repeat(np.arange(len(targets)), counts), np.arange(len(dst)) - np.repeat(starts, counts)] = src
        for i in range(0, len(targets), LANES):
            t = targets[i : i + LANES]
            both = np.concatenate([edges[t], back[i : i + LANES]], axis=1)
            fits = (both >= 0).sum(axis=1) <= degree
            if fits.any():
                edges[t[fits]] = np.take_along_axis(both[fits], np.argsort(both[fits] < 0, axis=1, kind="stable")[:, :degree], axis=1)
            if (~fits).any():
                edges[t[~fits]] = robust_prune(x, t[~fits], both[~fits], degree, alpha)
        at += len(batch)
    return edges, entry


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2, dim, band) of rows that take part; h1 and h2 stand for the vector."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists("embedding", lambda c: c != 0)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    # no negative zeros: they'd hash apart
    v = F.transform("embedding", lambda c: F.when(c == 0, F.lit(0).cast(kind)).otherwise(c.cast(kind)))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    # squares of parts of the largest component: no length overflows
    scaled = F.aggregate(F.transform("v", lambda c: F.pow(c.cast("double") / largest, F.lit(2.0))), F.lit(0.0), lambda a, c: a + c)
    band = F.floor((F.log2(largest) + F.log2(scaled) / 2) / BAND + 0.5).cast("int")
    return rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim"), band.alias("band"))


def smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, ids): up to ``keep`` smallest ids of each vector, by a tree of partial lists."""
    part = rows.select("h1", "h2", "vec_id").distinct()
    for fan in TREE:
        w = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(fan))).orderBy("vec_id")
        part = part.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
    return part


def _units(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in 32 bits: the graph's points, and queries, whose own length changes no order."""
    unit = v.astype(np.float64) / np.abs(v).max(axis=1, keepdims=True).astype(np.float64)
    return (unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))).astype(np.float32)


def build_index(distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per (dim, band, shard): vectors, keys and edges of its graph. ``groups``: (dim, band, shards)."""
    dtype = "<f4" if distinct.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def build(key, frame):
        v = np.stack(frame["v"].to_numpy()).astype(dtype)
        edges, entry = build_graph(_units(v))
        keys = frame[["h1", "h2"]].to_numpy(dtype="<i8")
        return pd.DataFrame({"dim": [key[0]], "band": [key[1]], "shard": [key[2]], "entry": [entry], "vectors": [v.tobytes()], "keys": [keys.tobytes()], "edges": [edges.astype("<i4").tobytes()]})

    # few groups, each much work: one task a shard
    dealt = distinct.join(groups, ["dim", "band"]).withColumn("shard", F.pmod("h1", "shards").cast("int"))
    return spread(dealt, groups.agg(F.sum("shards")).first()[0] or 1, "dim", "band", "shard").groupBy("dim", "band", "shard").applyInPandas(build, "dim int, band int, shard int, entry int, vectors binary, keys binary, edges binary")


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` over so many tasks that adaptive execution leaves as they are."""
    return df.repartition(int(max(1, min(tasks, MAX_TASKS))), *keys)


def search_shard(v: np.ndarray, x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, units: np.ndarray, keep: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, node, score) of each query's ``keep`` best and of all that tie with the last of them."""
    lanes = np.arange(len(q))
    out: list[tuple] = []
    while len(lanes):
        ids, dist = beam_search(x, edges, entry, units[lanes], beam)
        found = np.isfinite(dist)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("ijk,ik->ij", v[np.maximum(ids, 0)].astype(np.float64), q[lanes].astype(np.float64))
        rank = np.where(found & ~np.isnan(score), score, -np.inf)
        order = np.argsort(-rank, axis=1, kind="stable")
        at = min(keep, beam) - 1
        last = np.take_along_axis(rank, order[:, at : at + 1], axis=1)
        # the beam is full and its far end can't be told from the last place: look further
        with np.errstate(invalid="ignore"):
            slack = TIE * np.maximum(np.abs(last), np.abs(rank).max(axis=1, where=np.isfinite(rank), initial=0)[:, None])
            open_ = (found.all(axis=1) & (rank.min(axis=1) >= last[:, 0] - slack[:, 0])) if beam < len(x) else np.zeros(len(lanes), dtype=bool)
        few = found.sum(axis=1) < min(keep, len(x))
        for lane in np.flatnonzero(few):
            with np.errstate(over="ignore", invalid="ignore"):
                every = v.astype(np.float64) @ q[lanes[lane]].astype(np.float64)
            value = np.where(np.isnan(every), -np.inf, every)
            node = np.flatnonzero(value >= np.sort(value)[-min(keep, len(x))])
            out.append((np.full(len(node), lanes[lane]), node, every[node]))
        take = found & (rank >= last) & ~(open_ | few)[:, None]
        lane, slot = np.nonzero(take)
        out.append((lanes[lane], ids[lane, slot], score[lane, slot]))
        lanes, beam = lanes[open_], min(2 * beam, len(x))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def search_index(index: DataFrame, queries: DataFrame, groups: DataFrame, blocks: int, keep: int) -> DataFrame:
    """(q1, q2, h1, h2, score): the ``keep`` best distinct vectors of each query in each shard, ties included."""
    dtype = "<f4" if queries.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def search(key, graphs, wanted):
        cols = {"q1": [], "q2": [], "h1": [], "h2": [], "score": []}
        if len(graphs) and len(wanted):
            g, dim = graphs.iloc[0], int(key[0])
            v = np.frombuffer(g["vectors"], dtype=dtype).reshape(-1, dim)
            keys, edges = np.frombuffer(g["keys"], dtype="<i8").reshape(-1, 2), np.frombuffer(g["edges"], dtype="<i4").reshape(len(v), -1).astype(np.int64)
            x = _units(v)
            every = np.stack(wanted["v"].to_numpy()).astype(dtype)
            for at in range(0, len(every), LANES):
                q = every[at : at + LANES]
                lane, node, score = search_shard(v, x, edges, int(g["entry"]), q, _units(q), keep, max(SEARCH_BEAM, keep))
                cols["q1"].append(wanted["h1"].to_numpy()[at + lane])
                cols["q2"].append(wanted["h2"].to_numpy()[at + lane])
                cols["h1"].append(keys[node, 0])
                cols["h2"].append(keys[node, 1])
                cols["score"].append(score)
        return pd.DataFrame({k: np.concatenate(c) if c else np.zeros(0, dtype=np.int64 if k != "score" else float) for k, c in cols.items()})

    block = F.pmod("h2", F.lit(blocks)).cast("int")
    keys = ["dim", "band", "shard", "block"]
    tasks = (groups.agg(F.sum("shards")).first()[0] or 1) * blocks
    shards = groups.select("dim", "band", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard"))
    # every query meets every shard of its length
    dealt = queries.drop("band").withColumn("block", block).join(shards, "dim")
    copied = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread(copied, tasks, *keys).groupBy(*keys).cogroup(spread(dealt, tasks, *keys).groupBy(*keys)).applyInPandas(search, "q1 long, q2 long, h1 long, h2 long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``is_query`` marks."""
    rows = materialise(usable(vectors), "vectors")
    distinct = materialise(rows.groupBy("h1", "h2", "dim", "band").agg(F.any_value("v").alias("v")), "distinct-vectors")
    groups = materialise(distinct.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards")), "vector-groups")
    index = materialise(build_index(distinct, groups), "graph")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    keys = asked.select("q1", "q2").distinct()
    queries = distinct.join(keys, (distinct["h1"] == keys["q1"]) & (distinct["h2"] == keys["q2"]), "left_semi")
    blocks = max(1, -(-keys.count() // QUERY_BLOCK))
    found = search_index(index, queries, groups, blocks, k + 1)
    high = (F.isnan("score").asc(), F.col("score").desc())
    # rank, not row_number: what ties with the last place is cut by vec_id below
    found = found.withColumn("_n", F.rank().over(Window.partitionBy("q1", "q2").orderBy(*high))).where(F.col("_n") <= k + 1).drop("_n")
    rows_of = found.join(smallest_ids(rows, k + 1), ["h1", "h2"]).select("q1", "q2", "score", "vec_id")
    best = Window.partitionBy("q1", "q2").orderBy(*high, "vec_id")
    rows_of = rows_of.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    final = Window.partitionBy("query_id").orderBy(*high, "vec_id")
    out = asked.join(rows_of, ["q1", "q2"]).where("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op10_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row of ``embeddings`` whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0, 20)
