"""Pose refinement on the unit sphere: gradient descent of every candidate pose on its own.

A candidate pose is one row; candidates and the intersections of their panoramas meet in a join, and
each candidate descends in a group of its own. A step pairs the intersections seen from the pose with those of the
panorama (mutual nearest neighbours, per group and over all) and moves by the mean of their partial
derivatives. Translation comes first; the pairs of its last step then fix the rotation by their line directions.

Rows with a null coordinate take no part. A candidate without a pair keeps its pose; one that drifts
too far gets its first pose back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.session import stored

T, ANGLES = ("tx", "ty", "tz"), ("yaw", "pitch", "roll")
#: Fixed values of the descent: decay of both moments, floor of the step's divisor; patience, factor and least relative gain of the learning rate.
DECAY_1, DECAY_2, FLOOR = 0.9, 0.999, 1e-8
PATIENCE, FACTOR, GAIN = 5, 0.9, 1e-4
#: Distances that a task takes at once, and points of a cell from which on it is cut.
BLOCK, CROWD = 1 << 17, 3
#: Tasks over which candidates are dealt at most.
TASKS = 4096
#: The pseudo group of all intersections of a panorama.
ALL = 3


def descend(x: np.ndarray, slopes, steps: int, lr: float) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(x, the x before the last step, its cost) after ``steps`` steps by ``slopes``: x to (cost, gradient), or to None where there is nothing to go by, and x stays."""
    was, cost, best, bad = x, None, math.inf, 0
    m = v = np.zeros(len(x))
    for k in range(1, steps + 1):
        found = slopes(x)
        if found is None:
            break
        cost, g = found
        m, v = DECAY_1 * m + (1 - DECAY_1) * g, DECAY_2 * v + (1 - DECAY_2) * g * g
        was, x = x, x - lr * (m / (1 - DECAY_1**k)) / (np.sqrt(v / (1 - DECAY_2**k)) + FLOOR)
        if cost < best * (1 - GAIN):
            best, bad = cost, 0
        elif (bad := bad + 1) > PATIENCE:
            bad, lr = 0, lr * FACTOR
    return x, was, cost


class Cloud:
    """Points and, for cells of every size met so far, their order by cells. Clouds of one box may meet; one that stays keeps its orders."""

    def __init__(self, v: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.v, self.low, self.high, self.orders, self.start = v, low, high, {}, None
        self.columns = [np.ascontiguousarray(c) for c in v.T]

    def steps(self, size: float) -> tuple[int, int]:
        """What a cell's key grows by along the first two axes."""
        _, y, z = ((h - low) // size + 4 for h, low in zip(self.high.tolist(), self.low.tolist(), strict=True))
        return int(y) * int(z), int(z)

    def keys(self, size: float, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        x, y, z = (np.floor((c[at] - low) / size).astype(np.int64) + 1 for c, low in zip(self.columns, self.low, strict=True))
        by_x, by_y = self.steps(size)
        return x * by_x + y * by_y + z

    def order(self, size: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys, and whose they are."""
        if size not in self.orders:
            key = self.keys(size)
            by = np.argsort(key)
            self.orders[size] = key[by], by
        return self.orders[size]


def first_size(b: Cloud, limit: float, least: float) -> float:
    """The size of cells of which few hold a crowd of ``b``."""
    size = max(limit, least)
    while size / 2 >= least and np.count_nonzero(np.diff(b.order(size)[0])) + 1 < len(b.v) / CROWD:
        size /= 2
    return size


def within(a: Cloud, b: Cloud, limit: float, size: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of every point of ``a`` the place of its nearest in ``b``, the first of equal ones, and its distance; infinite where none is under ``limit``.

    Points meet in cells of a size that follows the crowd (``size``: where to begin, any gives the same); those that
    have none in the cells next to theirs look again in cells of twice the size. Distances in blocks of about BLOCK.
    """
    to, near = np.zeros(len(a.v), int), np.full(len(a.v), np.inf)
    # no more cells along an axis than keys of 63 bits can tell
    least = max(limit * 2.0**-20, float((b.high - b.low).max()) * 2.0**-20)
    size = first_size(b, limit, least) if size is None else size
    left = None
    while left is None or len(left):
        by_x, by_y = b.steps(size)
        key, by = b.order(size)
        if left is None:
            own, left = a.order(size)
        else:
            own = a.keys(size, left)
            walk = np.argsort(own)
            left, own = left[walk], own[walk]
        # columns of three cells each, so that the cells next to one's own are nine runs of the sorted keys
        columns = [i * by_x + j * by_y for i in (-1, 0, 1) for j in (-1, 0, 1)]
        # points of a cell ask once
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        cell, asks = np.cumsum(new) - 1, own[new]
        first, past = (np.stack([np.searchsorted(key, asks + (c + e), how) for c in columns], axis=1) for e, how in ((-1, "left"), (1, "right")))
        many = (past - first).sum(axis=1)[cell]
        cut = np.searchsorted(np.cumsum(many), np.arange(BLOCK, many.sum() + BLOCK, BLOCK))
        for i, j in zip((0, *(cut + 1)), (*(cut + 1), len(left)), strict=True):
            i, j = min(i, len(left)), min(j, len(left))
            whose = i + np.flatnonzero(many[i:j])
            if not len(whose):
                continue
            begin, end = (v[cell[whose]].ravel() for v in (first, past))
            count = end - begin
            full = count > 0
            begin, count = begin[full], count[full]
            place = by[np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)]
            n, mine = many[whose], left[whose]
            d = None
            for p, q in zip(a.columns, b.columns, strict=True):
                off = np.repeat(p[mine], n) - q[place]
                d = off * off if d is None else d + off * off
            d = np.sqrt(d)
            best = np.minimum.reduceat(d, np.cumsum(n) - n)
            near[mine] = best
            hit = np.flatnonzero(d == np.repeat(best, n))
            if len(hit) == len(mine):
                to[mine] = place[hit]
            else:
                to[mine] = len(b.v)
                np.minimum.at(to, np.repeat(mine, n)[hit], place[hit])
        if size >= limit:
            break
        # nearer ones than a cell is wide all lie in the next cells
        left = left[~(near[left] < size * (1 - 1e-9))]
        size *= 2
    near[near >= limit] = np.inf
    return to, near


def _firsts(v: np.ndarray) -> np.ndarray:
    """Places, in order, of the first of equal points; none of points with a NaN."""
    order = np.lexsort(v.T)
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[order[1:]] != v[order[:-1]]).any(axis=1)
    return np.sort(order[new & ~np.isnan(v[order]).any(axis=1)])


def partners(p: Cloud, q: Cloud, limit: float, sizes: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of two clouds that are each other's nearest and under ``limit`` apart; the first of equal ones."""
    to_q, near = within(p, q, limit, sizes[1])
    at = np.flatnonzero(near < limit)
    if not len(at):
        return at, at
    # only these can be anyone's partner
    asked, back = np.unique(to_q[at], return_inverse=True)
    from_q, _ = within(Cloud(q.v[asked], q.low, q.high), p, limit, sizes[0])
    at = at[from_q[back] == at]
    return at, to_q[at]


def mutual(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that are each other's nearest and under ``limit`` apart; the first of equal ones. Points with a coordinate that is NaN take no part."""
    sides = [_firsts(v) for v in (a, b)]
    if not all(map(len, sides)):
        return np.zeros(0, int), np.zeros(0, int)
    p, q = (v[s] for v, s in zip((a, b), sides, strict=True))
    box = np.minimum(p.min(axis=0), q.min(axis=0)), np.maximum(p.max(axis=0), q.max(axis=0))
    i, j = partners(Cloud(p, *box), Cloud(q, *box), limit)
    return sides[0][i], sides[1][j]


class Sight:
    """What stays of a panorama's 2D points and a room's 3D points (of a group) while a pose descends: equal points count once, and the 2D points keep their cells."""

    def __init__(self, p: np.ndarray, w: np.ndarray, limit: float):
        p, self.w, self.limit, self.size = p[_firsts(p)], w[_firsts(np.where(np.isfinite(w), w, np.nan))], limit, None
        # seen points lie on the unit sphere
        self.p = Cloud(p, np.minimum(p.min(axis=0), -1.0) - 1e-9, np.maximum(p.max(axis=0), 1.0) + 1e-9) if len(p) else None

    def met(self, t: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p, s, far) of the mutual pairs, as ``met`` finds them."""
        none = np.zeros((0, 3)), np.zeros((0, 3)), np.zeros(0)
        if self.p is None or not len(self.w):
            return none
        s, far = seen_from(self.w, t, rot)
        known = ~np.isnan(s).any(axis=1)
        if not known.all():
            s, far = s[known], far[known]
        if not len(s):
            return none
        q = Cloud(s, self.p.low, self.p.high)
        if self.size is None:
            least = max(self.limit * 2.0**-20, float((q.high - q.low).max()) * 2.0**-20)
            self.size = tuple(first_size(c, self.limit, least) for c in (self.p, q))
        i, j = partners(self.p, q, self.limit, self.size)
        return self.p.v[i], s[j], far[j]


def seen_from(w: np.ndarray, t: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and distances of 3D points seen from a pose."""
    seen = (w - t) @ rot.T
    far = np.maximum(np.linalg.norm(seen, axis=1), 1e-6)
    return seen / far[:, None], far


def rotation(yaw: float, pitch: float, roll: float) -> np.ndarray:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (cy, cp, cr), (sy, sp, sr) = np.cos([yaw, pitch, roll]), np.sin([yaw, pitch, roll])
    return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])


def _points(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray]:
    found = column[row].values
    return np.asarray(found.field("i")), np.stack([np.asarray(found.field(c)) for c in "xyz"], axis=1)


def met(p: np.ndarray, w: np.ndarray, t: np.ndarray, rot: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, s, far): places of the mutual pairs of 2D points and 3D points seen from a pose, directions and distances of the seen ones."""
    s, far = seen_from(w, t, rot)
    a, b = mutual(p, s, limit)
    return a, b, s[b], far[b]


def reach(grp: int, limit: float) -> float:
    """The limit of a group's pairs: a fifth over all groups."""
    return limit / 5 if grp == ALL else limit


def dealt(rows: DataFrame, state: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in one task for about each candidate: a row is small, its work is not, so that sizes do not tell how to deal them."""
    return rows.repartition(max(1, min(state.count(), TASKS)), *keys)


PAIRS = "cand long, track boolean, i2 long, i3 long, px double, py double, pz double, sx double, sy double, sz double, far double, yaw double, pitch double, roll double"


def pairs(groups: DataFrame, state: DataFrame, limit: float) -> DataFrame:
    """Mutual nearest pairs of every candidate and group: the 2D point p, the 3D point's direction s as seen, its distance."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in ("cand", "grp", "track", *T, *ANGLES)}
            for r in range(batch.num_rows):
                v = {n: c[r].as_py() for n, c in cols.items()}
                (i2, p), (i3, w) = _points(batch.column("flat"), r), _points(batch.column("solid"), r)
                a, b, s, far = met(p, w, np.array([v[c] for c in T]), rotation(*(v[c] for c in ANGLES)), reach(v["grp"], limit))
                frame = pd.DataFrame({"cand": v["cand"], "track": v["track"], "i2": i2[a], "i3": i3[b], "px": p[a, 0], "py": p[a, 1], "pz": p[a, 2], "sx": s[:, 0], "sy": s[:, 1], "sz": s[:, 2], "far": far, **{c: v[c] for c in ANGLES}})
                if len(frame):
                    yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    placed = groups.join(state.select("cand", "pano", *T, *ANGLES), "pano")
    return dealt(placed.select("cand", "grp", "track", *T, *ANGLES, "flat", "solid"), state, "cand", "grp").mapInArrow(match, PAIRS)


def grouped(flat: DataFrame, solid: DataFrame) -> DataFrame:
    """One row a panorama and group, ALL among them: its 2D and 3D intersections. A panorama and the room it is held against are bounded in nature."""
    known = lambda d: d.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    twice = lambda d: known(d).withColumn("grp", F.explode(F.array(F.col("grp").cast("int"), F.lit(ALL))))
    lists = lambda d, n: twice(d).groupBy("pano", "grp").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "x", "y", "z"))).alias(n))
    both = lists(flat, "flat").join(lists(solid, "solid"), ["pano", "grp"])
    # pairs of single groups steer the rotation; those over all only where no group has both sides
    single = both.groupBy("pano").agg((F.max((F.col("grp") != ALL).cast("int")) == 1).alias("_some"))
    return both.join(single, "pano").withColumn("track", (F.col("grp") != ALL) == F.col("_some")).drop("_some")


def translation_slope(groups: list[Sight], t: np.ndarray, rot: np.ndarray) -> tuple[float, np.ndarray] | None:
    """(cost, gradient) over the translation: the mean absolute difference of all pairs of ``groups``."""
    found = [g.met(t, rot) for g in groups]
    p, s, far = (np.concatenate(part) for part in zip(*found, strict=True))
    if not len(p):
        return None
    sign = np.sign(s - p)
    # s moves by -(1 - s s') R / far for a move of t
    off = sign - (sign * s).sum(axis=1)[:, None] * s
    return float(np.abs(p - s).sum(axis=1).mean()), (-(off @ rot) / far[:, None]).mean(axis=0)


def translated(groups: DataFrame, state: DataFrame, limit: float, steps: int, lr: float) -> DataFrame:
    """(cand, at_tx..at_tz, was_tx..was_tz, move_cost): every candidate's translation after the descent and before its last step. Candidates descend on their own, each in one group."""
    schema = "cand long, " + ", ".join(f"{k}{n} double" for k in ("at_", "was_") for n in T) + ", move_cost double"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = {n: table.column(n)[0].as_py() for n in ("cand", *T, *ANGLES)}
        parts = [Sight(*(_points(table.column(n), r)[1] for n in ("flat", "solid")), reach(table.column("grp")[r].as_py(), limit)) for r in np.argsort(table.column("grp"))]
        rot = rotation(*(v[c] for c in ANGLES))
        x, was, cost = descend(np.array([v[c] for c in T]), lambda t: translation_slope(parts, t, rot), steps, lr)
        return pa.table({"cand": [v["cand"]]} | {k + n: [c] for k, at in (("at_", x), ("was_", was)) for n, c in zip(T, at.tolist(), strict=True)} | {"move_cost": pa.array([cost], pa.float64())})

    placed = groups.join(state.select(F.col("cand").cast("long").alias("cand"), "pano", *T, *ANGLES), "pano")
    return dealt(placed.select("cand", "grp", *T, *ANGLES, "flat", "solid"), state, "cand").groupBy("cand").applyInArrow(run, schema)


def turn_slope(n: np.ndarray, u: np.ndarray, w: np.ndarray, turn: np.ndarray, inlier: float) -> tuple[float, np.ndarray] | None:
    """(cost, gradient) over the angles of matched lines: a 2D normal and the two 3D directions the line may lie by.

    A line costs the lesser of the summed absolute products of its turned normal with either
    direction; the mean is over lines that cost under ``inlier``, over all where there are none.
    """
    rot = rotation(*turn)
    (cy, cp, cr), (sy, sp, sr) = np.cos(turn), np.sin(turn)
    by_yaw = np.array([-rot[1], rot[0], np.zeros(3)])
    by_pitch = np.array([[-cy * sp, cy * cp * sr, cy * cp * cr], [-sy * sp, sy * cp * sr, sy * cp * cr], [-cp, -sp * sr, -sp * cr]])
    by_roll = np.stack([np.zeros(3), rot[:, 2], -rot[:, 1]], axis=1)
    turned = n @ rot
    by_u, by_w = (np.abs(turned * d).sum(axis=1) for d in (u, w))
    cost = np.minimum(by_u, by_w)
    near = cost < inlier
    near = near if near.any() else ~np.isnan(cost)
    if not near.any():
        return None
    side = np.sign(turned) * np.abs(np.where((by_u <= by_w)[:, None], u, w))
    return float(cost[near].mean()), np.array([(side * (n @ m)).sum(axis=1)[near].mean() for m in (by_yaw, by_pitch, by_roll)])


def _by_lines(lines: DataFrame, state: DataFrame, of, schema: str) -> DataFrame:
    """``of`` (slopes, angles) of every candidate that has ``lines`` (cand, n.., u.., w..), a row of ``schema``; slopes take angles and a limit."""

    def run(key, lines, state):
        n, u, w = (lines[[p + c for c in "xyz"]].to_numpy() for p in "nuw")
        rows = [(key[0], *of(lambda x, inlier: turn_slope(n, u, w, x, inlier), state[list(ANGLES)].to_numpy()[0]))] if len(lines) and len(state) else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return dealt(lines, state, "cand").groupBy("cand").cogroup(state.select("cand", *ANGLES).groupBy("cand")).applyInPandas(run, schema)


def turn_slopes(lines: DataFrame, state: DataFrame, inlier: float) -> DataFrame:
    """(cand, now, g_yaw..g_roll) of matched lines (cand, n.., u.., w..) at the candidates' angles."""

    def one(slopes, x):
        now, g = slopes(x, inlier) or (None, [None] * 3)
        return now, *g

    return _by_lines(lines, state, one, "cand long, now double, " + ", ".join(f"g_{n} double" for n in ANGLES))


def turned(lines: DataFrame, state: DataFrame, inlier: float, steps: int, lr: float) -> DataFrame:
    """(cand, at_yaw..at_roll, cost): every candidate's angles after the descent over its lines."""

    def all_steps(slopes, x):
        x, _, cost = descend(x, lambda a: slopes(a, inlier), steps, lr)
        return *x, cost

    return _by_lines(lines, state, all_steps, "cand long, " + ", ".join(f"at_{n} double" for n in ANGLES) + ", cost double")


def refine_poses(
    candidates: DataFrame, flat: DataFrame, solid: DataFrame, flat_lines: DataFrame, solid_lines: DataFrame,
    steps_t: int = 100, steps_r: int = 50, lr: float = 0.1, limit: float = 0.5, inlier: float = 0.2, max_move: float = 1.0, max_turn: float = 60.0,
) -> DataFrame:
    """(cand, pano, tx..tz, yaw, pitch, roll, cost, turn_cost, moved, turned, reverted, n0, n1, n2) of every candidate.

    ``candidates``: (cand, pano, tx..tz, yaw, pitch, roll); ``flat`` and ``solid``: (pano, i, grp, x, y, z, a, b), intersections on the sphere
    and in the room with their group and two lines; the lines: (pano, line, x, y, z), normals and directions.
    n0 to n2 count the pairs of each group.
    """
    groups = stored(grouped(flat, solid), "groups")
    state = candidates.select("cand", "pano", *T, *ANGLES, *(F.col(n).alias("first_" + n) for n in (*T, *ANGLES)))
    # a candidate whose panorama has no intersections is not met, and stays
    moves = stored(translated(groups, state, limit, steps_t, lr), "moves")
    state = state.join(moves, "cand", "left").withColumns({n: F.coalesce("at_" + n, n) for n in T} | {"was_" + n: F.coalesce("was_" + n, n) for n in T}).drop(*("at_" + n for n in T))
    state = stored(state, "state")
    # the pairs that made the last step
    before = state.withColumns({n: F.col("was_" + n) for n in T})
    kept = stored(pairs(groups, before, limit).where("track").select("cand", "i2", "i3").join(state.select("cand", "pano"), "cand"), "matches")
    both = kept.join(flat.select("pano", F.col("i").alias("i2"), F.col("grp").alias("g2"), F.col("a").alias("a2"), F.col("b").alias("b2")), ["pano", "i2"])
    both = both.join(solid.select("pano", F.col("i").alias("i3"), F.col("grp").alias("g3"), F.col("a").alias("a3"), F.col("b").alias("b3")), ["pano", "i3"])
    line = lambda d, k, p: d.select("pano", F.col("line").alias(k), *(F.col(c).alias(p + c) for c in "xyz"))
    # each pair gives its two 2D lines; either may lie by either of the 3D lines
    one = both.select("cand", "pano", F.explode(F.array("a2", "b2")).alias("k2"), "a3", "b3")
    lines = one.join(line(flat_lines, "k2", "n"), ["pano", "k2"]).join(line(solid_lines, "a3", "u"), ["pano", "a3"]).join(line(solid_lines, "b3", "w"), ["pano", "b3"])
    lines = stored(lines.select("cand", *(p + c for p in "nuw" for c in "xyz")), "lines")
    turns = stored(turned(lines, state, inlier, steps_r, lr), "turns")
    state = state.join(turns, "cand", "left").withColumns({n: F.coalesce("at_" + n, n) for n in ANGLES})
    state = stored(state.drop(*("at_" + n for n in ANGLES), *("was_" + n for n in T)), "state")
    now, was = G.rotation_from_ypr(*ANGLES), G.rotation_from_ypr(*("first_" + n for n in ANGLES))
    trace = sum((now[r][c] * was[r][c] for r in range(3) for c in range(3)), F.lit(0.0))
    far = G.norm(G.sub(T, tuple("first_" + n for n in T)))
    turn = F.degrees(F.acos(G.clamp((G.clamp(trace, -1.0, 3.0) - 1) / 2, -1.0, 1.0)))
    back = (F.col("moved") > max_move) | (F.col("turned") > max_turn)
    counts = both.where("g2 = g3").groupBy("cand").agg(*(F.count_if(F.col("g2") == k).alias(f"n{k}") for k in range(3)))
    out = state.withColumns({"moved": far, "turned": turn}).withColumn("reverted", back).join(counts, "cand", "left")
    return out.select("cand", "pano", *(F.when(F.col("reverted"), F.col("first_" + n)).otherwise(F.col(n)).alias(n) for n in (*T, *ANGLES)), F.col("move_cost").alias("cost"), F.col("cost").alias("turn_cost"), "moved", "turned", "reverted", *(F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}") for k in range(3)))
