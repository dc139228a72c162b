"""Masks, unions, repairs, output lines, staged runs and samples against plain code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import morphology, points, regions, stages


def corners_of(cells):
    """Corners of a set of unit cells: odd counts of the four cells around, and both of a diagonal pair."""
    out = {}
    for x, y in cells:
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            out.setdefault((x + i, y + j), []).append((i, j))
    return {p: 1 if len(v) in (1, 3) else 2 for p, v in out.items() if len(v) in (1, 3) or (len(v) == 2 and sum(i for i, _ in v) == 1 and sum(j for _, j in v) == 1)}


@pytest.mark.parametrize("seed", range(2))
def test_unions_cover_the_cells_of_their_boxes(spark, seed):
    r = random.Random(seed)
    rows, cells = [], {}
    for g in range(6):
        for k in range(7):
            x, y, w, h = r.randint(0, 9), r.randint(0, 9), r.randint(1, 4), r.randint(1, 4)
            ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            if r.random() < 0.5:
                ring.reverse()
            rows += [(g, k, i, float(a), float(b)) for i, (a, b) in enumerate(ring)]
            cells.setdefault(g, set()).update((a, b) for a in range(x, x + w) for b in range(y, y + h))
    df = spark.createDataFrame(rows, "grp int, ring int, seq int, x double, y double")
    found = regions.shells(df, 3.0)
    area = {x.grp: x.a for x in found.groupBy("grp").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("a")).collect()}
    ends = {}
    for x in regions.corners(found).collect():
        ends.setdefault(x.grp, {}).setdefault((x.x, x.y), []).append(x.area)
    for g, own in cells.items():
        assert area[g] == pytest.approx(len(own))
        assert {p: len(v) for p, v in ends[g].items()} == corners_of(own)


def test_shell_of_a_frame_has_a_hole_and_slanted_rings_meet(spark):
    bar = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    frame = [bar(0, 0, 5, 1), bar(0, 4, 5, 1), bar(0, 0, 1, 5), bar(4, 0, 1, 5)]
    cross = [[(0, 1), (1, 0), (4, 3), (3, 4)], [(3, 0), (4, 1), (1, 4), (0, 3)]]
    rows = [(g, k, i, float(x), float(y)) for g, rings in enumerate((frame, cross)) for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    rows += [(2, 0, 0, None, 1.0), (3, 0, 0, 1.0, 1.0), (3, 0, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "grp int, ring int, seq int, x double, y double")
    got = {}
    for r in regions.shells(df, 2.0).select("grp", "ring", "area").distinct().collect():
        got.setdefault(r.grp, []).append(round(r.area, 6))
    # two bars of 6 each share a square of 2
    assert sorted(got[0]) == [-9.0, 25.0] and got[1] == [10.0] and set(got) == {0, 1}
    outer = regions.corners(regions.shells(df, 2.0)).where("area > 0 AND grp = 0").select("x", "y").collect()
    assert {(r.x, r.y) for r in outer} == {(0, 0), (5, 0), (5, 5), (0, 5)}


def test_a_bow_tie_becomes_two_rings(spark):
    tie = [(0, 0), (4, 4), (4, 0), (0, 4)]
    df = spark.createDataFrame([(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(tie)], "grp int, ring int, seq int, x double, y double")
    found = regions.shells(df, 1.0)
    assert sorted(r.area for r in found.select("ring", "area").distinct().collect()) == [4.0, 4.0]
    assert regions.shells(df.limit(0), 1.0).collect() == []


def fill(m):
    out = np.ones_like(m)
    todo = [(a, b) for a in range(m.shape[0]) for b in range(m.shape[1]) if (a in (0, m.shape[0] - 1) or b in (0, m.shape[1] - 1)) and not m[a, b]]
    while todo:
        a, b = todo.pop()
        if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and not m[a, b] and out[a, b]:
            out[a, b] = False
            todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def test_masks_equal_images(spark):
    rng = np.random.default_rng(9)
    images = {i: rng.random((17, 23)) < d for i, d in enumerate((0.12, 0.3, 0.6))}
    images[3] = np.zeros((17, 23), bool)
    images[3][2:9, 3:12] = True
    images[3][4:7, 5:9] = False
    rows = [(i, int(u), int(v)) for i, m in images.items() for v, u in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(rows, "id int, u int, v int")
    back = lambda d: {(r.id, r.u, r.v) for r in d.collect()}
    flat = lambda f: {(i, int(u), int(v)) for i, m in images.items() for v, u in zip(*np.nonzero(f(m)), strict=True)}

    def close(m):
        wide = np.zeros_like(m)
        for a, b in zip(*np.nonzero(m), strict=True):
            for x, y in morphology.disk(2):
                if 0 <= a + y < 17 and 0 <= b + x < 23:
                    wide[a + y, b + x] = True
        keep = wide.copy()
        for a, b in zip(*np.nonzero(~wide), strict=True):
            for x, y in morphology.disk(2):
                if 0 <= a + y < 17 and 0 <= b + x < 23:
                    keep[a + y, b + x] = False
        return keep

    assert back(morphology.closed(df, 2, 23, 17)) == flat(close)
    assert back(morphology.filled(df, 23, 17)) == flat(fill)
    best = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 5, 5), (0, 5, 6), (0, 9, 1), (1, 3, 3)], "id int, u int, v int")
    assert back(morphology.largest(best)) == {(0, 0, 0), (0, 1, 0), (1, 3, 3)}
    assert morphology.cleaned(df.limit(0), 2, 23, 17).collect() == []


TEXT = "one\n\n  \ntwo é\r\nthree" + "x" * 50 + "\nfour\n\nlast without end"


def test_any_cut_gives_the_same_lines(spark):
    want = [(i, t) for i, t in enumerate(TEXT.split("\n")[:-1]) if t.strip()]
    r = random.Random(1)
    rows = []
    for k in range(5):
        at = sorted(r.choices(range(len(TEXT) + 1), k=r.randint(0, 30)))
        cuts = [0, *at, len(TEXT)]
        rows += [(k, 700 * i, TEXT[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows += [(9, 0, None), (9, 1, "no end"), (None, 0, "a\n"), (None, 5000, "b\nc")]
    df = spark.createDataFrame(rows, "k int, o int, c string").repartition(3)
    got = {}
    for x in stages.lines_of(df, "k", "o", "c").collect():
        got.setdefault(x.k, []).append((x.n, x.line))
    assert all(sorted(got[k]) == want for k in range(5)) and sorted(got[None]) == [(0, "a"), (1, "b")] and 9 not in got
    for k in range(5):
        carry, every = "", []
        for _, _, c in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            whole, carry = stages.cut(carry, [c])
            every += whole
        assert every == TEXT.split("\n")[:-1] and carry == "last without end"


def streamed(spark, tmp_path, batches, schema, make, mode):
    """All rows that a stream over one file a batch gives, in order of batches."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    out = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    q = make(source).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return out


def test_streamed_lines_equal_the_table(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for k in (1, 2):
        at = sorted(r.choices(range(len(TEXT)), k=12))
        rows += [(k, f"2024-01-01 00:00:{i:02d}", i, TEXT[a:b]) for i, (a, b) in enumerate(zip([0, *at], [*at, len(TEXT)], strict=True))]
    schema = "k int, ts timestamp, o int, c string"
    typed = [tuple(x) for x in spark.createDataFrame(rows, "k int, ts string, o int, c string").selectExpr("k", "CAST(ts AS timestamp) ts", "o", "c").collect()]
    batches = [[x for x in typed if lo <= x[2] < lo + 5] for lo in (0, 5, 10)]
    got = streamed(spark, tmp_path, batches, schema, lambda d: stages.stream_lines(d, "k", "o", "c"), "append")
    want = stages.lines_of(spark.createDataFrame(typed, schema), "k", "o", "c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_runs_obey_their_lock(spark):
    start = stages.Run(0, False, "pppp")
    after = lambda *events: [run := start] and [run := run.after(e, (1,)) for e in events][-1]  # noqa: E731, F841
    assert after("run", "run", "ok") == stages.Run(1, False, "cppp")
    assert after("ok", "fail") == start and after("run", "fail") == stages.Run(0, False, "eppp")
    assert after("run", "fail", "retry", "run") == stages.Run(0, True, "appp")
    assert after("run", "ok", "run", "confirm", "run") == stages.Run(2, True, "ccap")
    assert after(*["confirm"] * 6) == stages.Run(3, False, "cccc") and after(None, "x") == start


def test_streamed_runs_equal_the_table(spark, tmp_path):
    r = random.Random(4)
    rows = [(i % 3, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i, r.choice(["run", "ok", "fail", "confirm", "retry", None])) for i in range(90)]
    typed = [tuple(x) for x in spark.createDataFrame(rows, "k int, ts string, o int, e string").selectExpr("k", "CAST(ts AS timestamp) ts", "o", "e").collect()]
    schema = "k int, ts timestamp, o int, e string"
    out = streamed(spark, tmp_path, [typed[i : i + 30] for i in (0, 30, 60)], schema, lambda d: stages.stream_states(d, "k", ["ts", "o"], "e", 4, (1,)), "update")
    last = {}
    for x in out:
        if x.k not in last or x.seen > last[x.k].seen:
            last[x.k] = x
    want = stages.run_states(spark.createDataFrame(typed, schema).repartition(7), "k", ["ts", "o"], "e", 4, (1,)).collect()
    assert sorted(map(tuple, last.values())) == sorted(map(tuple, want)) and len(want) == 3


def test_samples_are_exact_and_stable(spark):
    df = spark.range(0, 5000).selectExpr("id * 17 AS pid", "id AS v")
    draw = lambda d, n: sorted(r.pid for r in points.exact_sample(d, n).collect())
    for n in (0, 1, 777, 5000, 9000):
        got = draw(df, n)
        assert len(got) == len(set(got)) == min(n, 5000)
    assert draw(df, 777) == draw(df.repartition(9), 777) != sorted(r.pid for r in points.exact_sample(df, 777, seed=7).collect())
    assert points.exact_sample(df.limit(0), 5).collect() == []
