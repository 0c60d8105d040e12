"""Joins of boxes, areas and components against brute force, and cells that hold far more than their share."""

from __future__ import annotations

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import grids as gr
from auditloom.operators import spatial as sp

BOX = "case_id int, id int, x0 double, y0 double, x1 double, y1 double"


def boxes_of(rng, n, kinds=((1, 1), (300, 0.01), (0.01, 300), (0, 0), (40, 40))):
    out = []
    for i in range(n):
        w, h = rng.choice(kinds)
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        out.append((i % 3, i, x, y, x + w * rng.random(), y + h * rng.random()))
    return out


def test_met_equals_all_pairs(spark):
    rng = random.Random(1)
    a, b = boxes_of(rng, 150), boxes_of(rng, 150) + [(0, 500, None, 0.0, 1.0, 1.0), (0, 501, 2.0, 0.0, 1.0, 1.0)]
    got = sp.met(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["case_id"]).select("case_id", "l.id", F.col("r.id").alias("other")).collect()
    want = {(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and None not in q and q[4] >= q[2] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sp.met(spark.createDataFrame([], BOX), spark.createDataFrame(b, BOX), ["case_id"]).collect() == []


def slow_area(boxes):
    xs = sorted({x for b in boxes for x in (b[2], b[4])})
    total = 0.0
    for lo, hi in zip(xs, xs[1:]):
        upto = None
        for b in sorted((b for b in boxes if b[2] <= lo and b[4] >= hi), key=lambda b: (b[3], b[5])):
            start = b[3] if upto is None else max(b[3], upto)
            total += max(0.0, b[5] - start) * (hi - lo)
            upto = b[5] if upto is None else max(upto, b[5])
    return total


@pytest.mark.parametrize("crowd", [2, 64])
def test_union_area_equals_sweep(spark, crowd):
    rng = random.Random(2)
    rows = boxes_of(rng, 120) + [(7, 1000, 0.0, 0.0, 0.0, 5.0)] + [(8, 1001, 0.0, 0.0, 2.0, 3.0)] * 3
    got = {r["case_id"]: r["area"] for r in sp.union_area(spark.createDataFrame(rows, BOX), crowd).collect()}
    assert set(got) == {0, 1, 2, 8}
    for case, area in got.items():
        assert area == pytest.approx(slow_area([r for r in rows if r[0] == case]), rel=1e-9, abs=2e-9)
    assert sp.union_area(spark.createDataFrame([], BOX)).collect() == []


def test_area_of_a_crowded_cell(spark):
    """A case whose boxes all lie in one small place, and strips that all go through: the work grows with the boxes, not with their square."""
    n = 60_000
    grid = spark.range(n).selectExpr("1 AS case_id", "CAST(id AS INT) AS id", "0.5 + (id % 300) * 1e-7 AS x0", "0.5 + floor(id / 300) * 1e-7 AS y0").selectExpr("*", "x0 + 0.5e-7 AS x1", "y0 + 0.5e-7 AS y1")
    strips = spark.range(n).selectExpr("2 AS case_id", "CAST(id AS INT) AS id", "0D AS x0", "id * 1D AS y0", "1D AS x1", "id + 0.5D AS y1")
    start = time.time()
    got = {r["case_id"]: r["area"] for r in sp.union_area(grid.withColumns({c: F.col(c).cast("double") * 1e6 for c in sp.SIDES}).unionByName(strips)).collect()}
    assert time.time() - start < 150
    assert got[1] == pytest.approx(n * 0.05 * 0.05, rel=1e-6) and got[2] == pytest.approx(n / 2)


def slow_components(rows):
    label = {r[1]: r[1] for r in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for p in rows:
        for q in rows:
            h = max(p[5] - p[3], q[5] - q[3])
            if p[0] == q[0] and max(q[2] - p[4], p[2] - q[4]) <= max(24, 2.5 * h) and max(q[3] - p[5], p[3] - q[5]) <= max(24, 2 * h):
                a, b = root(p[1]), root(q[1])
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in label}


def test_components_follow_the_height_of_words(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        h = rng.choice([2, 6, 10, 30, 90]) * rng.random()
        x, y = rng.uniform(0, 2500), rng.uniform(0, 2500)
        rows.append((i % 2, i, x, y, x + rng.uniform(0, 60), y + h))
    want = slow_components(rows)
    got = {r["id"]: r["component"] for r in sp.word_components(spark.createDataFrame(rows, BOX)).collect()}
    assert got == want and 10 < len(set(want.values())) < 390


def test_components_of_a_crowded_cell(spark):
    n = 40_000
    words = spark.range(n).selectExpr("CAST(id % 2 AS INT) AS case_id", "CAST(id AS INT) AS id", "(id % 97) * 0.1D AS x0", "(id % 89) * 0.1D AS y0").selectExpr("*", "x0 + 3 AS x1", "y0 + 2 AS y1")
    start = time.time()
    assert {tuple(r) for r in sp.word_components(words).groupBy("component").count().collect()} == {(0, n // 2), (1, n // 2)}
    assert time.time() - start < 120


def test_pairs_shrink_where_they_are_made(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6), i, rng.choice([None, 0.1, 0.2, 0.9]), rng.choice([1.0, 2.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "target int, proposal int, coverage double, area double").coalesce(1)
    few = gr.leading(df, ["target"], [("coverage", "descending"), ("area", "ascending"), ("proposal", "ascending")])
    assert few.count() < 60
    want = {t: min((-(c or -1), a, p) for k, p, c, a in rows if k == t)[2] for t in range(6)}
    assert {r["target"]: r["proposal"] for r in gr.representatives(df).collect()} == want
    assert "MapInArrow" in gr.representatives(df)._jdf.queryExecution().executedPlan().toString()


def test_met_deals_crowded_cells(spark, monkeypatch):
    """What one task compares is bounded, and no pair is lost or doubled."""
    rng = random.Random(4)
    a, b = boxes_of(rng, 200, ((40, 40), (1, 1))), boxes_of(rng, 200, ((40, 40), (0, 0)))
    dfs = [spark.createDataFrame(x, BOX) for x in (a, b)]
    want = {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]}
    monkeypatch.setattr(sp, "LEFT_BLOCK", 8)
    monkeypatch.setattr(sp, "RIGHT_BLOCK", 4)
    got = sp.met(*dfs, ["case_id"]).select("l.id", F.col("r.id").alias("other")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    here, _, group = sp._dealt(*sp._cells(*dfs, ["case_id"]))
    assert here.groupBy(*group).count().agg(F.max("count")).first()[0] <= 24


def proposals_of(rng, n):
    boxes = boxes_of(rng, n, ((1, 1), (300, 0.01), (0.01, 300), (40, 40), (90, 60)))
    boxes += [(c, n + k, *b[2:]) for k, (c, b) in enumerate((rng.randrange(3), rng.choice(boxes)) for _ in range(n // 2))]  # copies, so ties
    rows = [(c, i, "target" if i % 4 == 0 else "proposal", *sides) for c, i, *sides in boxes if sides[2] > sides[0] and sides[3] > sides[1]]
    return rows + [(0, 10**6, "proposal", None, 0.0, 1.0, 1.0), (None, 10**6 + 1, "proposal", -50.0, -50.0, 50.0, 50.0), (None, 10**6 + 4, "target", 0.0, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("blocks", [None, (32, 8)])
def test_leading_pairs_equal_those_of_all(spark, monkeypatch, blocks):
    if blocks:  # every cell is dealt to several tasks
        monkeypatch.setattr(sp, "LEFT_BLOCK", blocks[0])
        monkeypatch.setattr(sp, "RIGHT_BLOCK", blocks[1])
        monkeypatch.setattr(sp.Leading, "tile", (5, 7))
    df = spark.createDataFrame(proposals_of(random.Random(5), 400), "case_id int, vec_id long, role string, x0 double, y0 double, x1 double, y1 double")
    pairs = gr.overlap_join(df).cache()
    for best, order in ((gr.best_proposal, gr.ByScore), (gr.representatives, gr.ByCoverage)):
        few = gr.overlap_join(df, leading=order)
        want = sorted(map(tuple, best(pairs).collect()))
        assert sorted(map(tuple, best(few).collect())) == want and len(want) > 80
        assert few.subtract(pairs).count() == 0


def test_leading_pairs_have_no_row_each(spark):
    """All boxes of a case overlap: rows grow with the targets, not with the pairs."""
    n = 8000
    df = spark.range(n).selectExpr("1 AS case_id", "id AS vec_id", "IF(id % 5 = 0, 'target', 'proposal') AS role", "(id * 7919 % 1009) * 1e-4D AS x0", "(id * 104729 % 1013) * 1e-4D AS y0").selectExpr("*", "x0 + 0.2 AS x1", "y0 + 0.2 AS y1")
    for order in (gr.ByScore, gr.ByCoverage):
        assert n // 5 <= gr.overlap_join(df, leading=order).count() < n * 4


def test_rounds_as_sql(spark):
    rng = random.Random(9)
    values = [17.62840875, 2.5e-9, -0.5, 1e300, 0.0] + [round(rng.uniform(-20, 20), 8) + 5e-8 for _ in range(4000)] + [rng.random() for _ in range(4000)]
    c = duckdb.connect()
    c.execute("CREATE TABLE t AS SELECT unnest($1::DOUBLE[]) AS x", [values])
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for places in (7, 9):
        want = dict(c.execute(f"SELECT x, round(x, {places}) FROM t").fetchall())
        assert {r["x"]: r["y"] for r in df.select("x", gr.rounded(F.col("x"), places).alias("y")).collect()} == pytest.approx(want, rel=1e-15)
        assert dict(zip(values, gr.rounded_array(np.array(values), places).tolist())) == pytest.approx(want, rel=1e-15)
