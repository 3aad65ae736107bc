"""Masks of areas against the crossing rule over all pairs."""

import math
import random
from itertools import groupby

import numpy as np
import pytest

from freshet.operators import areas
from freshet.operators.areas import FEW, _odd_left, area_means, cover_areas, points_in_areas, ring_edges

VERTICES = "area_id string, ring int, seq int, x double, y double"


def brute(vertices, points):
    rings = {}
    for a, r, s, x, y in vertices:
        rings.setdefault((a, r), []).append((s, x, y))
    edges = {}
    for (a, _), vs in rings.items():
        vs = [v[1:] for v in sorted(vs)]
        edges.setdefault(a, []).extend(zip(vs, vs[1:] + vs[:1], strict=True))
    out = []
    for p, x, y in points:
        for a, es in edges.items():
            n = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in es)
            if n % 2:
                out.append((p, a))
    return sorted(out)


def masked(spark, vertices, points, cell):
    cover = cover_areas(ring_edges(spark.createDataFrame(vertices, VERTICES)), cell)
    pts = spark.createDataFrame(points, "p int, x double, y double")
    return cover, sorted((r["p"], r["area_id"]) for r in points_in_areas(pts, cover, cell).collect())


def wild(seed):
    """Areas with holes, level and upright edges on cell borders, and rings that cross themselves."""
    rng = random.Random(seed)
    vertices, at = [], lambda: rng.choice([rng.uniform(-12, 12), float(rng.randint(-12, 12)), rng.randint(-24, 24) / 2])
    for a in range(4):
        for ring in range(rng.randint(1, 3)):
            vertices += [(f"a{a}", ring, s, at(), at()) for s in range(rng.randint(3, 14))]
    vertices += [("square", 0, s, x, y) for s, (x, y) in enumerate([(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)])]
    vertices += [("square", 1, s, x, y) for s, (x, y) in enumerate([(-3.0, -3.0), (-3.0, 3.0), (3.0, 3.0), (3.0, -3.0), (-3.0, -3.0)])]
    corners = [(x, y) for _, _, _, x, y in vertices]
    spots = [(at(), at()) for _ in range(500)] + corners + [((x + u) / 2, (y + v) / 2) for (x, y), (u, v) in zip(corners, corners[1:], strict=False)]
    return vertices, [(p, x, y) for p, (x, y) in enumerate(spots)]


@pytest.mark.parametrize("seed,cell", [(1, 1.0), (2, 0.37), (3, 5.0), (4, 100.0)])
def test_points_are_in_the_areas_that_the_rule_says(spark, seed, cell):
    vertices, points = wild(seed)
    cover, got = masked(spark, vertices, points, cell)
    assert got == brute(vertices, points)
    cells = [tuple(r) for r in cover.select("area_id", "_row", "_col").collect()]
    assert len(cells) == len(set(cells))  # so that no point is found twice


def test_far_from_the_origin(spark):
    rng, far = random.Random(7), 4.0e8
    vertices = [("a", 0, s, far + rng.uniform(0, 30), far + rng.uniform(0, 30)) for s in range(30)]
    points = [(p, far + rng.uniform(0, 30), far + rng.uniform(0, 30)) for p in range(500)]
    assert masked(spark, vertices, points, 1.0)[1] == brute(vertices, points)


def test_the_inside_of_a_large_area_has_no_edges_to_test(spark):
    vertices = [("a", 0, s, x, y) for s, (x, y) in enumerate([(0.5, 0.5), (60.5, 0.5), (60.5, 60.5), (0.5, 60.5)])]
    cells = cover_areas(ring_edges(spark.createDataFrame(vertices, VERTICES)), 1.0).collect()
    within = [c for c in cells if c["_edges"] is None]
    assert len(within) == 59 * 59 and len(cells) == 61 * 61
    assert max(len(c["_edges"]) for c in cells if c["_edges"] is not None) <= 3


def test_nulls_infinities_repeats_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    vertices = [("a", 0, s, x, y) for s, (x, y) in enumerate(ring)] + [("a", 0, None, 9.0, 9.0), (None, 0, 1, 1.0, 1.0), ("a", 0, 9, None, 1.0), ("b", 0, 1, nan, 1.0), ("b", 0, 2, 1.0, inf), ("c", 0, 1, 1.0, 1.0), ("d", 0, 1, 1.0, 1.0), ("d", 0, 2, 3.0, 3.0)]
    points = [(1, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 1.0), (3, nan, 1.0), (4, 1.0, inf), (5, 9.0, 9.0)]
    assert masked(spark, vertices, points, 1.0)[1] == [(1, "a"), (1, "a")]
    assert masked(spark, [], points, 1.0)[1] == [] == masked(spark, vertices, [], 1.0)[1]
    with pytest.raises(ValueError):
        cover_areas(ring_edges(spark.createDataFrame(vertices, VERTICES)), 0)


def test_other_columns_pass_whatever_their_names(spark):
    vertices = [("a", 0, s, x, y) for s, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])]
    cover = cover_areas(ring_edges(spark.createDataFrame(vertices, VERTICES)), 1.0)
    names = ["x", "y", "_row", "_col", "_edges", "_before", "_id", "_point", "_x", "_y", "odd.name"]
    out = points_in_areas(spark.createDataFrame([(1.0, 1.0, *names[2:])], names), cover, 1.0).collect()
    assert [tuple(r) for r in out] == [(1.0, 1.0, *names[2:], "a")]


def test_means_over_areas(spark):
    vertices, points = wild(11)
    cover = cover_areas(ring_edges(spark.createDataFrame(vertices, VERTICES)), 1.0)
    rows = spark.createDataFrame([(p, x, y, float(p), p % 2) for p, x, y in points], "p int, x double, y double, rain double, hour int")
    got = {(r["area_id"], r["hour"]): (r["n_points"], round(r["rain_mean"], 9)) for r in area_means(rows, cover, 1.0, ["rain"], keys=["hour"]).collect()}
    pairs = sorted((a, p % 2, p) for p, a in brute(vertices, points))
    want = {}
    for key, group in groupby(pairs, key=lambda t: t[:2]):
        ps = [p for *_, p in group]
        want[key] = (len(ps), round(sum(ps) / len(ps), 9))
    assert got == want


def star(n, seed, area="star"):
    """A ring about (10, 10) whose vertices lie at any distance from 5 to 10: every edge passes many cells."""
    rng = random.Random(seed)
    turns = [(s, 2 * math.pi * s / n, rng.uniform(5, 10)) for s in range(n)]
    return [(area, 0, s, 10 + r * math.cos(t), 10 + r * math.sin(t)) for s, t, r in turns]


@pytest.mark.parametrize("block", [200_000, 50])
def test_borders_of_many_edges_are_searched(spark, monkeypatch, block):
    monkeypatch.setattr(areas, "BLOCK", block)
    rng = random.Random(5)
    wild_ring = [("wild", 0, s, rng.uniform(0, 20), float(rng.randint(0, 20))) for s in range(600)]  # edges cross each other
    vertices = star(2000, 5) + star(700, 6, "other") + wild_ring + wild(3)[0]
    points = [(p, rng.uniform(0, 20), rng.uniform(0, 20)) for p in range(1000)] + [(p, x, y) for p, (*_, x, y) in enumerate(vertices[::7], 1000)]
    cover, got = masked(spark, vertices, points, 1.0)
    assert got == brute(vertices, points)
    assert cover.where("_many IS NOT NULL").count() > 20


def test_a_cover_holds_every_edge_once_a_row(spark):
    vertices, cell = star(3000, 8), 0.5
    ends = [v[3:] for v in vertices]
    passed = sum(abs(math.floor(y / cell) - math.floor(v / cell)) + 1 for (_, y), (_, v) in zip(ends, ends[1:] + ends[:1], strict=True))
    cover = cover_areas(ring_edges(spark.createDataFrame(vertices, VERTICES)), cell)
    held = sum(len(c["_edges"] or []) + len(c["_many"] or []) for c in cover.collect())
    assert passed <= held <= passed + FEW * 42 * 42  # clusters of few edges have them in each cell


def test_search_of_many_points_among_many_edges():
    ends = [v[3:] for v in star(60_000, 9)]
    edges = [np.array(c) for c in zip(*[(*p, *q) for p, q in zip(ends, ends[1:] + ends[:1], strict=True)], strict=True)]
    rng = np.random.default_rng(9)
    x, y = rng.uniform(0, 20, 60_000), rng.uniform(0, 20, 60_000)
    odd = _odd_left(x, y, *edges)
    x1, y1, x2, y2 = edges
    with np.errstate(divide="ignore", invalid="ignore"):
        want = [(((y1 > v) != (y2 > v)) & ~(u < x1 + (v - y1) * (x2 - x1) / (y2 - y1))).sum() % 2 == 1 for u, v in zip(x[:300], y[:300], strict=True)]
    assert odd[:300].tolist() == want
