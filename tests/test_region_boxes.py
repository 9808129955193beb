"""Regions of few cells: whole outlines, and points tested against the bounding box first."""

from __future__ import annotations

import random
from fractions import Fraction

from exposia.operators import spatial

SHAPE = "array<array<array<array<double>>>>"


def strictly_within(x, y, ring):
    """Even-odd rule over a closed ring in exact arithmetic; borders are outside."""
    px, py, odd = Fraction(x), Fraction(y), False
    for a, b in zip(ring, ring[1:]):
        (ax, ay), (bx, by) = map(Fraction, a), map(Fraction, b)
        turn = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if turn == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
            return False
        if (ay > py) != (by > py) and (turn > 0) == (by > ay):
            odd = not odd
    return odd


def test_regions_of_few_cells(spark):
    rng, regions, points = random.Random(3), [], []
    for k in range(40):
        cx, cy, r = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([0.2, 0.45, 1.4])
        ring = [[cx + rng.uniform(-r, r), cy + rng.uniform(-r, r)] for _ in range(rng.randrange(3, 7))]
        regions.append((f"r{k}", [*ring, ring[0]]))
        xs, ys = zip(*ring)
        points += [*ring, [min(xs), cy], [max(xs), cy], [cx, min(ys)], [cx, max(ys)], [cx, cy], [min(xs), min(ys)]]
    points += [[rng.uniform(-5, 5), rng.uniform(-5, 5)] for _ in range(300)] + [[None, 0.0], [0.0, None]]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, longitude double, latitude double")
    right = spark.createDataFrame([(i, [[ring]]) for i, ring in regions], f"rid string, geometry {SHAPE}")
    want = {(i, rid) for i, p in enumerate(points) if None not in p for rid, ring in regions if strictly_within(*p, ring)}
    assert 150 < len(want)
    for small in (True, False, None):
        got = spatial.join_regions(left, right, region_id="rid", cell=1.0, small=small)
        assert got.columns == ["id", "longitude", "latitude", "rid"]
        found = [(r.id, r.rid) for r in got.collect()]
        assert {f for f in found if f[1]} == want and len({i for i, _ in found}) == len(points)
        assert len(found) == len(want) + len(points) - len({i for i, _ in want})

    cells = spatial.region_cells(spatial.region_outlines(right, "rid"), "rid", 1.0).collect()
    sides = {rid: [f([p[k] for p in ring]) for k in (0, 1) for f in (min, max)] for rid, ring in regions}
    edges = {rid: len(ring) for rid, ring in regions}
    per_region = {rid: [c for c in cells if c.rid == rid] for rid, _ in regions}
    few = [rid for rid, own in per_region.items() if len(own) <= spatial.WHOLE_CELLS and sides[rid][1] - sides[rid][0] < 1 and sides[rid][3] - sides[rid][2] < 1]
    assert len(few) > 15
    for rid in few:  # the closing edge of a closed ring has no length
        assert all(not c._inner and len(c._edges) == edges[rid] for c in per_region[rid])
    for c in cells:
        assert c._inner or [c._box.xmin, c._box.xmax, c._box.ymin, c._box.ymax] == sides[c.rid]
