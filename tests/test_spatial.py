import json
import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from helpers import config
from pyspark.sql import functions as F

from skywait import catalogue
from skywait.operators import spatial
from skywait.plans import stages
from skywait.sources import catalogue_items, tables

RINGS = "id int, ring array<array<double>>"


def plain_area(ring):
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def plain_clip(ring, window):
    """The part of a ring inside a convex window, edge by edge."""
    out = [tuple(p[:2]) for p in ring]
    if out and out[0] == out[-1]:
        out.pop()
    w = [tuple(p[:2]) for p in window]
    if w[0] == w[-1]:
        w.pop()
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(w, w[1:] + w[:1], strict=True))
    w = w if turn > 0 else w[::-1]
    for a, b in zip(w, w[1:] + w[:1], strict=True):
        def side(p, a=a, b=b):
            return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

        kept = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                kept.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def polygon(rng, x, y, r, n, convex=False):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [[x + (r if convex else rng.uniform(0.3, 1) * r) * math.cos(a), y + (r if convex else rng.uniform(0.3, 1) * r) * math.sin(a)] for a in angles]
    ring = ring[::-1] if rng.random() < 0.5 else ring
    return [*ring, ring[0]] if rng.random() < 0.5 else ring


def plain_pairs(shapes, windows):
    out = {}
    for a, s in shapes:
        for b, w in windows:
            area = plain_area(np.array(w if w[0] != w[-1] else w[:-1]))
            part = plain_clip(s, w) if s and len(s) > 2 else []
            share = plain_area(part) / area if len(part) else 0.0
            if share > 1e-12:
                out[a, b] = min(1.0, share)
    return out


@pytest.mark.parametrize("cell", [0.7, 3.0, 500.0])
def test_the_join_equals_all_pairs(spark, cell):
    rng = random.Random(3)
    shapes = [(k, polygon(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.5, 2, 9]), rng.randint(3, 9))) for k in range(60)] + [(900, None), (901, []), (902, [[0.0, 0.0], [1.0, 1.0]])]
    windows = [(k, polygon(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([1, 4]), rng.randint(3, 6), convex=True)) for k in range(40)]
    shapes += [(1000, windows[0][1]), (1001, [[-50.0, -50.0], [50.0, -50.0], [50.0, 50.0], [-50.0, 50.0]])]
    a = spark.createDataFrame(shapes, RINGS).withColumnsRenamed({"id": "a", "ring": "shape"})
    b = spark.createDataFrame(windows, RINGS).withColumnsRenamed({"id": "b", "ring": "window"})
    joined = spatial.overlapping(a, b, "shape", "window", cell)
    rows = joined.select("a", "b", "overlap").where("overlap > 1e-12").collect()
    want = plain_pairs(shapes, windows)
    assert len(rows) == len({(r.a, r.b) for r in rows}) and {(r.a, r.b) for r in rows} == set(want)
    assert all(r.overlap == pytest.approx(want[r.a, r.b], abs=1e-9) for r in rows) and len(want) > 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def corners(rng, left, low, right, high):
    """A box as a ring from any corner, either way round, closed or not."""
    ring = [[left, low], [right, low], [right, high], [left, high]]
    k = rng.randrange(4)
    ring = (ring[k:] + ring[:k])[:: rng.choice([1, -1])]
    return [*ring, ring[0]] if rng.random() < 0.5 else ring


def test_the_bounds_of_boxes_tell_their_share(spark):
    rng = random.Random(8)
    sides = {k: (x := rng.uniform(-9, 9), y := rng.uniform(-9, 9), x + rng.uniform(0.1, 6), y + rng.uniform(0.1, 6)) for k in range(80)}
    sides[80] = (3.0, -9.0, 3.0, 9.0)  # no area
    rings = [(k, corners(rng, *b)) for k, b in sides.items()]
    others = [(100 + k, polygon(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), 3, rng.randint(3, 5), convex=True)) for k in range(20)]
    others.append((120, [[-2.0, -2.0], [2.0, -2.0], [2.0, 2.0], [-2.0, 1.0]]))  # four corners, no box
    a = spark.createDataFrame(rings + others, RINGS).withColumnsRenamed({"id": "a", "ring": "shape"})
    windows = [(k, corners(rng, *b)) for k, b in sides.items() if k < 40] + others
    b = spark.createDataFrame(windows, RINGS).withColumnsRenamed({"id": "b", "ring": "window"})
    joined = spatial.overlapping(a, b, "shape", "window", 2.0).select("a", "b", "overlap")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()  # pairs are dealt by cells, however small the sides
    rows = joined.collect()
    found = {(r.a, r.b): r.overlap for r in rows}
    want = {}
    for k, s in sides.items():
        for n, w in sides.items():
            dx, dy = min(s[2], w[2]) - max(s[0], w[0]), min(s[3], w[3]) - max(s[1], w[1])
            if n < 40 and dx > 0 and dy > 0:
                want[k, n] = dx * dy / ((w[2] - w[0]) * (w[3] - w[1]))
    assert len(rows) == len(found) and {p: x for p, x in found.items() if max(p) < 100} == want  # to the last bit
    mixed = {p: x for p, x in plain_pairs(rings + others, windows).items() if max(p) >= 100}
    assert {p for p, x in found.items() if max(p) >= 100 and x > 1e-12} == set(mixed) and len(mixed) > 100
    assert all(found[p] == pytest.approx(x, abs=1e-9) for p, x in mixed.items())


def test_a_pair_is_clipped_once(spark):
    df = spark.createDataFrame([], "shape array<array<double>>, window array<array<double>>")
    planned = df.select(spatial.overlap_fraction(F.col("window"), F.col("shape")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert planned.count("flatten(") == 1  # its area once read it four times


def test_footprints_cover_places_of_any_nation(spark, tmp_path):
    customers, suppliers = [*range(0, 4000, 3), 10**9 + 7, None, 6], [(k, k % 3) for k in range(0, 1500, 5)] + [(1135, None), (8, 99), (None, 1)]
    spark.createDataFrame([(k,) for k in customers], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, f"n{k}", n) for k, n in suppliers], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k, f"n{k}") for k in range(3)], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    want = []
    for c in (c for c in customers if c is not None):
        x, y, dx, dy = c * 13 % 3500 / 10.0 - 175, c * 7 % 1500 / 10.0 - 75, 2 + c % 4, 1 + c % 3
        for s in (s for s, _ in suppliers if s is not None):
            lat, lon = float(s % 160 - 80), float(s * 7 % 360 - 180)
            if x - dx < lon + 1 and x + dx > lon - 1 and y - dy < lat + 1 and y + dy > lat - 1:
                want.append((c, f"s{s}", round((min(x + dx, lon + 1) - max(x - dx, lon - 1)) * (min(y + dy, lat + 1) - max(y - dy, lat - 1)) / 4, 6)))
    rows = catalogue.footprint_overlap(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(want) and "s8" in {r.aoi_id for r in rows}


def test_a_large_shape_is_dealt_to_many_cells(spark):
    big = spark.createDataFrame([(1, [[0.0, 0.0], [30.0, 0.0], [30.0, 10.0], [0.0, 10.0]])], RINGS)
    assert spatial.in_cells(big, "ring", 1.0).count() == 31 * 11


def test_areas_and_their_absence(spark):
    flat = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]
    unit = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    df = spark.createDataFrame([(unit, flat)], "u array<array<double>>, f array<array<double>>")
    assert df.select(spatial.ring_area(F.col("u")), spatial.overlap_fraction(F.col("u"), F.col("f"))).first() == (1.0, 0.0)
    with pytest.raises(Exception, match="no area"):
        df.select(spatial.overlap_fraction(F.col("f"), F.col("u"))).collect()


def test_discovery_of_items_without_a_tag(spark, tmp_path):
    data = str(tmp_path / "data")
    (tmp_path / "c.csv").write_text("aoi_id,name,country,lat,lon\nberlin,Berlin,Germany,52.52,13.405\nparis,Paris,France,48.85,2.35\n")
    stages.build_aois(spark, str(tmp_path / "c.csv"), data)

    def item(name, box, day):
        x, y, dx, dy = box
        ring = [[x, y], [x + dx, y], [x + dx, y + dy], [x, y + dy], [x, y]]
        return {"id": name, "type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"datetime": f"2025-03-{day:02d}T10:00:00Z"}, "assets": {}}

    found = [item("both", (0, 45, 20, 10), 1), item("west", (2, 48, 1, 1), 2), item("east half", (13.405, 50, 3, 5), 3), item("sea", (-30, 0, 1, 1), 4)]
    (tmp_path / "i.json").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    cfg = config(aois=("berlin", "paris"), data_dir=data, start=date(2025, 1, 1), end=date(2025, 12, 31))
    counts = stages.discover(spark, cfg, catalogue_items.read_items(spark, str(tmp_path / "i.json")), data, now=datetime(2025, 7, 1))
    assert {r.aoi_id: r.fetched for r in counts.collect()} == {"berlin": 2, "paris": 2}
    links = {(r.aoi_id, r.scene_id): r.footprint_overlap_fraction for r in tables.read_or_empty(spark, data, "scene_aoi").collect()}
    assert set(links) == {("berlin", "both"), ("paris", "both"), ("paris", "west"), ("berlin", "east half")}
    assert links["berlin", "both"] == 1 and links["berlin", "east half"] == pytest.approx(0.5, abs=0.02)
