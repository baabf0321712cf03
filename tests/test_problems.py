"""Orphans and proximity on edge cases, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fumiyori.operators.orphans import Reference, find_orphans, key_runs, match_runs, orphan_report
from fumiyori.operators.proximity import inside_areas, near_and_inside, near_pairs, points_of


def orphans(spark, children, parents, deletions):
    child = spark.createDataFrame(children, "id long, ref long, created_at timestamp, parent string, reason string")
    parent = spark.createDataFrame(parents, "key long, created_at timestamp, table_name string")
    gone = spark.createDataFrame(deletions, "table_name string, record_id long")
    return {tuple(r) for r in find_orphans([Reference("c", child, "id", "ref", "p", parent, "key")], gone).collect()}


def day(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_orphans_reasons(spark):
    children = [(1, 10, day(5), "x", "y"), (2, 11, day(5), None, None), (3, 12, None, None, None), (4, 13, day(40), None, None), (5, None, day(1), None, None), (6, 14, day(1), None, None), (6, 14, day(1), None, None), (7, 70_000, day(2), None, None), (8, -5, day(2), None, None), (9, 15, None, None, None)]
    parents = [(10, day(1), "c"), (13, None, "c"), (14, day(3), "c"), (15, day(3), "c"), (69_999, day(0), "c"), (None, day(0), "c"), (10, day(9), "c")]
    deletions = [("p", 12), ("p", 12), ("q", 11), ("p", 10), (None, None)]
    assert orphans(spark, children, parents, deletions) == {
        ("c", "ref", 2, "2024-01", "missing"), ("c", "ref", 3, "unknown", "deleted"), ("c", "ref", 6, "2024-01", "late"), ("c", "ref", 7, "2024-01", "missing"), ("c", "ref", 8, "2024-01", "missing"),
    }


def test_orphans_empty_tables(spark):
    assert orphans(spark, [], [], []) == set()
    assert orphans(spark, [(1, 2, day(0), None, None)], [], []) == {("c", "ref", 1, "2024-01", "missing")}


def test_orphan_report_counts(spark):
    rows = spark.createDataFrame([("c", "r", 1, "2024-01", "late"), ("c", "r", 2, "2024-01", "late")], "table_name string, column_name string, row_id long, period string, reason string")
    assert [tuple(r) for r in orphan_report(rows).collect()] == [("c", "r", "2024-01", "late", 2)]


def test_runs_match_membership(spark):
    random.seed(1)
    keys = {random.randint(0, 200_000) for _ in range(3000)} | set(range(65_500, 65_600))
    probes = [random.randint(-10, 200_010) for _ in range(2000)]
    runs = key_runs(spark.createDataFrame([(k,) for k in [*keys, *list(keys)[:50]]], "k long"), "k")
    got = match_runs(spark.createDataFrame([(p,) for p in set(probes)], "ref_key long"), runs, [])
    assert {r.ref_key for r in got.where("is_present").collect()} == keys & set(probes)


def distance(a, b):
    p, q = map(math.radians, (a[1], b[1]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("center", [(35.0, 139.0), (0.0, 0.0), (89.999, 10.0), (-89.998, 0.0), (10.0, 179.9999), (-45.0, -179.9995)])
def test_near_equals_brute_force(spark, center):
    random.seed(7)
    stretch = 1 / max(0.01, math.cos(math.radians(center[0])))
    points = []
    for i in range(150):
        lon = center[1] + random.uniform(-0.012, 0.012) * min(stretch, 6000)
        points.append((i, max(-90.0, min(90.0, center[0] + random.uniform(-0.012, 0.012))), (lon + 180) % 360 - 180))
    points += [(1000, *points[0][1:]), (1001, *points[0][1:])]
    got = {tuple(r) for r in near_pairs(spark.createDataFrame(points, "id long, lat double, lon double")).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and distance(a, b) <= 500}


def test_hot_cell_is_divided_not_cut(spark, monkeypatch):
    import fumiyori.operators.proximity as proximity

    monkeypatch.setattr(proximity, "CELL_CAP", 7)
    points = spark.range(60).select(F.col("id"), F.lit(35.0).alias("lat"), F.lit(139.0).alias("lon"))
    assert near_pairs(points).distinct().count() == 60 * 59 // 2 == near_pairs(points).count()


def test_points_and_areas_on_edge_cases(spark):
    nan = float("nan")
    rows = [(1, 35.0, 139.0, "a"), (2, None, 139.0, "a"), (3, 35.0, nan, "a"), (4, 0.0, 0.0, "a"), (5, 139.0, 35.0, "a"), (6, 35.0, 138.0, "a"), (7, 34.0, 138.5, "a"), (8, 34.5, 138.0, "a"), (None, 35.0, 139.0, "a"), (1, 35.0, 139.0, "a"), (9, 36.0, 140.0, "a"), (10, 34.5, 139.0, "a")]
    places = spark.createDataFrame(rows, "master_id long, latitude double, longitude double, area_id string")
    square = "POLYGON ((138 34, 140 34, 140 36, 138 36, 138 34))"
    hole = "POLYGON ((138 34, 140 34, 140 36, 138 36, 138 34), (138.9 34.9, 139.1 34.9, 139.1 35.1, 138.9 35.1, 138.9 34.9))"
    areas = spark.createDataFrame([(1, "s", square), (2, "h", hole), (3, "n", None), (4, "x", "POINT (1 2)"), (None, "z", square)], "area_id int, area_name string, boundary_wkt string")
    got = {tuple(r) for r in near_and_inside(places, areas).collect() if r.kind == "inside"}
    inside_1 = {1, 6, 7, 8, 9, 10}
    assert got == {("inside", i, 1) for i in inside_1} | {("inside", i, 2) for i in inside_1 - {1}}
    empty = places.where("false")
    assert near_and_inside(empty, areas).count() == 0 and inside_areas(points_of(places, "master_id"), areas.where("false")).count() == 0
