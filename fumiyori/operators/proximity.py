"""Points near other points, and points in polygons, without all-pairs joins.

*Near*: latitude is cut into strips as high as the search radius and every strip into
cells at least as wide; a point meets only cells that its circle can touch. Cells that
hold more than :data:`CELL_CAP` points are divided among several tasks.

*Inside*: polygon edges are cut into latitude strips, and every strip into longitude bins;
an edge goes to the bins from its area's west end in the strip to its own east end, so a
point meets only the edges to its east of areas that reach its bin. It lies inside if an odd
number of them crosses the ray to its east. Points that lie on an edge or a corner belong to
the area (a closed polygon), which is decided apart from the crossings.

Defined results
---------------
* Only rows with two present, numeric coordinates within ±90 and ±180, not both 0,
  are points. Rows with a null id are no points; repeated rows count once.
* Areas with null or unreadable outlines contain nothing; a repeated area id counts
  the edges of each distinct outline apart. The parts of a MULTIPOLYGON count as one area.
* Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumiyori.operators.sizing import broadcast_if_small

EARTH_RADIUS_M = 6_371_008.8
#: Points of a cell that one task pairs with its probes; a larger cell is divided, not cut off.
CELL_CAP = 2_000
#: Height in degrees of the latitude strips of polygon edges, and width of their longitude bins.
EDGE_STRIP_DEG, EDGE_BIN_DEG = 0.25, 1.0


def points_of(df: DataFrame, id_col: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``id, lat, lon`` of the rows that have a point."""
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    valid = F.col(id_col).isNotNull() & y.isNotNull() & x.isNotNull() & ~F.isnan(y) & ~F.isnan(x)
    return (
        df.where(valid & (F.abs(y) <= 90) & (F.abs(x) <= 180) & ~((y == 0) & (x == 0)))
        .select(F.col(id_col).cast("long").alias("id"), y.alias("lat"), x.alias("lon"))
        .distinct()
    )


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _cells_in(strip: Column, height: float) -> Column:
    """Number of cells of a strip, each at least as wide as the radius."""
    edge = F.least(F.lit(math.pi / 2), F.radians(F.greatest(F.abs(strip), F.abs(strip + 1)) * F.lit(height)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(edge) / F.lit(height))).cast("long")


def near_pairs(points: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """Pairs ``left_id < right_id`` of points at most ``radius_m`` apart."""
    angle = radius_m / EARTH_RADIUS_M
    height = math.degrees(angle) * (1 + 1e-9)
    strip = F.floor(F.col("lat") / F.lit(height)).cast("long")
    cell = lambda lon, s: F.floor((lon + F.lit(180.0)) / F.lit(360.0) * _cells_in(s, height)).cast("long")

    located = points.withColumn("strip", strip).withColumn("cell", F.least(cell(F.col("lon"), F.col("strip")), _cells_in(F.col("strip"), height) - 1))
    full = located.groupBy("strip", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_CAP)
    parts = full.select("strip", "cell", F.ceil(F.col("n") / CELL_CAP).cast("int").alias("parts"))
    targets = (
        located.join(parts, ["strip", "cell"], "left")
        .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
        .select("strip", "cell", "part", F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    )

    # A probe looks into its own strip and the one above; each pair is met exactly once.
    reach = F.cos(F.radians(F.least(F.abs(F.col("lat")) + F.lit(height), F.lit(90.0))))
    spread = F.when(reach > F.lit(math.sin(angle)), F.degrees(F.asin(F.lit(math.sin(angle)) / reach)) * F.lit(1 + 1e-9)).otherwise(F.lit(180.0))
    n = _cells_in(F.col("at"), height)
    raw = lambda lon: F.floor((lon + F.lit(180.0)) / F.lit(360.0) * n).cast("long")
    low, high = raw(F.col("lon") - F.col("spread")), raw(F.col("lon") + F.col("spread"))
    wanted = F.when(high - low + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array_distinct(F.transform(F.sequence(low, high), lambda c: F.pmod(c, n))))
    probes = (
        located.select("id", "lat", "lon", spread.alias("spread"), F.col("strip").alias("home"), F.explode(F.array(F.col("strip"), F.col("strip") + 1)).alias("at"))
        .withColumn("cell", F.explode(wanted))
        .withColumnRenamed("at", "strip")
        .join(parts, ["strip", "cell"], "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    )
    met = probes.join(targets, ["strip", "cell", "part"]).where((F.col("home") < F.col("strip")) | (F.col("id") < F.col("id_b")))
    return (
        met.where((F.col("id") != F.col("id_b")) & (haversine_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) <= F.lit(radius_m)))
        .select(F.least("id", "id_b").alias("left_id"), F.greatest("id", "id_b").alias("right_id"))
    )


def polygon_edges(areas: DataFrame, id_col: str = "area_id", wkt: str = "boundary_wkt") -> DataFrame:
    """Edges ``area_id, x1, y1, x2, y2`` of POLYGON and MULTIPOLYGON outlines (rings with holes too)."""
    rings = areas.where(F.col(id_col).isNotNull() & F.col(wkt).rlike(r"(?i)^\s*(?:MULTI)?POLYGON\s*\(")).select(
        F.col(id_col).cast("long").alias("area_id"), F.explode(F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), 1)).alias("ring")
    ).distinct()
    corner = lambda t: F.transform(F.split(F.trim(t), r"\s+"), lambda c: c.try_cast("double"))
    corners = rings.select("area_id", F.transform(F.split("ring", r"\s*,\s*"), corner).alias("c"))
    edges = corners.select("area_id", F.posexplode(F.transform(F.slice("c", 2, F.size("c") - 1), lambda b, i: F.struct(F.get("c", i).alias("a"), b.alias("b")))).alias("i", "e"))
    return edges.select(
        "area_id",
        F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"),
    )


def inside_areas(points: DataFrame, areas: DataFrame, strip_deg: float = EDGE_STRIP_DEG, bin_deg: float = EDGE_BIN_DEG) -> DataFrame:
    """``id, area_id`` of every closed polygon that contains the point."""
    spark = points.sparkSession
    cut = F.sequence(F.floor(F.least("y1", "y2") / strip_deg).cast("long"), F.floor(F.greatest("y1", "y2") / strip_deg).cast("long"))
    in_bin = lambda x: F.floor(x / bin_deg).cast("long")
    stripped = polygon_edges(areas).withColumn("strip", F.explode(cut))
    west = stripped.groupBy("area_id", "strip").agg(F.min(F.least("x1", "x2")).alias("west"))
    binned = stripped.join(west, ["area_id", "strip"]).withColumn("bin", F.explode(F.sequence(in_bin(F.col("west")), in_bin(F.greatest("x1", "x2"))))).drop("west")
    # Edges are few where areas are few; a large set of outlines falls back to a shuffle join by strip and bin.
    edges = broadcast_if_small(binned)
    placed = points.withColumns({"strip": F.floor(F.col("lat") / strip_deg).cast("long"), "bin": in_bin(F.col("lon"))})
    return spark.sql(
        """
        WITH met AS (
            SELECT p.id, e.area_id,
                   -- half-open in latitude, so a corner is counted by one of its two edges
                   CASE WHEN (e.y1 <= p.lat) <> (e.y2 <= p.lat)
                         AND p.lon < e.x1 + (p.lat - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) THEN 1 ELSE 0 END AS crosses,
                   CASE WHEN p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                         AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)
                         AND abs((e.x2 - e.x1) * (p.lat - e.y1) - (e.y2 - e.y1) * (p.lon - e.x1)) <= 1e-12 THEN 1 ELSE 0 END AS on_edge
            FROM {points} p JOIN {edges} e ON p.strip = e.strip AND p.bin = e.bin
            WHERE p.lon <= greatest(e.x1, e.x2)
        )
        SELECT id, area_id FROM met WHERE crosses = 1 OR on_edge = 1
        GROUP BY id, area_id
        HAVING sum(crosses) % 2 = 1 OR max(on_edge) = 1
        """,
        points=placed,
        edges=edges,
    )


def near_and_inside(places: DataFrame, areas: DataFrame, id_col: str = "master_id", radius_m: float = 500.0) -> DataFrame:
    """``kind, left_id, right_id``: near pairs and containing areas in one result."""
    points = points_of(places, id_col)
    near = near_pairs(points, radius_m).select(F.lit("near").alias("kind"), "left_id", "right_id")
    inside = inside_areas(points, areas).select(F.lit("inside").alias("kind"), F.col("id").alias("left_id"), F.col("area_id").cast("long").alias("right_id"))
    return near.unionByName(inside)
