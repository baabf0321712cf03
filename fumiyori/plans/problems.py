"""Queries of the general training-data problems (6 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fumiyori.operators.orphans import Reference, find_orphans, orphan_report
from fumiyori.operators.proximity import near_and_inside
from fumiyori.session import read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at most 500 m apart, and the areas that contain each place."""
    return near_and_inside(read_table(spark, sf_dir, "place_masters"), read_table(spark, sf_dir, "admin_areas"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling and late references of works and mentions."""
    t = lambda name: read_table(spark, sf_dir, name)
    works, mentions = t("works"), t("sentence_places")
    return find_orphans(
        [
            Reference("works", works, "work_id", "author_id", "authors", t("authors"), "author_id"),
            Reference("sentence_places", mentions, "relation_id", "sentence_id", "sentences", t("sentences"), "sentence_id"),
            Reference("sentence_places", mentions, "relation_id", "master_id", "place_masters", t("place_masters"), "master_id"),
        ],
        t("deleted_records"),
    )


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans counted by table, column, month and reason."""
    return orphan_report(p7_found(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_report": p7_report}

_P7 = """
WITH refs AS (
    SELECT 'works' AS table_name, 'author_id' AS column_name, 'authors' AS parent, work_id AS row_id, author_id AS k, created_at FROM works
    UNION ALL SELECT 'sentence_places', 'sentence_id', 'sentences', relation_id, sentence_id, created_at FROM sentence_places
    UNION ALL SELECT 'sentence_places', 'master_id', 'place_masters', relation_id, master_id, created_at FROM sentence_places
), parents AS (
    SELECT 'authors' AS parent, author_id AS k, min(created_at) AS at FROM authors GROUP BY 2
    UNION ALL SELECT 'sentences', sentence_id, min(created_at) FROM sentences GROUP BY 2
    UNION ALL SELECT 'place_masters', master_id, min(created_at) FROM place_masters GROUP BY 2
), gone AS (SELECT DISTINCT table_name AS parent, record_id AS k FROM deleted_records),
found AS (
    SELECT DISTINCT r.table_name, r.column_name, r.row_id,
           coalesce(strftime(r.created_at AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period,
           CASE WHEN p.k IS NULL AND g.k IS NULL THEN 'missing' WHEN p.k IS NULL THEN 'deleted' WHEN p.at > r.created_at THEN 'late' END AS reason
    FROM refs r LEFT JOIN parents p USING (parent, k) LEFT JOIN gone g USING (parent, k)
    WHERE r.k IS NOT NULL
)
"""

ORACLES = {
    "p6_found": """
WITH points AS (
    SELECT DISTINCT master_id AS id, latitude AS lat, longitude AS lon FROM place_masters
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)
      AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)
), near AS (
    SELECT a.id AS left_id, b.id AS right_id FROM points a JOIN points b
      ON a.id < b.id AND b.lat BETWEEN a.lat - 0.005 AND a.lat + 0.005
    WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
          + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 500.0
), corners AS (
    SELECT area_id, generate_subscripts(c, 1) AS i, unnest(c) AS xy
    FROM (SELECT area_id, regexp_extract_all(boundary_wkt, '-?[0-9.]+ -?[0-9.]+') AS c FROM admin_areas)
), xy AS (
    SELECT area_id, i, split_part(xy, ' ', 1)::DOUBLE AS x, split_part(xy, ' ', 2)::DOUBLE AS y FROM corners
), edges AS (
    SELECT a.area_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM xy a JOIN xy b ON a.area_id = b.area_id AND b.i = a.i + 1
), met AS (
    SELECT p.id, e.area_id,
           CASE WHEN (e.y1 <= p.lat) <> (e.y2 <= p.lat) AND p.lon < e.x1 + (p.lat - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) THEN 1 ELSE 0 END AS c,
           CASE WHEN p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)
                 AND abs((e.x2 - e.x1) * (p.lat - e.y1) - (e.y2 - e.y1) * (p.lon - e.x1)) <= 1e-12 THEN 1 ELSE 0 END AS b
    FROM points p CROSS JOIN edges e
)
SELECT 'near' AS kind, left_id, right_id FROM near
UNION ALL
SELECT 'inside', id, area_id FROM met GROUP BY id, area_id HAVING sum(c) % 2 = 1 OR max(b) = 1
""",
    "p7_found": _P7 + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p7_report": _P7 + "SELECT table_name, column_name, period, reason, count(*) AS n_references FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
