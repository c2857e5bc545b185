"""Point, polygon, neighbour, density and cluster queries on embedded points."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions import geo as E
from panelyard.operators import hotspots as H
from panelyard.operators import spatial as S
from panelyard.plans.inputs import r6
from panelyard.plans.registry import query, table


def points(spark, d):
    """Embedding dimensions 0 and 1 as coordinates near the zone's meridian, rounded to 4 decimals."""
    e = table(spark, d, "embeddings")
    return e.select(
        "vec_id", "label", F.round(F.col("embedding")[0].cast("double") * 5 + 37, 4).alias("lon"),
        F.round(F.col("embedding")[1].cast("double") * 5 - 1, 4).alias("lat"),
    )


POINTS = """
pts AS (SELECT vec_id, label, round(embedding[1]::DOUBLE * 5 + 37, 4) AS lon, round(embedding[2]::DOUBLE * 5 - 1, 4) AS lat FROM embeddings)"""


def raw_points(spark, d):
    """Points as text with missing, non-numeric and out-of-range values."""
    n = F.col("vec_id") % 11
    lon = F.when(n == 1, F.lit(None)).when(n == 2, F.lit("east of town")).when(n == 3, F.lit("200.5")).otherwise(F.col("lon").cast("string"))
    return points(spark, d).select("vec_id", lon.alias("lon"), F.col("lat").cast("string").alias("lat"))


@query(
    "geo_validity",
    """SELECT CASE vec_id % 11 WHEN 1 THEN 'missing' WHEN 2 THEN 'non_numeric' WHEN 3 THEN 'out_of_range' ELSE 'ok' END AS coord_status,
       count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY 1""",
)
def geo_validity(spark, d):
    return E.coordinate_report(raw_points(spark, d), "lon", "lat").withColumn("share", F.round("share", 6))


def label_boxes(spark, d):
    """One pentagon per label around the mean of its points, so that areas overlap."""
    means = points(spark, d).groupBy("label").agg(F.round(F.avg("lon"), 3).alias("mx"), F.round(F.avg("lat"), 3).alias("my"))
    corners = [(-0.55, -0.4), (0.6, -0.45), (0.9, 0.1), (0.05, 0.8), (-0.7, 0.35)]
    ring = F.array(
        *[F.struct((F.col("mx") + dx).alias("x"), (F.col("my") + dy).alias("y")) for dx, dy in corners]
    )
    return means.select(
        F.col("label").cast("string").alias("area_id"), F.lit("C").alias("County"), F.col("label").alias("SubCounty"), F.lit(0).alias("ring"),
        ring.alias("points"),
    )


BOXES = """
means AS (SELECT label, round(avg(lon), 3) AS mx, round(avg(lat), 3) AS my FROM pts GROUP BY 1),
corners(i, dx, dy) AS (VALUES (0, -0.55, -0.4), (1, 0.6, -0.45), (2, 0.9, 0.1), (3, 0.05, 0.8), (4, -0.7, 0.35)),
edges AS (SELECT label, mx + a.dx::DOUBLE AS x1, my + a.dy::DOUBLE AS y1, mx + b.dx::DOUBLE AS x2, my + b.dy::DOUBLE AS y2
  FROM means, corners a JOIN corners b ON b.i = (a.i + 1) % 5)"""


@query(
    "point_in_polygon",
    f"""WITH {POINTS}, {BOXES}, inside AS (
      SELECT vec_id, e.label AS joined_subcounty FROM pts p JOIN edges e ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
      GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT p.vec_id, i.joined_subcounty FROM pts p LEFT JOIN inside i ON i.vec_id = p.vec_id""",
)
def point_in_polygon(spark, d):
    located = S.locate_points(points(spark, d), label_boxes(spark, d), "lon", "lat")
    return located.select("vec_id", "joined_subcounty")


@query(
    "utm_project",
    """WITH c AS (SELECT 1 / 298.257223563 AS f), n AS (SELECT f / (2 - f) AS n FROM c),
    k AS (SELECT n, 0.9996 * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, 2 * sqrt(n) / (1 + n) AS ecc,
      n / 2 - 2.0 / 3 * n ** 2 + 5.0 / 16 * n ** 3 + 41.0 / 180 * n ** 4 AS a1, 13.0 / 48 * n ** 2 - 3.0 / 5 * n ** 3 + 557.0 / 1440 * n ** 4 AS a2,
      61.0 / 240 * n ** 3 - 103.0 / 140 * n ** 4 AS a3, 49561.0 / 161280 * n ** 4 AS a4 FROM n),
    """ + POINTS.strip() + """,
    g AS (SELECT vec_id, k.*, radians(lon - 39) AS l, sinh(atanh(sin(radians(lat))) - ecc * atanh(ecc * sin(radians(lat)))) AS t FROM pts, k),
    h AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM g)
    SELECT vec_id,
      round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) AS easting,
      round(10000000 + r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) AS northing
    FROM h""",
)
def utm_project(spark, d):
    projected = E.with_utm(points(spark, d), "lon", "lat")
    return projected.select("vec_id", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query(
    "knn_edges",
    f"""WITH {POINTS}, p AS (SELECT a.vec_id, b.vec_id AS neighbor, sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) AS distance
      FROM pts a JOIN pts b ON a.vec_id <> b.vec_id)
    SELECT vec_id, neighbor, round(distance, 6) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS rank
    FROM p QUALIFY rank <= 4""",
)
def knn_edges(spark, d):
    edges = S.nearest(points(spark, d), "vec_id", "lon", "lat", 4)
    return edges.withColumn("distance", F.round("distance", 6))


GETIS = f"""{POINTS},
v AS (SELECT vec_id, lon, lat, label + 1.0 + abs(lat) AS value FROM pts),
p AS (SELECT a.vec_id, b.value AS nv, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2), b.vec_id) AS rk
  FROM v a JOIN v b ON a.vec_id <> b.vec_id),
l AS (SELECT vec_id, sum(nv) AS s FROM p WHERE rk <= 4 GROUP BY 1),
t AS (SELECT count(*)::DOUBLE AS n, sum(value) AS s, sum(value * value) AS q FROM v)"""


def valued(spark, d):
    return points(spark, d).withColumn("value", F.col("label") + 1.0 + F.abs("lat"))


@query(
    "getis_ord",
    f"""WITH {GETIS}, m AS (SELECT v.vec_id, value, l.s / 4 AS lag, (t.s - value) / (n - 1) AS mean, (t.q - value * value) / (n - 1) AS sq, n - 1 AS size
      FROM v JOIN l ON l.vec_id = v.vec_id, t)
    SELECT vec_id, round(lag, 6) AS lag, round((lag - mean) / (sqrt(sq - mean * mean) * sqrt((size / 4 - 1) / (size - 1))), 6) AS z FROM m""",
)
def getis_ord(spark, d):
    return H.getis_ord(valued(spark, d), "vec_id", "lon", "lat", "value").select("vec_id", r6("lag"), r6("z"))


@query(
    "getis_ord_star",
    f"""WITH {GETIS}, m AS (SELECT v.vec_id, (l.s + value) / 5 AS lag, t.s / n AS mean, t.q / n AS sq, n FROM v JOIN l ON l.vec_id = v.vec_id, t)
    SELECT vec_id, round(lag, 6) AS lag, round((lag - mean) / (sqrt(sq - mean * mean) * sqrt((n / 5 - 1) / (n - 1))), 6) AS z FROM m""",
)
def getis_ord_star(spark, d):
    return H.getis_ord(valued(spark, d), "vec_id", "lon", "lat", "value", star=True).select("vec_id", r6("lag"), r6("z"))


@query("hotspots")
def hotspots(spark, d):
    return H.hotspots(valued(spark, d), "vec_id", "lon", "lat", "value")


@query(
    "kde_surface",
    f"""WITH {POINTS},
    f AS (SELECT count(*)::DOUBLE AS n, min(lon) - 0.1 AS x0, max(lon) + 0.1 AS x1, min(lat) - 0.1 AS y0, max(lat) + 0.1 AS y1,
      var_samp(lon) * count(*) ** (-1.0 / 3) AS a, covar_samp(lon, lat) * count(*) ** (-1.0 / 3) AS b, var_samp(lat) * count(*) ** (-1.0 / 3) AS c FROM pts),
    g AS (SELECT i.range AS gx, j.range AS gy, x0 + (x1 - x0) * i.range / 99 AS lon, y0 + (y1 - y0) * j.range / 99 AS lat, n, a, b, c, a * c - b * b AS det
      FROM f, range(100) i, range(100) j)
    SELECT gx, gy, round(g.lon, 6) AS lon, round(g.lat, 6) AS lat,
      round(sum(exp(-0.5 * (c * (g.lon - p.lon) ** 2 - 2 * b * (g.lon - p.lon) * (g.lat - p.lat) + a * (g.lat - p.lat) ** 2) / det))
            / (any_value(n) * 2 * pi() * sqrt(any_value(det))), 6) AS density
    FROM g, pts p GROUP BY gx, gy, g.lon, g.lat""",
)
def kde_surface(spark, d):
    return S.kde_surface(points(spark, d), "lon", "lat").select("gx", "gy", r6("lon"), r6("lat"), r6("density"))


@query("dbscan_clusters")
def dbscan_clusters(spark, d):
    return S.dbscan(raw_points(spark, d), "vec_id", "lon", "lat", eps_km=12.0, min_points=4)


@query(
    "distance_pairs",
    f"""WITH {POINTS.strip()} SELECT p.vec_id AS a, q.vec_id AS b, round(sqrt(pow(p.lon - q.lon, 2) + pow(p.lat - q.lat, 2)), 6) AS distance
    FROM pts p JOIN pts q ON p.vec_id < q.vec_id WHERE sqrt(pow(p.lon - q.lon, 2) + pow(p.lat - q.lat, 2)) <= 0.05""",
)
def distance_pairs(spark, d):
    return S.within_distance(points(spark, d), "vec_id", "lon", "lat", 0.05).select("a", "b", r6("distance"))
