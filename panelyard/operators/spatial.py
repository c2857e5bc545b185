"""Point in polygon, nearest neighbours, density surface and density clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard import fixed_values as fv
from panelyard.functions.geo import in_utm_reach, with_coordinates, with_utm
from panelyard.operators.graph import connected_components
from panelyard.operators.hotkeys import crowd_join, spread_join
from panelyard.operators.ordering import numbered
from panelyard.session import checkpointed

# --- point in polygon ----------------------------------------------------------------------


def edge_table(rings: DataFrame) -> DataFrame:
    """Edges (area_id, x1, y1, x2, y2) of rings with a ``points`` array of (x, y); open rings are closed."""
    n = F.size("points")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.get(F.col("points"), i).alias("p"), F.get(F.col("points"), F.pmod(i + 1, n)).alias("q")),
    )
    spread = rings.filter(n > 2).select("area_id", F.explode(pairs).alias("e"))
    flat = spread.select(
        "area_id", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2")
    )
    return flat.filter("x1 <> x2 OR y1 <> y2")


def _cells(edges: DataFrame, cell: float) -> DataFrame:
    """For every grid cell of every polygon box: the edges that span the cell's row.

    A ray along x through a point of the row can only cross those edges, so a
    polygon with very many vertices costs a point only its row's share.
    """
    box = edges.groupBy("area_id").agg(
        F.min(F.least("x1", "x2")).alias("x_min"), F.max(F.greatest("x1", "x2")).alias("x_max")
    )
    rows = edges.withColumn(
        "cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell)))
    )
    bands = rows.groupBy("area_id", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    columns = F.sequence(F.floor(F.col("x_min") / cell), F.floor(F.col("x_max") / cell))
    return bands.join(box, "area_id").withColumn("cx", F.explode(columns)).select("area_id", "cx", "cy", "edges")


def _strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Odd number of crossings to the right, and not on an edge."""

    def crosses(e: Column) -> Column:
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        return F.when(e["y1"] == e["y2"], F.lit(False)).otherwise(((e["y1"] > y) != (e["y2"] > y)) & (x < at))

    def touches(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        in_box = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
            F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        )
        return (turn == 0) & in_box

    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)


def locate_points(
    df: DataFrame,
    rings: DataFrame,
    lon: str,
    lat: str,
    attributes: Sequence[str] = ("County", "SubCounty"),
    prefix: str = "joined",
    cell: float = 0.1,
) -> DataFrame:
    """Left join points to the polygons that strictly contain them.

    Points on a boundary are not inside; points in overlapping polygons give
    several rows; unmatched and unusable points stay with null attributes.
    Points meet polygon parts through their grid cell; the points of a crowded
    cell are spread over several tasks. Equal coordinates are located once, so a
    crowd at one spot costs one test.
    """
    checked = with_coordinates(df, lon, lat)
    spots = checked.filter("coord_status = 'ok'").select("lon_num", "lat_num").distinct()
    placed = spots.withColumns({"cx": F.floor(F.col("lon_num") / cell), "cy": F.floor(F.col("lat_num") / cell)})
    cells = checkpointed(_cells(edge_table(rings), cell))  # read for its counts and for the join
    hits = (
        spread_join(placed, cells, ["cx", "cy"], "area_id")
        .filter(_strictly_inside(F.col("lon_num"), F.col("lat_num"), F.col("edges")))
        .select("lon_num", "lat_num", "area_id")
    )
    named = rings.select("area_id", *attributes).distinct()
    found = hits.join(named, "area_id").select(
        "lon_num", "lat_num", *[F.col(a).alias(f"{prefix}_{a.lower()}") for a in attributes]
    )
    # unusable points skip the join: their null keys would all meet in one task
    usable = checked.filter("coord_status = 'ok'").join(found, ["lon_num", "lat_num"], "left")
    return usable.unionByName(checked.filter("coord_status <> 'ok'"), allowMissingColumns=True)


# --- nearest neighbours ----------------------------------------------------------------------

def nearest(points: DataFrame, key: str, x: str, y: str, k: int = 4, rows_per_cell: int = 2_000) -> DataFrame:
    """The k nearest other points of every point: (key, neighbor, distance, rank); ties by neighbor.

    Points of equal coordinates are one spot with its k + 1 smallest keys, which
    are all that anyone can take from it, so a crowd never meets itself. Spots
    look in the 3x3 cells around them. Whoever has k other spots within one cell
    width is done; the others look again in cells twice as wide. The first cell
    width is halved until no cell is overcrowded. Points without coordinates take
    no part.
    """
    base = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    spots = checkpointed(base.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    facts = spots.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spots"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n, extent = facts["n"] or 0, max((facts[3] or 0) - (facts[2] or 0), (facts[5] or 0) - (facts[4] or 0))
    if n < k + 1:
        raise ValueError(f"only {n} points; need at least {k + 1} for {k} neighbours")
    others = _nearest_spots(spots.select("id", "x", "y"), facts["spots"], extent, k, rows_per_cell)
    if n == facts["spots"]:  # every point is its own spot
        own = others.select(F.col("a").alias("_a"), F.col("best").alias("_own"))
    else:
        own = _own_neighbours(base, spots, others, n, k)
    return own.select(F.col("_a").alias(key), F.posexplode("_own").alias("at", "s")).select(
        key, F.col("s.b").alias("neighbor"), F.col("s.d").alias("distance"), (F.col("at") + 1).alias("rank")
    )


def _own_neighbours(base: DataFrame, spots: DataFrame, others: DataFrame, n: int, k: int) -> DataFrame:
    """(_a, _own) per point: its k nearest points among those of its spot and of the spots nearest to it."""
    first = Window.partitionBy("x", "y").orderBy("id")
    few = base.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    ids = few.groupBy("x", "y").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")).select("id", "ids")
    seen = others.select("a", F.explode("best").alias("s")).select("a", F.col("s.b").alias("id"), F.col("s.d").alias("d"))
    offers = seen.unionByName(spots.select(F.col("id").alias("a"), "id", F.lit(0.0).alias("d"))).join(ids, "id")
    best = _smallest(offers.select("a", "d", F.explode("ids").alias("b")).select("a", F.struct("d", "b").alias("s")), k + 1)
    per_spot = spots.select(F.col("id").alias("a"), F.struct("x", "y").alias("spot"), "n").join(best, "a").drop("a")
    met = crowd_join(base.select("id", F.struct("x", "y").alias("spot")), per_spot, "spot", "n", n)
    return met.select(F.col("id").alias("_a"), F.slice(F.filter("best", lambda s: s["b"] != F.col("id")), 1, k).alias("_own"))


def _nearest_spots(base: DataFrame, n: int, extent: float, k: int, rows_per_cell: int) -> DataFrame:
    """(a, best) with the k nearest other places, as structs (d, b); fewer where there are fewer."""
    width = max(extent, 1e-9) / max(math.sqrt(n / (k + 1)), 1.0)

    def celled(df: DataFrame, w: float) -> DataFrame:
        return df.withColumns({"cx": F.floor(F.col("x") / w), "cy": F.floor(F.col("y") / w)})

    for _ in range(20):
        crowd = celled(base, width).groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        if crowd <= rows_per_cell:
            break
        width /= 2
    open_points, done = base, None
    while True:
        last = width >= 2 * extent
        seekers = celled(open_points, width).withColumnsRenamed({"id": "a", "x": "ax", "y": "ay"})
        steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
        around = seekers.withColumn("cx", F.explode(F.transform(steps, lambda s: F.col("cx") + s))).withColumn(
            "cy", F.explode(F.transform(steps, lambda s: F.col("cy") + s))
        )
        pairs = spread_join(around, celled(base, width), ["cx", "cy"], "id").filter("a <> id")
        dist = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
        near = pairs.select("a", F.struct(dist.alias("d"), F.col("id").alias("b")).alias("s"))
        if not last:
            near = near.filter(F.col("s.d") <= width)
        top = _smallest(near, k)
        found = checkpointed(top.filter((F.size("best") >= k) | F.lit(last)))
        done = found if done is None else done.unionByName(found)
        if last:
            break
        open_points = checkpointed(open_points.join(found.select(F.col("a").alias("id")), "id", "left_anti"))
        if open_points.isEmpty():
            break
        width *= 2
    return done


def _smallest(near: DataFrame, k: int) -> DataFrame:
    """The k smallest structs ``s`` per ``a``; the rank limit is applied before the shuffle as well."""
    by_size = Window.partitionBy("a").orderBy("s")
    kept = near.withColumn("r", F.row_number().over(by_size)).filter(F.col("r") <= k)
    return kept.groupBy("a").agg(F.sort_array(F.collect_list("s")).alias("best"))


def within_distance(points: DataFrame, key: str, x: str, y: str, reach: float) -> DataFrame:
    """Pairs (a, b, distance), a before b, of points at most ``reach`` apart, in the units of x and y.

    Cells of side ``reach`` meet their neighbours; crowded cells are spread.
    Points without coordinates take no part.
    """
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cell = {"cx": F.floor(F.col(x) / reach), "cy": F.floor(F.col(y) / reach)}
    left = known.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay")).withColumns({k: F.floor(F.col(f"a{k[1]}") / reach) for k in cell})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = left.withColumn("o", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    right = known.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), *[c.alias(k) for k, c in cell.items()])
    met = spread_join(left, right, ["cx", "cy"], "b").filter("a < b")
    apart = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return met.select("a", "b", apart.alias("distance")).filter(F.col("distance") <= reach)


# --- density surface -------------------------------------------------------------------------

def kde_surface(df: DataFrame, lon: str, lat: str, grid_size: int = 100, bandwidth: str | float = "scott", margin: float = 0.1) -> DataFrame:
    """Gaussian density on a grid over the points' extent: (gx, gy, lon, lat, density).

    The kernel covariance is the sample covariance times factor^2, with factor
    n^(-1/6) for 'scott' ('silverman' is the same in two dimensions). Every
    task adds up its points on the whole grid, whose size is fixed, and only
    those grid sums are shuffled.
    """
    spots = with_coordinates(df, lon, lat).filter("coord_status = 'ok'").select("lon_num", "lat_num")
    f = spots.agg(
        F.count(F.lit(1)).alias("n"), F.min("lon_num").alias("x0"), F.max("lon_num").alias("x1"), F.min("lat_num").alias("y0"),
        F.max("lat_num").alias("y1"), F.var_samp("lon_num").alias("vx"), F.var_samp("lat_num").alias("vy"),
        F.covar_samp("lon_num", "lat_num").alias("vxy"),
    ).first()
    if f["n"] < 3:
        raise ValueError("a density surface needs at least three usable points")
    factor = f["n"] ** (-1.0 / 6.0) if bandwidth in ("scott", "silverman") else float(bandwidth)
    xs = np.linspace(f["x0"] - margin, f["x1"] + margin, grid_size)
    ys = np.linspace(f["y0"] - margin, f["y1"] + margin, grid_size)
    a, b, c = (v * factor * factor for v in (f["vx"], f["vxy"], f["vy"]))
    det = a * c - b * b
    if det <= 0:
        raise ValueError("the points lie on a line; no density surface")
    counted = spots.groupBy("lon_num", "lat_num").agg(F.count(F.lit(1)).alias("w"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((grid_size, grid_size))
        for batch in batches:
            points = batch.to_numpy(dtype=float)
            for block in np.array_split(points, -(-len(points) // 64)) if len(points) else ():
                dx, dy = (xs - block[:, :1])[:, None, :], (ys - block[:, 1:2])[:, :, None]
                kernel = np.exp(-0.5 / det * (c * dx * dx - 2 * b * dx * dy + a * dy * dy))
                total += np.tensordot(block[:, 2], kernel, axes=1)
        gy, gx = np.nonzero(total)
        yield pd.DataFrame({"gx": gx, "gy": gy, "z": total[gy, gx]})

    sums = counted.mapInPandas(add_up, "gx int, gy int, z double").groupBy("gx", "gy").agg(F.sum("z").alias("z"))
    cells = df.sparkSession.range(grid_size * grid_size).select(
        F.pmod("id", F.lit(grid_size)).cast("int").alias("gx"), F.floor(F.col("id") / grid_size).cast("int").alias("gy")
    )
    scale = 1.0 / (f["n"] * 2 * math.pi * math.sqrt(det))
    at = lambda first, last, i: F.lit(float(first)) + (F.lit(float(last)) - F.lit(float(first))) * F.col(i) / (grid_size - 1)
    return cells.join(sums, ["gx", "gy"], "left").select(
        "gx", "gy", at(xs[0], xs[-1], "gx").alias("lon"), at(ys[0], ys[-1], "gy").alias("lat"),
        (F.coalesce("z", F.lit(0.0)) * scale).alias("density"),
    )


# --- density clusters --------------------------------------------------------------------------

def dbscan(
    df: DataFrame,
    key: str,
    lon: str,
    lat: str,
    eps_km: float = fv.CLUSTER_EPS_KM,
    min_points: int = fv.CLUSTER_MIN_POINTS,
    zone: int = fv.UTM_ZONE,
) -> DataFrame:
    """DBSCAN on metres: (key, cluster); -1 noise, -2 unusable coordinates.

    Clusters are numbered by their smallest core ``key``; a border point takes
    the lowest cluster in reach, as with rows visited in key order.
    """
    checked = with_coordinates(df, lon, lat)
    reach = (F.col("coord_status") == "ok") & in_utm_reach(F.col("lon_num"), F.col("lat_num"), zone)
    flagged = checked.select(key, "lon_num", "lat_num", F.coalesce(reach, F.lit(False)).alias("_ok"))
    metric = with_utm(flagged.filter("_ok"), "lon_num", "lat_num", zone, x="x", y="y")
    points = metric.select(F.col(key).alias("id"), "x", "y")
    labels = planar_dbscan(points, eps_km * 1000.0, min_points)
    return flagged.join(labels.withColumnRenamed("id", key), key, "left").select(
        key, F.when(F.col("_ok"), F.coalesce("cluster", F.lit(-1))).otherwise(F.lit(-2)).cast("int").alias("cluster")
    )


def planar_dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """Exact DBSCAN of (id, x, y) through cells of side eps / sqrt(2).

    All points of a cell are within eps of each other, so a cell with
    ``min_points`` points is all core and one node of the cluster graph; its
    points never meet each other. Point pairs are only formed for points of
    thin cells (fewer than ``min_points`` each) and for those neighbouring
    dense cells whose boxes leave the question open.
    """
    side = eps / math.sqrt(2.0)
    celled = checkpointed(
        points.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    )
    sizes = celled.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n_cell"))
    sized = celled.join(sizes, ["cx", "cy"])
    thin = sized.filter(F.col("n_cell") < min_points)
    dense = sized.filter(F.col("n_cell") >= min_points)

    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])

    def reach(left: DataFrame, right: DataFrame) -> DataFrame:
        """Point pairs (a from ``left``, b from ``right``) within eps, right rows spread when crowded."""
        l = left.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", F.explode(offsets).alias("o"))
        l = l.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
        r = right.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy", *[c for c in right.columns if c in ("node", "component")])
        met = spread_join(l, r, ["cx", "cy"], "b")
        return met.filter(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= eps * eps)

    around = reach(thin, celled).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    thin_core = thin.join(around.filter(F.col("n") >= min_points).select("id"), "id", "left_semi")
    core = checkpointed(dense.unionByName(thin_core.select(*dense.columns)).select("id", "x", "y", "cx", "cy"))

    nodes = core.groupBy("cx", "cy").agg(F.min("id").alias("node"))
    cored = core.join(nodes, ["cx", "cy"])
    links = _cell_links(cored, eps, side, offsets)
    components = connected_components(nodes, links, "node")
    owned = cored.join(components, "node").select("id", "x", "y", "cx", "cy", "component")

    border = thin.join(core.select("id"), "id", "left_anti")
    tied = reach(border, owned).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
    member = owned.select("id", "component").unionByName(tied)
    order = numbered(components.select("component").distinct(), "component", "_no")
    return member.join(order, "component").select("id", (F.col("_no") - 1).cast("int").alias("cluster"))


def _cell_links(cored: DataFrame, eps: float, side: float, offsets: Column, levels: tuple[int, ...] = (1, 8, 64)) -> DataFrame:
    """Pairs of core cells with two core points within eps.

    Cells are compared through the boxes of their points in ever finer
    sub-cells: boxes that are surely close link the cells, boxes that are
    surely apart are dropped, and only what stays open goes to the next level,
    at last to the points.
    """
    found, open_cells = None, None
    near2, far2 = "near2", "far2"
    for level in levels:
        w = side / level
        sub = cored.withColumns({"sx": F.floor(F.col("x") / w), "sy": F.floor(F.col("y") / w)})
        boxes = sub.groupBy("node", "cx", "cy", "sx", "sy").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        )
        if open_cells is None:
            l = boxes.withColumnsRenamed({c: f"a_{c}" for c in ("node", "x0", "x1", "y0", "y1")}).drop("sx", "sy")
            l = l.withColumn("o", F.explode(offsets))
            l = l.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
            r = boxes.withColumnsRenamed({c: f"b_{c}" for c in ("node", "x0", "x1", "y0", "y1")}).drop("sx", "sy")
            pairs = l.join(r, ["cx", "cy"]).filter("a_node < b_node")
        else:
            a = boxes.select(F.col("node").alias("a_node"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0", "y1")])
            b = boxes.select(F.col("node").alias("b_node"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1")])
            pairs = open_cells.join(a, "a_node").join(b, "b_node")
        gap_x = F.greatest(F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"), F.lit(0.0))
        gap_y = F.greatest(F.col("a_y0") - F.col("b_y1"), F.col("b_y0") - F.col("a_y1"), F.lit(0.0))
        far_x = F.greatest(F.col("a_x1") - F.col("b_x0"), F.col("b_x1") - F.col("a_x0"))
        far_y = F.greatest(F.col("a_y1") - F.col("b_y0"), F.col("b_y1") - F.col("a_y0"))
        judged = pairs.withColumns({near2: gap_x * gap_x + gap_y * gap_y, far2: far_x * far_x + far_y * far_y})
        verdict = checkpointed(
            judged.filter(F.col(near2) <= eps * eps).groupBy("a_node", "b_node").agg(F.min(far2).alias("best"))
        )
        sure = verdict.filter(F.col("best") <= eps * eps).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        found = sure if found is None else found.unionByName(sure)
        open_cells = verdict.filter(F.col("best") > eps * eps).select("a_node", "b_node")
        if open_cells.isEmpty():
            return found
    a = cored.select(F.col("node").alias("a_node"), F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = cored.select(F.col("node").alias("b_node"), F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    close = spread_join(open_cells.join(a, "a_node"), b, ["b_node"], "b_id").filter(
        F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= eps * eps
    )
    return found.unionByName(close.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct())
