"""Distances, grid cells, nearest joins, polygons and boundary hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.identity import written

RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def grid_cell(lat: Column, lon: Column, degrees: float) -> dict[str, Column]:
    """Equal-angle cell: id, centroid, and the parent at twice the size, which contains it exactly."""
    row, column = F.floor((lat + 90) / degrees), F.floor((lon + 180) / degrees)
    name = lambda size, r, c: F.concat_ws(":", F.lit(f"{size:g}"), r.cast("string"), c.cast("string"))
    return {"cell_id": name(degrees, row, column), "cell_lat": (row + 0.5) * degrees - 90, "cell_lon": (column + 0.5) * degrees - 180, "parent_cell_id": name(degrees * 2, F.floor(row / 2), F.floor(column / 2))}


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _curve(*axes: Column) -> Column:
    """The place on a space-filling curve: 21 bits of each axis, interleaved."""
    masks = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]

    def spread(v: Column) -> Column:
        bits = F.least(F.floor((v + 1) * (1 << 20)), F.lit((1 << 21) - 1)).cast("long")
        return reduce(lambda x, m: x.bitwiseOR(F.shiftleft(x, m[0])).bitwiseAND(F.lit(m[1])), masks, bits)

    return reduce(lambda acc, iv: acc.bitwiseOR(F.shiftleft(spread(iv[1]), iv[0])), enumerate(axes), F.lit(0).cast("long"))


def _packed(places: DataFrame, leaf: int) -> tuple[DataFrame, int]:
    """(leaves, their number): places (e_id, e_lat, e_lon) in the order of the curve, cut into leaves of `leaf` consecutive ones with their box, a place of each, and all members."""
    points = places.withColumns(dict(zip(("px", "py", "pz"), _on_sphere(F.col("e_lat"), F.col("e_lon"))))).withColumn("_code", _curve(F.col("px"), F.col("py"), F.col("pz")))
    order = ["_code", "e_lat", "e_lon"]
    rows = written(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_seq", 33), "_at": F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").count()  # a row for each partition of the sort
    offsets = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_from"))
    member = F.struct("e_lat", "e_lon", "e_id", "px", "py", "pz")
    box = [f(c).alias(f"{c[1]}{i}") for c in ("px", "py", "pz") for i, f in ((1, F.min), (2, F.max))]
    numbered = rows.join(F.broadcast(offsets), "_part").withColumn("node", F.floor((F.col("_from") + F.col("_at")) / leaf).cast("long"))
    leaves = written(numbered.groupBy("node").agg(*box, F.min(F.struct("px", "py", "pz")).alias("one"), F.collect_list(member).alias("members")))  # at most `leaf` members
    return leaves, leaves.count()


def nearest_neighbour_join(candidates: DataFrame, eligible: DataFrame, leaf: int = 32, fan: int = 32) -> DataFrame:
    """Per candidate (id, lat, lon) the nearest eligible (e_id, e_lat, e_lon), ties by id, with a status.

    A tree over the places: they lie on the unit sphere in the order of a space-filling curve, `leaf` consecutive ones make
    a leaf with its box, and `fan` consecutive nodes make a node above, so leaves are bounded and the depth is the logarithm
    of the number of places, however dense a spot is. All candidates descend together, a level a join. A node is left out
    if its box lies farther away than a place that another node is known to hold; the places of the remaining leaves are
    compared one by one. Equal positions of candidates, and of places, are folded before.
    """
    slack = 1e-9  # on the unit sphere: well over the rounding of distances, so ties are decided by id
    left = candidates.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct()
    left = left.withColumns(dict(zip(("qx", "qy", "qz"), _on_sphere(F.col("lat"), F.col("lon")))))
    places = eligible.filter(F.col("e_lat").isNotNull() & F.col("e_lon").isNotNull()).groupBy("e_lat", "e_lon").agg(F.min("e_id").alias("e_id"))
    leaves, count = _packed(places, leaf)
    depth = next(k for k in range(64) if fan ** (k + 1) >= count)
    boxes = leaves.drop("members")
    away = lambda x, y, z: F.sqrt(F.pow(F.col("qx") - x, 2) + F.pow(F.col("qy") - y, 2) + F.pow(F.col("qz") - z, 2))
    outside = [F.greatest(F.col(f"{c}1") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"{c}2"), F.lit(0.0)) for c in "xyz"]
    low = F.sqrt(sum((v * v for v in outside), F.lit(0.0)))
    front = left.withColumns({"at": F.lit(0).cast("long"), "most": F.lit(4.0)})
    for k in range(depth, -1, -1):
        sides = [f(f"{c}{i}").alias(f"{c}{i}") for c in "xyz" for i, f in ((1, F.min), (2, F.max))]
        level = boxes if k == 0 else boxes.groupBy(F.floor(F.col("node") / fan**k).cast("long").alias("node")).agg(*sides, F.min("one").alias("one"))
        level = level.withColumn("at", F.floor(F.col("node") / fan).cast("long") if k < depth else F.lit(0).cast("long"))
        level = F.broadcast(level) if -(-count // fan**k) <= 20_000 else level
        near = front.join(level, "at").withColumn("low", low).filter(F.col("low") <= F.col("most") + slack)
        own = near.groupBy("lat", "lon", "qx", "qy", "qz").agg(F.min(F.least("most", away(F.col("one.px"), F.col("one.py"), F.col("one.pz")))).alias("most"), F.collect_list(F.struct("node", "low")).alias("nodes"))
        front = own.withColumn("at", F.explode(F.transform(F.filter("nodes", lambda x: x["low"] <= F.col("most") + slack), lambda x: x["node"])))
        front = front.select("lat", "lon", "qx", "qy", "qz", "at", "most")
    near = front.join(leaves.select(F.col("node").alias("at"), "members"), "at").select("lat", "lon", "qx", "qy", "qz", "most", F.inline("members"))
    near = near.filter(away(F.col("px"), F.col("py"), F.col("pz")) <= F.col("most") + slack)
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("e_lat"), F.col("e_lon")), 9)
    found = near.groupBy("lat", "lon").agg(F.min(F.struct(km.alias("km"), F.col("e_id"))).alias("_b"))
    done = found.select("lat", "lon", F.col("_b.e_id").alias("nearest_id"), F.col("_b.km").alias("distance_km"))
    status = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "not_applicable").when(F.col("nearest_id").isNull(), "unavailable").otherwise("available")
    return candidates.join(done, ["lat", "lon"], "left").select(*candidates.columns, "nearest_id", "distance_km", status.alias("status"))


def nearby_top_k(df: DataFrame, lat: float, lon: float, k: int, pinned: str | None = None) -> DataFrame:
    """The k nearest rows (id, lat, lon) to a point, a pinned one first."""
    km = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    first = F.coalesce(F.col("id").cast("string") == F.lit(pinned), F.lit(False))
    return df.withColumn("distance_km", F.round(km, 6)).orderBy(F.desc(first), "distance_km", "id").limit(k)


def boundary_edges(features: DataFrame) -> DataFrame:
    """Rings (feature_id, rings array<array<struct<x,y>>>) to edges; ring 0 is the outer one. An open or too short ring is dropped and must be caught by a rule on `rings`."""
    rings = features.select("feature_id", F.posexplode("rings").alias("ring", "points")).filter((F.size("points") >= 4) & (F.element_at("points", 1) == F.element_at("points", -1)))
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.get("points", i)["x"].alias("x1"), F.get("points", i)["y"].alias("y1"), F.get("points", i + 1)["x"].alias("x2"), F.get("points", i + 1)["y"].alias("y2")))
    return rings.select("feature_id", "ring", F.explode(pairs).alias("e")).select("feature_id", "ring", "e.*")


def cell_cover(edges: DataFrame, cells: int = 16, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(cover, bands): per feature its inner cells, which no edge touches, and its border cells; and its edges by rows of its cells.

    Each feature has a grid of its own, of the power of two in degrees (`e` is the exponent) at which its box has about
    `cells` cells a side, so the cover is bounded by the feature's shape and not by its size. A row's edges are cut to the
    row, and the cells that the rest reaches are border cells. A cell between them is inner if its centre lies inside the outer
    ring and in no hole. Cells outside of the feature aren't in the cover.
    """
    box = edges.filter("ring = 0").groupBy("feature_id").agg(F.min("x1").alias("bx1"), F.max("x1").alias("bx2"), F.min("y1").alias("by1"), F.max("y1").alias("by2"))
    extent = F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1"), F.lit(1e-6))
    box = written(box.withColumn("e", F.ceil(F.log2(extent / cells)).cast("int")).withColumn("size", F.pow(F.lit(2.0), F.col("e"))))
    at = lambda v: F.floor(v / F.col("size")).cast("long")
    low, high = F.least("y1", "y2") - tolerance, F.greatest("y1", "y2") + tolerance
    bands = edges.join(box, "feature_id").withColumn("gy", F.explode(F.sequence(at(low), at(high))))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    steep = F.abs(y2 - y1) > tolerance
    along = lambda y: F.when(steep, x1 + (x2 - x1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - y1) / F.when(steep, y2 - y1))))
    ends = [F.coalesce(along(F.col("gy") * F.col("size") - tolerance), x1), F.coalesce(along((F.col("gy") + 1) * F.col("size") + tolerance), x2)]
    reach = 1e-9 * F.greatest(F.lit(1.0), F.abs(x1), F.abs(x2)) + tolerance
    touched = bands.withColumn("gx", F.explode(F.sequence(at(F.least(*ends) - reach), at(F.greatest(*ends) + reach))))
    border = written(touched.select("feature_id", "e", "gx", "gy").distinct())
    grid = box.withColumn("gy", F.explode(F.sequence(at(F.col("by1")), at(F.col("by2"))))).withColumn("gx", F.explode(F.sequence(at(F.col("bx1")), at(F.col("bx2")))))
    plain = grid.select("feature_id", "e", "size", "gx", "gy").join(border, ["feature_id", "e", "gx", "gy"], "left_anti")
    middle = (F.col("gy") + 0.5) * F.col("size")
    lines = bands.filter((y1 > middle) != (y2 > middle)).select("feature_id", "gy", "ring", (x1 + (x2 - x1) * (middle - y1) / (y2 - y1)).alias("cut"))
    rings = plain.join(lines, ["feature_id", "gy"]).groupBy("feature_id", "e", "gx", "gy", "ring").agg((F.count_if(F.col("cut") > (F.col("gx") + 0.5) * F.col("size")) % 2 == 1).alias("odd"))
    inner = rings.groupBy("feature_id", "e", "gx", "gy").agg(F.max(F.col("odd") & (F.col("ring") == 0)).alias("outer"), F.max(F.col("odd") & (F.col("ring") > 0)).alias("hole")).filter("outer AND NOT hole")
    cover = inner.select("feature_id", "e", "gx", "gy", F.lit(True).alias("inner")).unionByName(border.withColumn("inner", F.lit(False)))
    return written(cover), bands.select("feature_id", "ring", "x1", "y1", "x2", "y2", "gy", "bx1", "bx2", "by1", "by2")


def point_in_polygon_join(points: DataFrame, edges: DataFrame, cells: int = 16, tolerance: float = 1e-12) -> DataFrame:
    """(point_id, feature_id): the one feature that holds the point, null for none or several.

    Points meet the cover of `cell_cover` by an equi-join on the cell, once for each size of cells in use. A point in an inner
    cell is held without looking at an edge; one in a border cell meets the edges of its row. Points on the outer ring are
    inside, points on a hole's ring outside.
    """
    cover, bands = cell_cover(edges, cells, tolerance)
    sizes = [r.e for r in cover.select("e").distinct().collect()]  # exponents of two: a few dozen values
    own = lambda c, e: F.floor(F.col(c) / 2.0**e).cast("long")
    places = F.array(*[F.struct(F.lit(e).alias("e"), own("lon", e).alias("gx"), own("lat", e).alias("gy")) for e in sizes]) if sizes else F.array().cast("array<struct<e:int,gx:bigint,gy:bigint>>")
    near = points.select("point_id", "lon", "lat", F.inline(places)).join(cover, ["e", "gx", "gy"])
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2"))
    crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1) + x1)
    area = F.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))
    scale = F.greatest(F.lit(1.0), F.abs(x2 - x1) + F.abs(y2 - y1))
    on_edge = (area <= tolerance * scale) & (x >= F.least(x1, x2) - tolerance) & (x <= F.greatest(x1, x2) + tolerance) & (y >= F.least(y1, y2) - tolerance) & (y <= F.greatest(y1, y2) + tolerance)
    faced = near.filter(~F.col("inner")).select("point_id", "lon", "lat", "feature_id", "gy").join(bands, ["feature_id", "gy"]).filter("lon BETWEEN bx1 AND bx2 AND lat BETWEEN by1 AND by2")
    rings = faced.groupBy("point_id", "feature_id", "ring").agg((F.count_if(crosses) % 2 == 1).alias("odd"), F.max(on_edge).alias("edge"))
    held = rings.groupBy("point_id", "feature_id").agg(F.max(F.when(F.col("ring") == 0, F.col("odd") | F.col("edge"))).alias("outer"), F.coalesce(F.max(F.when(F.col("ring") > 0, F.col("odd") | F.col("edge"))), F.lit(False)).alias("hole"))
    inside = held.filter("outer AND NOT hole").select("point_id", "feature_id").unionByName(near.filter("inner").select("point_id", "feature_id"))
    one = inside.groupBy("point_id").agg(F.when(F.min("feature_id") == F.max("feature_id"), F.max("feature_id")).alias("feature_id"))
    return points.select("point_id").join(one, "point_id", "left")


def boundary_hierarchy(features: DataFrame) -> DataFrame:
    """Nodes for countries, continents and the world, with bounds, parent and label point, from (country, continent, x1, y1, x2, y2)."""
    bounds = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    country = features.groupBy("country", "continent").agg(*bounds).select(F.lit("country").alias("level"), F.col("country").alias("node_id"), F.col("continent").alias("parent_id"), "x1", "y1", "x2", "y2")
    continent = features.groupBy("continent").agg(*bounds).select(F.lit("continent").alias("level"), F.col("continent").alias("node_id"), F.lit("world").alias("parent_id"), "x1", "y1", "x2", "y2")
    world = features.agg(*bounds).select(F.lit("global").alias("level"), F.lit("world").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "x1", "y1", "x2", "y2")
    return country.unionByName(continent).unionByName(world).withColumns({"label_x": (F.col("x1") + F.col("x2")) / 2, "label_y": (F.col("y1") + F.col("y2")) / 2})
