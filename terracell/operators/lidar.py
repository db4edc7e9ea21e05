"""Point clouds: pid, x, y, z, intensity, ret, n_ret, class, scan_angle, source_id, gps, file and more.

Neighbourhoods within a radius are equi-joins on buckets a radius wide, of places: points at one x and y have the
same neighbours, so they are one row with their aggregates.  Grids and tiles are aggregations by cell, combined
before the shuffle.  Operators that pick points need a number of their own, ``pid``, which
breaks ties, so results don't depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..plans.iterate import cut
from ..registry import register, tool
from . import vector

LIDAR = "LiDAR Tools"
NOISE = (7, 18)


def selected(points: DataFrame, returns: str = "all", exclude_cls: list[int] | None = None, minz: float | None = None, maxz: float | None = None) -> DataFrame:
    """The points that gridding tools look at: by return, class and elevation."""
    out = points
    if returns == "first":
        out = out.where("ret = 1")
    elif returns == "last":
        out = out.where("ret = n_ret")
    if exclude_cls:
        out = out.where(~F.col("class").isin(*exclude_cls))
    if minz is not None:
        out = out.where(F.col("z") >= minz)
    return out if maxz is None else out.where(F.col("z") <= maxz)


def _cells(points: DataFrame, resolution: float, north: float = 0.0, west: float = 0.0) -> DataFrame:
    return vector.cell_of(points, north, west, resolution)


def class_list(text: str) -> list[int]:
    """Classes of a list such as "3-5,7"."""
    out: list[int] = []
    for part in text.split(","):
        low, _, high = part.strip().partition("-")
        out += range(int(low), int(high or low) + 1)
    return out


# -- filters and classes ----------------------------------------------------------------------------------------


@tool("FilterLidarClasses", LIDAR)
def filter_lidar_classes(points: DataFrame, exclude_cls: str) -> DataFrame:
    """Drops points of the listed classes; ranges such as 3-5 are expanded."""
    return points.where(~F.col("class").isin(*class_list(exclude_cls)))


@tool("FilterLidarScanAngles", LIDAR)
def filter_lidar_scan_angles(points: DataFrame, threshold: float) -> DataFrame:
    """Keeps points whose scan angle is within a threshold."""
    return points.where(F.abs("scan_angle") <= threshold)


@tool("FindFlightlineEdgePoints", LIDAR)
def find_flightline_edge_points(points: DataFrame) -> DataFrame:
    """Points flagged as the edge of a flight line."""
    return points.where("edge")


@tool("LidarElevationSlice", LIDAR)
def lidar_elevation_slice(points: DataFrame, minz: float | None = None, maxz: float | None = None, classify: bool = False, in_class: int = 2, out_class: int = 1) -> DataFrame:
    """Points between two elevations, or all of them classified by that."""
    inside = F.lit(True)
    if minz is not None:
        inside = inside & (F.col("z") >= minz)
    if maxz is not None:
        inside = inside & (F.col("z") <= maxz)
    return points.withColumn("class", F.when(inside, in_class).otherwise(out_class)) if classify else points.where(inside)


@tool("LidarRemoveDuplicates", LIDAR)
def lidar_remove_duplicates(points: DataFrame, include_z: bool = False) -> DataFrame:
    """Drops every member of a set of points at one place."""
    key = ["x", "y", "z"] if include_z else ["x", "y"]
    many = points.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)  # counted before the join, so a place that many share is one row
    return points.join(many, key, "left_anti").select(*points.columns)


@tool("LidarJoin", LIDAR)
def lidar_join(clouds: list[DataFrame]) -> DataFrame:
    """All points of several clouds."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


@tool("ClipLidarToPolygon", LIDAR)
def clip_lidar_to_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points in any polygon."""
    return points.join(vector.contained(points, polygons, "pid").select("pid").distinct(), "pid", "left_semi")


@tool("ErasePolygonFromLidar", LIDAR)
def erase_polygon_from_lidar(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points in no polygon."""
    return points.join(vector.contained(points, polygons, "pid").select("pid").distinct(), "pid", "left_anti")


@tool("ClassifyBuildingsInLidar", LIDAR)
def classify_buildings_in_lidar(points: DataFrame, buildings: DataFrame, building_class: int = 6) -> DataFrame:
    """Points in building footprints take the building class."""
    met = vector.contained(points, buildings, "pid").select("pid", F.lit(True).alias("_in")).distinct()
    return points.join(met, "pid", "left").withColumn("class", F.when(F.col("_in"), building_class).otherwise(F.col("class"))).select(*points.columns)


@tool("SelectTilesByPolygon", LIDAR)
def select_tiles_by_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Files with a point in a polygon."""
    met = vector.contained(points, polygons, "pid").select("pid").distinct()
    return points.join(met, "pid", "left_semi").select("file").distinct()


@tool("ClassifyOverlapPoints", LIDAR)
def classify_overlap_points(points: DataFrame, resolution: float = 2.0, criterion: str = "max scan angle", filter_points: bool = False, overlap_class: int = 12) -> DataFrame:
    """In cells of several flight lines, marks (or drops) points by a criterion.

    "max scan angle": those of every line but the one of least scan angle; "not min point source ID"; "not min time"; "multiple point source IDs".
    """
    celled = _cells(points, resolution)
    stats = celled.groupBy("row", "col").agg(F.min("source_id").alias("_low"), F.max("source_id").alias("_high"), F.min_by("source_id", F.struct(F.abs("scan_angle"), "source_id")).alias("_flat"), F.min_by("source_id", F.struct("gps", "source_id")).alias("_early"))
    several = F.col("_low") < F.col("_high")
    test = {
        "max scan angle": F.col("source_id") != F.col("_flat"),
        "not min point source ID": F.col("source_id") != F.col("_low"),
        "not min time": F.col("source_id") != F.col("_early"),
        "multiple point source IDs": F.lit(True),
    }[criterion]
    marked = celled.join(stats, ["row", "col"]).withColumn("_over", several & test)
    if filter_points:
        return marked.where(~F.col("_over")).select(*points.columns)
    return marked.withColumn("class", F.when(F.col("_over"), overlap_class).otherwise(F.col("class"))).select(*points.columns)


@tool("LidarClassifySubset", LIDAR)
def lidar_classify_subset(base: DataFrame, subset: DataFrame, subset_class: int, nonsubset_class: int | None = None, digits: int = 3) -> DataFrame:
    """Base points that the subset has, too (coordinates rounded), take one class, others another if given.

    A coordinate is scaled and rounded as the double it is, not as the decimals it prints as; halves go away from zero.
    """

    def whole(c: str) -> Column:
        scaled = F.abs(F.col(c) * 10.0**digits)
        return F.signum(c) * (F.floor(scaled) + (scaled - F.floor(scaled) >= 0.5).cast("int")) / 10.0**digits

    at = [whole(c).alias(f"_{c}") for c in "xyz"]
    key = ["_x", "_y", "_z"]
    met = base.select("*", *at).join(subset.select(*at, F.lit(True).alias("_in")).distinct(), key, "left")
    other = F.col("class") if nonsubset_class is None else F.lit(nonsubset_class)
    return met.withColumn("class", F.when(F.col("_in"), subset_class).otherwise(other)).select(*base.columns)


@tool("LidarShift", "Plug-ins")
def lidar_shift(points: DataFrame, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> DataFrame:
    """Points moved by three distances."""
    return points.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


@tool("LidarColourize", LIDAR)
def lidar_colourize(points: DataFrame, image: DataFrame, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Red, green and blue of the image cell (packed colours) under each point."""
    v = F.col("_v").cast("long")
    byte = lambda n: F.shiftright(v, n).bitwiseAND(F.lit(255)).cast("int")
    met = _cells(points, resolution, north, west).join(image.select("row", "col", F.col("value").alias("_v")), ["row", "col"], "left")
    return met.withColumns({"red": byte(0), "green": byte(8), "blue": byte(16)}).select(*[c for c in points.columns if c not in ("red", "green", "blue")], "red", "green", "blue")


# -- thinning and tiles -----------------------------------------------------------------------------------------


@tool("LidarThin", LIDAR)
def lidar_thin(points: DataFrame, resolution: float = 2.0, method: str = "lowest", save_filtered: bool = False) -> DataFrame:
    """One point a cell: first, last, lowest, highest, or nearest to the centre; or all the others.

    The point is found by an aggregation, not a sort of the cell, so cells of any number of points are combined first.
    """
    celled = _cells(points, resolution)
    centre = (F.col("x") - (F.col("col") + 0.5) * resolution) ** 2 + (F.col("y") + (F.col("row") + 0.5) * resolution) ** 2
    order = {"first": F.struct("pid"), "last": F.struct(-F.col("pid")), "lowest": F.struct("z", "pid"), "highest": F.struct((-F.col("z")).alias("z"), "pid"), "nearest": F.struct(centre.alias("d"), "pid")}[method]
    chosen = celled.groupBy("row", "col").agg(F.min_by("pid", order).alias("pid")).select("pid")
    return points.join(chosen, "pid", "left_anti" if save_filtered else "left_semi")


@tool("LidarThinHighDensity", LIDAR)
def lidar_thin_high_density(points: DataFrame, resolution: float, density: float, save_filtered: bool = False) -> DataFrame:
    """Where a cell's slice of elevation has more than density * area points, keeps one in every so many, in the order of pid."""
    threshold = resolution * resolution * density
    celled = _cells(points, resolution)
    lows = celled.groupBy("row", "col").agg(F.min("z").alias("_low"), F.count("*").alias("_n"))
    binned = celled.join(lows, ["row", "col"]).withColumn("_bin", F.floor((F.col("z") - F.col("_low")) / resolution))
    sizes = binned.groupBy("row", "col", "_bin").agg(F.count("*").alias("_m"))
    full = binned.join(sizes, ["row", "col", "_bin"]).where((F.col("_n") > threshold) & (F.col("_m") > threshold))
    skip = F.floor(F.col("_m") / threshold)
    # of each skip + 1 points the first ``skip`` go
    at = F.row_number().over(W.partitionBy("row", "col", "_bin").orderBy("pid")) - 1
    gone = full.withColumn("_at", at).where(F.col("_at") % (skip + 1) < skip).select("pid")
    return points.join(gone, "pid", "left_semi" if save_filtered else "left_anti")


@tool("LidarTile", LIDAR)
def lidar_tile(points: DataFrame, width: float = 1000.0, height: float = 1000.0, origin_x: float = 0.0, origin_y: float = 0.0, min_points: int = 2) -> DataFrame:
    """tile_x and tile_y of each point, without tiles of fewer points; write it partitioned by them."""
    at = points.withColumns({"tile_x": F.floor((F.col("x") - origin_x) / width), "tile_y": F.floor((F.col("y") - origin_y) / height)})
    full = at.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, min_points)).select("tile_x", "tile_y")
    return at.join(full, ["tile_x", "tile_y"], "left_semi")


# -- grids ------------------------------------------------------------------------------------------------------


@tool("LidarBlockMaximum", LIDAR)
def lidar_block_maximum(points: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Greatest elevation in each cell."""
    return _cells(points, resolution).groupBy("row", "col").agg(F.max("z").alias("value"))


@tool("LidarBlockMinimum", LIDAR)
def lidar_block_minimum(points: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Least elevation in each cell."""
    return _cells(points, resolution).groupBy("row", "col").agg(F.min("z").alias("value"))


@tool("FlightlineOverlap", LIDAR)
def flightline_overlap(points: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Number of flight lines in each cell."""
    return _cells(points, resolution).groupBy("row", "col").agg(F.countDistinct("source_id").cast("double").alias("value"))


@tool("LidarPointStats", LIDAR)
def lidar_point_stats(points: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Points, pulses, points a pulse, elevation and intensity ranges and the commonest class (least on ties) of each cell."""
    celled = _cells(points, resolution)
    pulse = F.count_if(F.col("ret") == 1)
    stats = celled.groupBy("row", "col").agg(F.count("*").alias("num_points"), pulse.alias("num_pulses"), (F.count("*") / F.nullif(pulse, F.lit(0))).alias("avg_points_per_pulse"), (F.max("z") - F.min("z")).alias("z_range"), (F.max("intensity") - F.min("intensity")).cast("double").alias("intensity_range"))
    n = celled.groupBy("row", "col", "class").agg(F.count("*").alias("n"))
    common = n.groupBy("row", "col").agg(F.min_by("class", F.struct((-F.col("n")).alias("n"), "class")).alias("predom_class"))
    return stats.join(common, ["row", "col"])


def _parameter(name: str) -> Column:
    names = {"elevation": "z", "intensity": "intensity", "class": "class", "return_number": "ret", "number_of_returns": "n_ret", "scanangle": "scan_angle", "userdata": "user_data", "time": "gps"}
    return F.col(names[name]).cast("double")


@tool("LidarPointDensity", LIDAR)
def lidar_point_density(points: DataFrame, base: DataFrame, radius: float = 2.5, resolution: float = 1.0, north: float = 0.0, west: float = 0.0, **choice) -> DataFrame:
    """Points within a radius of each cell's centre by the circle's area."""
    own = selected(points, **choice).groupBy("x", "y").agg(F.count("*").alias("v"))  # points at one place are one row
    met = vector._near_points(base, own, radius, north, west, resolution)
    n = met.groupBy("row", "col").agg(F.sum("other_v").alias("n"))
    return base.select("row", "col").join(n, ["row", "col"], "left").select("row", "col", (F.coalesce("n", F.lit(0)) / (math.pi * radius * radius)).alias("value"))


@tool("LidarIdwInterpolation", LIDAR)
def lidar_idw_interpolation(points: DataFrame, base: DataFrame, parameter: str = "elevation", weight: float = 1.0, radius: float = 2.5, resolution: float = 1.0, north: float = 0.0, west: float = 0.0, **choice) -> DataFrame:
    """Inverse-distance weighted grid of a parameter."""
    own = selected(points, **choice).select("x", "y", _parameter(parameter).alias("v"))
    return vector.idw_interpolation(own, base, "v", radius, weight, 0, north, west, resolution)


@tool("LidarNearestNeighbourGridding", LIDAR)
def lidar_nearest_neighbour_gridding(points: DataFrame, base: DataFrame, parameter: str = "elevation", radius: float = 2.5, resolution: float = 1.0, north: float = 0.0, west: float = 0.0, **choice) -> DataFrame:
    """Nearest-neighbour grid of a parameter."""
    own = selected(points, **choice).select("x", "y", _parameter(parameter).alias("v"))
    return vector.nearest_neighbour_gridding(own, base, "v", radius, north, west, resolution)


@tool("LidarHexBinning", LIDAR)
def lidar_hex_binning(points: DataFrame, width: float) -> DataFrame:
    """Hexagons with the number of points and the ranges of elevation and intensity."""
    q, r = vector.hexagon_of(F.col("x"), F.col("y"), width)
    return points.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("COUNT"), F.min("z").alias("MIN_Z"), F.max("z").alias("MAX_Z"), F.min("intensity").alias("MIN_I"), F.max("intensity").alias("MAX_I"))


# -- neighbourhoods ---------------------------------------------------------------------------------------------


AT = ["x", "y"]


def _places(points: DataFrame, **sums: Column) -> DataFrame:
    """One row a place, with aggregates of the points there."""
    here = points.where("x is not null and y is not null")
    return here.groupBy(*AT).agg(*[e.alias(n) for n, e in sums.items()]) if sums else here.select(*AT).distinct()


def _around(places: DataFrame, radius: float, how) -> DataFrame:
    """``how`` (aggregates by name) of the places within a radius of each place, itself included."""
    return vector.neighbours(places, places, radius).groupBy(*AT).agg(*[e.alias(n) for n, e in how.items()])


def _opening(points: DataFrame, radius: float) -> DataFrame:
    """x, y and base: the greatest, within a radius, of the least elevations within a radius."""
    low = _around(_places(points, z=F.min("z")), radius, {"low": F.min("other_z")})
    return _around(low, radius, {"base": F.max("other_low")})


def _nearest(places: DataFrame, others: DataFrame, k: int, first: float) -> DataFrame:
    """Each place with the nearest of the other places, all at the distance that has ``k`` points (column n) or more; with all if there are fewer.

    Circles grow from ``first`` on, twofold a round, and only places that lack points go on, so a round's join is about
    as large as what it finds.
    """
    left, found = cut(places.select(*AT)), None
    ends = others.agg(*[f(c) for c in AT for f in (F.min, F.max)]).first()
    own = left.agg(*[f(c) for c in AT for f in (F.min, F.max)]).first()
    if None in (*ends, *own):
        return vector.neighbours(left, others, 0.0).limit(0)
    span = math.hypot(*(max(ends[i + 1], own[i + 1]) - min(ends[i], own[i]) for i in (0, 2))) * (1 + 1e-9)
    radius = first if first > 0 else 1.0
    while True:
        upto = F.sum("other_n").over(W.partitionBy(*AT).orderBy("dist").rangeBetween(W.unboundedPreceding, 0))
        met = vector.neighbours(left, others, radius).withColumn("_upto", upto)
        reach = met.where(F.col("_upto") >= k).groupBy(*AT).agg(F.min("dist").alias("_reach"))
        last = radius >= span
        near = cut(met.join(reach, AT, "left" if last else "inner").where("_reach is null or dist <= _reach").drop("_upto", "_reach"))
        found = near if found is None else found.union(near)
        if last:
            return found
        left = cut(left.join(near.select(*AT).distinct(), AT, "left_anti"))
        if left.isEmpty():
            return found
        radius *= 2


@tool("LidarRemoveOutliers", LIDAR)
def lidar_remove_outliers(points: DataFrame, radius: float = 2.0, elev_diff: float = 50.0, use_median: bool = False, classify: bool = True) -> DataFrame:
    """Points far above or below the mean (or median) of their neighbours become noise, or go; noise is not looked at."""
    looked = F.coalesce(~F.col("class").isin(*NOISE), F.lit(False))
    live = points.where(looked)
    if use_median:
        around, middle = _ranked(live, radius), _median_of_others()
    else:
        around = _around(_places(live, n=F.count("z"), s=F.sum("z")), radius, {"_n": F.sum("other_n"), "_s": F.sum("other_s")})
        middle = (F.col("_s") - F.coalesce("z", F.lit(0.0))) / F.nullif(F.col("_n") - F.col("z").isNotNull().cast("int"), F.lit(0))
    met = points.join(around, AT, "left").withColumn("_mean", F.when(looked, middle))
    d = F.col("z") - F.col("_mean")
    if not classify:
        return met.where(F.col("_mean").isNull() | (F.abs(d) < elev_diff)).select(*points.columns)
    return met.withColumn("class", F.when(d >= elev_diff, 18).when(d <= -elev_diff, 7).otherwise(F.col("class"))).select(*points.columns)


def _ranked(points: DataFrame, radius: float) -> DataFrame:
    """Of each place the number n of elevations around it, and the sorted ones from number n // 2 - 1 (of 0 on) to the second next."""
    levels = points.where("z is not null").groupBy(*AT, "z").agg(F.count("*").alias("n"))
    met = vector.neighbours(_places(points), levels, radius)
    upto = F.sum("other_n").over(W.partitionBy(*AT).orderBy("other_z").rowsBetween(W.unboundedPreceding, 0))
    met = met.withColumn("_upto", upto).withColumn("_n", F.sum("other_n").over(W.partitionBy(*AT)))
    rank = lambda i: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2) - 1 + i, F.col("other_z"))).alias(f"_z{i}")
    return met.groupBy(*AT).agg(F.first("_n").alias("_n"), *[rank(i) for i in range(3)])


def _median_of_others() -> Column:
    """The median without the point's own elevation: what comes after that moves up by one."""
    rest = lambda i: F.when(F.col(f"_z{i}") < F.col("z"), F.col(f"_z{i}")).otherwise(F.col(f"_z{i + 1}"))
    both = F.when(F.col("_n") % 2 == 0, rest(0)).otherwise(0.5 * rest(0) + 0.5 * rest(1))
    return F.when(F.col("z").isNull(), F.col("_z1")).when(F.col("_n") > 1, both)


@tool("LidarTophatTransform", LIDAR)
def lidar_tophat_transform(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """Elevation above the opening: the greatest, within a radius, of the least elevations within a radius."""
    return points.join(_opening(points, radius), AT).withColumn("z", F.col("z") - F.col("base")).select(*points.columns)


@tool("HeightAboveGround", LIDAR)
def height_above_ground(points: DataFrame, ground_class: int = 2) -> DataFrame:
    """Elevation above the nearest ground point, of several the one of least pid; ground points get 0; NoData if there is no ground at all."""
    is_ground = F.col("class") == ground_class
    ground = cut(_places(points.where(is_ground), n=F.lit(1) * F.count("*"), pid=F.min("pid"), z=F.min_by("z", "pid")))
    box = ground.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    spacing = math.sqrt(box[1] * box[2] / box[0]) if box[0] else 0.0
    others = _places(points.where(~is_ground), n=F.count("*"))
    near = _nearest(others, ground, 1, spacing).groupBy(*AT).agg(F.min_by("other_z", "other_pid").alias("_g"))
    met = points.join(near, AT, "left")
    return met.withColumn("z", F.when(is_ground, 0.0).otherwise(F.col("z") - F.col("_g"))).select(*points.columns)


@tool("NormalizeLidar", "Plug-ins")
def normalize_lidar(points: DataFrame, dtm: DataFrame, resolution: float = 1.0, north: float = 0.0, west: float = 0.0) -> DataFrame:
    """Elevation above the terrain model's cell; points over NoData go."""
    met = _cells(points, resolution, north, west).join(dtm.where("value is not null").select("row", "col", F.col("value").alias("_g")), ["row", "col"])
    return met.withColumn("z", F.col("z") - F.col("_g")).select(*points.columns)


@tool("LidarGroundPointFilter", LIDAR)
def lidar_ground_point_filter(points: DataFrame, radius: float = 2.0, min_neighbours: int = 0, slope_threshold: float = 45.0, height_threshold: float = 1.0, classify: bool = True, slope_norm: bool = True) -> DataFrame:
    """Points that stand over a neighbour by a slope are off the ground (class 1); others are ground (2); noise goes.

    Last returns are looked at, others are off.  With ``slope_norm`` elevations are those above the opening, and points at
    the height threshold or more are off; else the rise over the neighbour must be above it, too.  Neighbourhoods of fewer
    points than ``min_neighbours`` (the point itself counts) reach to the nearest so many.
    """
    quiet = points.where(~F.coalesce(F.col("class").isin(*NOISE), F.lit(False)))
    last = quiet.where("ret = n_ret")
    places = _places(last, low=F.min("z"), n=F.count("*"))
    base = _opening(last, radius) if slope_norm else places.select(*AT, F.lit(0.0).alias("base"))
    places = cut(places.join(base, AT).withColumn("low", F.col("low") - F.col("base")))
    met = vector.neighbours(places.select(*AT), places.select(*AT, "low", "n"), radius)
    if min_neighbours > 1:
        few = cut(met.groupBy(*AT).agg(F.sum("other_n").alias("n")).where(F.col("n") < min_neighbours).select(*AT))
        if not few.isEmpty():
            met = met.join(few, AT, "left_anti").union(_nearest(few, places.select(*AT, "low", "n"), min_neighbours, 2 * radius))
    rise = F.col("dist") * math.tan(math.radians(min(slope_threshold, 88.0)))
    rise = rise if slope_norm else F.greatest(rise, F.lit(float(height_threshold)))
    top = met.where("dist > 0").groupBy(*AT).agg(F.min(F.col("other_low") + rise).alias("_top"))
    marked = quiet.join(places.select(*AT, "base").join(top, AT, "left"), AT, "left")
    own = F.col("z") - F.col("base")
    off = F.coalesce(own > F.col("_top"), F.lit(False)) | (F.coalesce(own >= height_threshold, F.lit(False)) if slope_norm else F.lit(False))
    marked = marked.withColumn("_off", off | ~F.coalesce(F.col("ret") == F.col("n_ret"), F.lit(False)))
    if not classify:
        return marked.where(~F.col("_off")).select(*points.columns)
    return marked.withColumn("class", F.when(F.col("_off"), 1).otherwise(2)).select(*points.columns)


def normals(points: DataFrame, radius: float) -> DataFrame:
    """x, y and the unit normal (a, b, c) of a least-squares plane z = px + qy + r through each place's neighbourhood; null where flat in plan.

    The sums of a neighbourhood are plain aggregates about the place itself, so nothing leaves JVM code.
    """
    places = _places(points, k=F.count("*"), t=F.sum("z"))
    dx, dy = F.col("other_x") - F.col("x"), F.col("other_y") - F.col("y")
    k, dz = F.col("other_k"), F.col("other_t") - F.col("other_k") * (F.col("t") / F.col("k"))
    sums = {"n": k, "sx": k * dx, "sy": k * dy, "sz": dz, "xx": k * dx * dx, "yy": k * dy * dy, "xy": k * dx * dy, "xz": dx * dz, "yz": dy * dz}
    s = _around(places, radius, {n: F.sum(e) for n, e in sums.items()})
    c = {name: F.col(name) for name in sums}
    vxx, vyy, vxy = c["xx"] - c["sx"] ** 2 / c["n"], c["yy"] - c["sy"] ** 2 / c["n"], c["xy"] - c["sx"] * c["sy"] / c["n"]
    vxz, vyz = c["xz"] - c["sx"] * c["sz"] / c["n"], c["yz"] - c["sy"] * c["sz"] / c["n"]
    det = vxx * vyy - vxy * vxy
    good = F.when(det > 1e-9 * (vxx + vyy) ** 2, det)
    p, q = (vxz * vyy - vyz * vxy) / good, (vyz * vxx - vxz * vxy) / good
    found = s.select(*AT, p.alias("p"), q.alias("q"))
    size = F.sqrt(F.col("p") ** 2 + F.col("q") ** 2 + 1)
    return found.select(*AT, (-F.col("p") / size).alias("a"), (-F.col("q") / size).alias("b"), (1 / size).alias("c"))


@tool("NormalVectors", LIDAR)
def normal_vectors(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """Normals of the points' neighbourhoods, scaled to colours of 0 to 255."""
    n = normals(points, radius)
    scaled = lambda c: F.floor((F.coalesce(c, F.lit(0.0)) + 1) / 2 * 255).cast("int")
    return points.join(n, AT).select(*points.columns, scaled("a").alias("red"), scaled("b").alias("green"), scaled("c").alias("blue"))


@tool("LidarHillshade", LIDAR)
def lidar_hillshade(points: DataFrame, azimuth: float = 315.0, altitude: float = 30.0, radius: float = 1.0) -> DataFrame:
    """Shade, 0 to 255, of each point's plane under a light."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    light = (math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt), math.sin(alt))
    shade = F.greatest(F.coalesce("a", F.lit(0.0)) * light[0] + F.coalesce("b", F.lit(0.0)) * light[1] + F.coalesce("c", F.lit(1.0)) * light[2], F.lit(0.0))
    return points.join(normals(points, radius), AT).select(*points.columns, F.floor(shade * 255).cast("int").alias("shade"))


# -- reports and formats ----------------------------------------------------------------------------------------


@tool("LidarInfo", LIDAR)
def lidar_info(points: DataFrame) -> DataFrame:
    """Bounds, number of points and density of each file."""
    box = points.groupBy("file").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return box.withColumn("density", F.col("n") / F.nullif((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")), F.lit(0.0)))


@tool("LidarInfoClasses", LIDAR)
def lidar_info_classes(points: DataFrame) -> DataFrame:
    """Number of points by file, class and return."""
    return points.groupBy("file", "class", "ret").agg(F.count("*").alias("n"))


@tool("LidarHistogram", LIDAR)
def lidar_histogram(points: DataFrame, parameter: str = "elevation", clip: float = 1.0, bins: int = 50) -> DataFrame:
    """Counts in equal bins between two clipped quantiles (exact ones)."""
    v = _parameter(parameter)
    ends = points.agg(F.percentile(v, F.array(F.lit(clip / 100), F.lit(1 - clip / 100))).alias("q")).first()["q"]
    if ends is None:
        return points.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    low, high = ends
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    return points.where(v.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@tool("LidarKappaIndex", LIDAR)
def lidar_kappa_index(first: DataFrame, second: DataFrame, radius: float = 0.001) -> DataFrame:
    """Error matrix of the classes of two clouds, each point met with the other cloud's nearest, within a radius in plan.

    Of two places the elevations are sorted together; the nearest is next below or above, of equal ones the least pid.
    """
    own = first.groupBy(*AT, "z", "class").agg(F.count("*").alias("n"))
    levels = second.where("z is not null").groupBy(*AT, "z").agg(F.min(F.struct("pid", "class")).alias("o"))
    pairs = cut(vector.neighbours(_places(first), _places(second), radius))
    asked = pairs.join(own.select(*AT, "z").distinct(), AT).withColumn("o", F.lit(None).cast(levels.schema["o"].dataType))
    given = pairs.join(levels.select(F.col("x").alias("other_x"), F.col("y").alias("other_y"), "z", "o"), ["other_x", "other_y"])
    both = asked.unionByName(given).withColumn("oz", F.when(F.col("o").isNotNull(), F.struct("z", "o")))
    place = W.partitionBy(*AT, "other_x", "other_y")
    ways = [place.orderBy(*order).rowsBetween(W.unboundedPreceding, 0) for order in ((F.col("z"), F.col("o").isNull()), (F.col("z").desc(), F.col("o").isNull()))]
    met = both.withColumns({f"_{i}": F.last("oz", ignorenulls=True).over(w) for i, w in enumerate(ways)}).where("o is null")
    d = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col("dist") ** 2 + (F.col("z") - F.col(c)["z"]) ** 2).alias("d"), F.col(c)["o"]["pid"].alias("pid"), F.col(c)["o"]["class"].alias("class")))
    near = met.groupBy(*AT, "z").agg(F.min(F.least(d("_0"), d("_1"))).alias("best")).where("best is not null").select(*AT, "z", F.col("best.class").alias("class2"))
    return own.withColumnRenamed("class", "class1").join(near, [*AT, "z"]).groupBy("class1", "class2").agg(F.sum("n").alias("n"))


def ascii_points(spark, path: str, pattern: str) -> DataFrame:
    """Points of ASCII files whose columns a pattern names."""
    names = {"x": ("x", "double"), "y": ("y", "double"), "z": ("z", "double"), "i": ("intensity", "int"), "c": ("class", "int"), "rn": ("ret", "int"), "nr": ("n_ret", "int"), "time": ("gps", "double"), "sa": ("scan_angle", "int"), "r": ("red", "int"), "g": ("green", "int"), "b": ("blue", "int")}
    schema = ", ".join(f"{n} {t}" for n, t in (names[p.strip()] for p in pattern.split(",")))
    return spark.read.csv(path, schema=schema).where("x is not null and y is not null")


@tool("LasToShapefile", LIDAR)
def las_to_shapefile(points: DataFrame) -> DataFrame:
    """Points as point features with their attributes."""
    one = F.array(F.struct(F.col("x"), F.col("y")))
    return points.select(F.col("pid").alias("fid"), F.lit(vector.POINT).alias("shape_type"), F.array(F.lit(0)).alias("parts"), one.alias("points"), *[c for c in points.columns if c not in ("pid", "x", "y")])


@tool("LasToMultipointShapefile", LIDAR)
def las_to_multipoint_shapefile(points: DataFrame, most: int = 100_000) -> DataFrame:
    """Multipoint features of a file's points, at most ``most`` in each, so that a feature has a bounded size."""
    block = F.floor(F.col("pid") / most)
    own = F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"])
    return points.groupBy("file", block.alias("block")).agg(F.sort_array(F.collect_list(own)).alias("points")).withColumn("shape_type", F.lit(vector.MULTIPOINT))


register("LidarDigitalSurfaceModel", LIDAR, lambda points, base, radius=0.5, resolution=1.0, north=0.0, west=0.0: dsm(points, base, radius, resolution, north, west), "Top surface: the greatest elevation within a radius of each cell's centre.")


def dsm(points: DataFrame, base: DataFrame, radius: float = 0.5, resolution: float = 1.0, north: float = 0.0, west: float = 0.0) -> DataFrame:
    """Greatest elevation within a radius of each cell's centre; NoData where there is no point."""
    top = points.groupBy("x", "y").agg(F.max("z").alias("v"))
    got = vector._near_points(base, top, radius, north, west, resolution).groupBy("row", "col").agg(F.max("other_v").alias("value"))
    return base.select("row", "col").join(got, ["row", "col"], "left")
