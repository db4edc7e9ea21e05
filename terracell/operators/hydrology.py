"""Hydrology and stream networks on flow pointers.

A pointer raster is a forest: each cell leads to one neighbour.  Accumulations, lengths, outlets and orders
are found by pointer doubling - log2 of the longest path rounds of joins - rather than cell by cell.
Depressions are filled by relaxation over tiles, which reaches the same surface as a priority flood.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..plans.focal import EIGHT, shifted, tiled
from ..plans.iterate import components, cut, doubled
from ..registry import register, tool

HYDRO = "Hydrological Analysis"
STREAM = "Stream Network Analysis"
GIS = "GIS Analysis"
KEY = ["row", "col"]


def _steepest(g: np.ndarray, resolution: float, weights: np.ndarray | None = None) -> np.ndarray:
    """The number of the first steepest downslope neighbour, or -1."""
    best, at = np.zeros_like(g), np.full(g.shape, -1)
    for i, (r, c) in enumerate(EIGHT):
        drop = (g - shifted(g, r, c)) / (resolution * (math.sqrt(2) if r and c else 1.0))
        better = drop > best
        best, at = np.where(better, drop, best), np.where(better, i, at)
    return at


@tool("D8Pointer", HYDRO)
def d8_pointer(dem: DataFrame, resolution: float = 1.0) -> DataFrame:
    """2**i of the steepest downslope neighbour i, clockwise from the north-east; 0 where there is none."""
    return tiled([dem], 1, lambda g: np.where(np.isnan(g), np.nan, np.where(_steepest(g, resolution) >= 0, 2.0 ** np.maximum(_steepest(g, resolution), 0), 0.0)))


@tool("Rho8Pointer", HYDRO)
def rho8_pointer(dem: DataFrame, seed: int = 0) -> DataFrame:
    """D8 with diagonal drops divided by a random length; the numbers depend on the cell and the seed."""
    rand = dem.select(*KEY, (F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("value"))

    def run(g, u):
        best, at = np.zeros_like(g), np.full(g.shape, -1)
        for i, (r, c) in enumerate(EIGHT):
            drop = (g - shifted(g, r, c)) / (2 - u if r and c else 1.0)
            better = drop > best
            best, at = np.where(better, drop, best), np.where(better, i, at)
        return np.where(np.isnan(g), np.nan, np.where(at >= 0, 2.0 ** np.maximum(at, 0), 0.0))

    return tiled([dem, rand], 1, run)


@tool("DInfPointer", HYDRO)
def dinf_pointer(dem: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Direction, in degrees from north, of the steepest of eight triangular facets; -1 if none falls."""
    cardinal = [(-1, 0), (0, 1), (1, 0), (0, -1)]

    def run(g):
        best, angle = np.zeros_like(g), np.full_like(g, -1.0)
        for i, (r, c) in enumerate(cardinal):
            for side in (-1, 1):
                o = cardinal[(i + side) % 4]
                e1, e2 = shifted(g, r, c), shifted(g, r + o[0], c + o[1])
                s1, s2 = (g - e1) / resolution, (e1 - e2) / resolution
                turn = np.arctan2(s2, s1)
                s = np.sqrt(s1 * s1 + s2 * s2)
                low, high = turn < 0, turn > math.pi / 4
                s = np.where(low, s1, np.where(high, (g - e2) / (resolution * math.sqrt(2)), s))
                turn = np.where(low, 0.0, np.where(high, math.pi / 4, turn))
                better = s > best
                best = np.where(better, s, best)
                angle = np.where(better, (90.0 * i + side * np.degrees(turn)) % 360.0, angle)
        return np.where(np.isnan(g), np.nan, angle)

    return tiled([dem], 1, run)


def node(row="row", col="col"):
    return (F.shiftleft(F.col(row).cast("long"), 32) + F.col(col).cast("long")) if isinstance(row, str) else F.shiftleft(row.cast("long"), 32) + col.cast("long")


def forest(pointer: DataFrame, resolution: float = 1.0) -> DataFrame:
    """row, col, id, next (null where the way ends) and step, the length to next."""
    v = F.col("value").cast("long")
    i = F.round(F.log2(F.nullif(F.col("value"), F.lit(0.0)))).cast("int") + 1
    dr, dc = (F.element_at(F.array(*[F.lit(s[k]) for s in EIGHT]), i) for k in (0, 1))
    cells = pointer.where("value is not null").select(*KEY, node().alias("id"), F.when(v > 0, node(F.col("row") + dr, F.col("col") + dc)).alias("next"), F.when(v > 0, F.when((dr != 0) & (dc != 0), math.sqrt(2) * resolution).otherwise(F.lit(float(resolution)))).alias("step"))
    there = cells.select(F.col("id").alias("next"), F.lit(True).alias("there"))
    return cells.join(there, "next", "left").select(*KEY, "id", F.when(F.col("there"), F.col("next")).alias("next"), F.when(F.col("there"), F.col("step")).alias("step"))


def _cells(df: DataFrame, value) -> DataFrame:
    return df.select(*KEY, value.cast("double").alias("value"))


@tool("D8FlowAccumulation", HYDRO)
def d8_flow_accumulation(pointer: DataFrame, out_type: str = "cells", cell_area: float = 1.0, width: float = 1.0, log: bool = False) -> DataFrame:
    """Number of cells that drain through each, itself included; or their area, or that by width."""
    n = doubled(forest(pointer).withColumn("acc", F.lit(1.0)), up={"acc": "sum"})
    value = F.col("acc") * {"cells": 1.0, "catchment area": cell_area, "specific contributing area": cell_area / width}[out_type]
    return _cells(n, F.ln(value) if log else value)


@tool("Rho8FlowAccumulation", "Plug-ins")
def rho8_flow_accumulation(dem: DataFrame, seed: int = 0) -> DataFrame:
    """Accumulation along a Rho8 pointer."""
    return d8_flow_accumulation(rho8_pointer(dem, seed))


@tool("FlowAccumulationFullWorkflow", HYDRO)
def flow_accumulation_full_workflow(dem: DataFrame) -> DataFrame:
    """Filled surface, pointer and accumulation of each cell."""
    filled = cut(fill_depressions(dem, 0.0001))
    pointer = cut(d8_pointer(filled))
    acc = d8_flow_accumulation(pointer)
    return filled.select(*KEY, F.col("value").alias("filled")).join(pointer.select(*KEY, F.col("value").alias("pointer")), KEY).join(acc.select(*KEY, F.col("value").alias("accumulation")), KEY)


@tool("NumInflowingNeighbours", HYDRO)
def num_inflowing_neighbours(dem: DataFrame) -> DataFrame:
    """How many neighbours drain to a cell."""
    f = forest(d8_pointer(dem))
    n = f.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.count("*").alias("n"))
    return _cells(f.join(n, "id", "left"), F.coalesce("n", F.lit(0)))


@tool("Basins", HYDRO)
def basins(pointer: DataFrame) -> DataFrame:
    """The outlet that each cell drains to, as row * 1,000,000 + col of the outlet."""
    n = doubled(forest(pointer))
    return _cells(n, F.shiftright("root", 32) * 1_000_000 + F.col("root").bitwiseAND(F.lit((1 << 32) - 1)))


def _with(pointer: DataFrame, other: DataFrame, name: str) -> DataFrame:
    return forest(pointer).join(other.select(*KEY, F.col("value").alias(name)), KEY, "left")


@tool("Watershed", HYDRO)
def watershed(pointer: DataFrame, pour_points: DataFrame) -> DataFrame:
    """The first pour point (cells of positive value) on the way down of each cell; NoData if none."""
    f = cut(_with(pointer, pour_points, "pour").withColumn("next", F.when(F.col("pour") > 0, None).otherwise(F.col("next"))).withColumn("step", F.when(F.col("next").isNotNull(), F.col("step"))))
    n = doubled(f)
    ends = f.where("pour > 0").select(F.col("id").alias("root"), F.col("pour").alias("label"))
    return _cells(n.select(*KEY, "root").join(ends, "root", "left"), F.col("label"))


@tool("DownslopeFlowpathLength", HYDRO)
def downslope_flowpath_length(pointer: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Length of the way from each cell to its outlet."""
    return _cells(doubled(forest(pointer, resolution)), F.col("span"))


@tool("FlowLengthDiff", HYDRO)
def flow_length_diff(pointer: DataFrame) -> DataFrame:
    """Greatest difference of downslope length from a neighbour's."""
    return tiled([cut(downslope_flowpath_length(pointer))], 1, lambda g: np.where(np.isnan(g), np.nan, np.nanmax(np.stack([np.abs(g - shifted(g, r, c)) for r, c in EIGHT] + [np.zeros_like(g)]), axis=0)))


@tool("MaxUpslopeFlowpathLength", HYDRO)
def max_upslope_flowpath_length(dem: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Length of the longest way that leads to each cell."""
    return _cells(doubled(forest(d8_pointer(dem, resolution), resolution).withColumn("len", F.lit(0.0)), up={"len": "longest"}), F.col("len"))


def _heads(f: DataFrame) -> DataFrame:
    """Adds head: 1 where nothing leads to a cell, else 0."""
    into = f.where("next is not null").select(F.col("next").alias("id"), F.lit(True).alias("fed")).distinct()
    return f.join(into, "id", "left").withColumn("head", F.when(F.col("fed"), 0.0).otherwise(1.0)).drop("fed")


@tool("AverageUpslopeFlowpathLength", HYDRO)
def average_upslope_flowpath_length(dem: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Mean length of the ways from the divides to each cell."""
    f = _heads(forest(d8_pointer(dem, resolution), resolution))
    down = cut(doubled(f))
    # the length from a head to a cell is the head's way to the outlet without the cell's own
    n = doubled(down.select(*KEY, "id", "next", "step", "head", F.col("span").alias("rest"), (F.col("head") * F.col("span")).alias("sums")), up={"head": "sum", "sums": "sum"})
    return _cells(n, F.col("sums") / F.col("head") - F.col("rest"))


@tool("AverageFlowpathSlope", HYDRO)
def average_flowpath_slope(dem: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Mean slope, in degrees, of the ways from the divides to each cell."""
    f = _heads(_with(d8_pointer(dem, resolution), dem, "z"))
    down = cut(doubled(f))
    n = doubled(down.select(*KEY, "id", "next", "step", "head", "z", F.col("span").alias("rest"), (F.col("head") * F.col("span")).alias("sums"), (F.col("head") * F.col("z")).alias("tops")), up={"head": "sum", "sums": "sum", "tops": "sum"})
    length = F.col("sums") / F.col("head") - F.col("rest")
    return _cells(n, F.when(length > 0, F.degrees(F.atan((F.col("tops") / F.col("head") - F.col("z")) / length))).otherwise(0.0))


@tool("ElevAbovePit", HYDRO)
def elev_above_pit(dem: DataFrame) -> DataFrame:
    """Elevation above the cell at the end of the way down."""
    f = cut(_with(d8_pointer(dem), dem, "z"))
    n = doubled(f).select(*KEY, "z", "root").join(f.select(F.col("id").alias("root"), F.col("z").alias("pit")), "root")
    return _cells(n, F.col("z") - F.col("pit"))


@tool("MaxUpslopeValue", "Plug-ins")
def max_upslope_value(dem: DataFrame, values: DataFrame) -> DataFrame:
    """Greatest value of a raster among the cells that lead to each, itself included."""
    return _cells(doubled(_with(d8_pointer(dem), values, "v"), up={"v": "max"}), F.col("v"))


@tool("D8MassFlux", HYDRO)
def d8_mass_flux(dem: DataFrame, loading: DataFrame, efficiency: DataFrame | None = None, absorption: DataFrame | None = None) -> DataFrame:
    """Load that reaches each cell: its own, and from each cell above what that one has, less its absorption, times its efficiency.

    An efficiency raster that exceeds 1 is in percent.  More may be absorbed than there is, so flux can be negative.
    """
    n = _with(d8_pointer(dem), loading, "m").withColumn("m", F.coalesce("m", F.lit(0.0)))
    if efficiency is None and absorption is None:
        return _cells(doubled(n, up={"m": "sum"}), F.col("m"))
    for name, layer, rest in (("eff", efficiency, 1.0), ("sunk", absorption, 0.0)):
        own = n.withColumn(name, F.lit(None).cast("double")) if layer is None else n.join(layer.select(*KEY, F.col("value").alias(name)), KEY, "left")
        n = own.withColumn(name, F.coalesce(name, F.lit(rest)))
    if efficiency is not None and (efficiency.agg(F.max("value")).first()[0] or 0) > 1:
        n = n.withColumn("eff", F.col("eff") / 100)
    # what a cell adds: its load less what is absorbed right above it; every step down takes its efficiency
    n = cut(n)
    lost = n.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.sum(F.col("eff") * F.col("sunk")).alias("lost"))
    now = cut(n.join(lost, "id", "left").select(*KEY, "id", F.col("next").alias("jump"), F.col("eff").alias("w"), (F.col("m") - F.coalesce("lost", F.lit(0.0))).alias("m")))
    while not now.where("jump is not null").limit(1).isEmpty():
        sent = now.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum(F.col("m") * F.col("w")).alias("got"))
        far = now.select(F.col("id").alias("jump"), F.col("jump").alias("j2"), F.col("w").alias("w2"))
        now = now.join(sent, "id", "left").withColumn("m", F.col("m") + F.coalesce("got", F.lit(0.0))).drop("got")
        now = cut(now.join(far, "jump", "left").select(*KEY, "id", F.col("j2").alias("jump"), (F.col("w") * F.coalesce("w2", F.lit(0.0))).alias("w"), "m"))
    return _cells(now, F.col("m"))


@tool("TraceDownslopeFlowpaths", HYDRO)
def trace_downslope_flowpaths(seeds: DataFrame, pointer: DataFrame) -> DataFrame:
    """How many seeds (row, col) pass each cell on their way; NoData where none does."""
    f = forest(pointer)
    n = seeds.groupBy(*KEY).agg(F.count("*").cast("double").alias("n"))
    out = doubled(f.join(n, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0.0))), up={"n": "sum"})
    return _cells(out, F.when(F.col("n") > 0, F.col("n")))


def _to_stream(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    f = forest(pointer, resolution).join(streams.where("value > 0").select(*KEY, F.lit(True).alias("stream")), KEY, "left")
    return cut(f.withColumn("next", F.when(F.col("stream"), None).otherwise(F.col("next"))).withColumn("step", F.when(F.col("next").isNotNull(), F.col("step"))))


@tool("DownslopeDistanceToStream", HYDRO)
def downslope_distance_to_stream(dem: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Length of the way to the first stream cell; NoData where the way meets none."""
    f = _to_stream(d8_pointer(dem, resolution), streams, resolution)
    n = doubled(f).select(*KEY, "span", "root").join(f.where("stream").select(F.col("id").alias("root"), F.lit(True).alias("met")), "root", "left")
    return _cells(n, F.when(F.col("met"), F.col("span")))


@tool("ElevationAboveStream", HYDRO)
def elevation_above_stream(dem: DataFrame, streams: DataFrame) -> DataFrame:
    """Elevation above the first stream cell on the way down."""
    f = _to_stream(d8_pointer(dem), streams)
    z = dem.select(*KEY, F.col("value").alias("z"))
    ends = f.where("stream").join(z, KEY).select(F.col("id").alias("root"), F.col("z").alias("bed"))
    return _cells(doubled(f).select(*KEY, "root").join(z, KEY).join(ends, "root", "left"), F.col("z") - F.col("bed"))


# -- streams ----------------------------------------------------------------------------------------------------


def network(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """The forest of the stream cells alone, with inflow counts."""
    f = forest(pointer, resolution).join(streams.where("value > 0").select(*KEY), KEY, "left_semi")
    own = f.select(F.col("id").alias("next"), F.lit(True).alias("there"))
    f = f.join(own, "next", "left").select(*KEY, "id", F.when(F.col("there"), F.col("next")).alias("next"), F.when(F.col("there"), F.col("step")).alias("step"))
    n = f.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.count("*").alias("inflows"))
    return cut(f.join(n, "id", "left").withColumn("inflows", F.coalesce("inflows", F.lit(0))))


@tool("DistanceToOutlet", STREAM)
def distance_to_outlet(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Length along the stream to its outlet."""
    return _cells(doubled(network(pointer, streams, resolution)), F.col("span"))


@tool("ShreveStreamMagnitude", STREAM)
def shreve_stream_magnitude(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """Number of channel heads upstream."""
    return _cells(doubled(network(pointer, streams).withColumn("m", F.when(F.col("inflows") == 0, 1.0).otherwise(0.0)), up={"m": "sum"}), F.col("m"))


@tool("FarthestChannelHead", STREAM)
def farthest_channel_head(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Distance to the farthest channel head upstream."""
    return _cells(doubled(network(pointer, streams, resolution).withColumn("d", F.lit(0.0)), up={"d": "longest"}), F.col("d"))


@tool("LengthOfUpstreamChannels", STREAM)
def length_of_upstream_channels(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Total length of the channels upstream of each stream cell."""
    n = network(pointer, streams, resolution)
    into = n.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.sum("step").alias("own"))
    return _cells(doubled(n.join(into, "id", "left").withColumn("own", F.coalesce("own", F.lit(0.0))), up={"own": "sum"}), F.col("own"))


def links(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """row, col, id, step and link: the number of each cell's link, the id of its lowest cell.

    A link ends above a confluence; the confluence cell begins the next one.
    """
    n = network(pointer, streams, resolution)
    meets = n.where("inflows > 1").select(F.col("id").alias("next"), F.lit(True).alias("meet"))
    cutoff = n.join(meets, "next", "left").select(*KEY, "id", F.when(F.col("meet"), None).otherwise(F.col("next")).alias("next"), "step", "inflows")
    return doubled(cutoff).select(*KEY, "id", "step", "inflows", F.col("root").alias("link"))


@tool("StreamLinkIdentifier", STREAM)
def stream_link_identifier(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """One number for the cells of each link: row * 1,000,000 + col of its lowest cell."""
    return _cells(links(pointer, streams), F.shiftright("link", 32) * 1_000_000 + F.col("link").bitwiseAND(F.lit((1 << 32) - 1)))


@tool("StreamLinkLength", STREAM)
def stream_link_length(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Length of the link that a cell is in."""
    n = cut(links(pointer, streams, resolution))
    total = n.groupBy("link").agg(F.sum(F.coalesce("step", F.lit(0.0))).alias("len"))
    return _cells(n.join(total, "link"), F.col("len"))


@tool("StreamLinkSlope", STREAM)
def stream_link_slope(pointer: DataFrame, streams: DataFrame, dem: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Mean slope, in percent, of the link that a cell is in."""
    n = cut(links(pointer, streams, resolution).join(dem.select(*KEY, F.col("value").alias("z")), KEY))
    total = n.groupBy("link").agg(F.sum(F.coalesce("step", F.lit(0.0))).alias("len"), (F.max("z") - F.min("z")).alias("fall"))
    return _cells(n.join(total, "link"), F.when(F.col("len") > 0, 100 * F.col("fall") / F.col("len")).otherwise(0.0))


@tool("StreamLinkClass", STREAM)
def stream_link_class(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """1 exterior link, 2 interior link, 3 source, 4 link node, 5 sink."""
    n = network(pointer, streams)
    heads = doubled(n.withColumn("m", F.when(F.col("inflows") == 0, 1.0).otherwise(0.0)), up={"m": "sum"})
    value = F.when(F.col("next").isNull(), 5).when(F.col("inflows") == 0, 3).when(F.col("inflows") > 1, 4).when(F.col("m") > 1, 2).otherwise(1)
    return _cells(heads, value)


@tool("RemoveShortStreams", STREAM)
def remove_short_streams(pointer: DataFrame, streams: DataFrame, min_length: float, resolution: float = 1.0) -> DataFrame:
    """Streams without the headwater links shorter than a length."""
    n = cut(links(pointer, streams, resolution))
    total = n.groupBy("link").agg(F.sum(F.coalesce("step", F.lit(0.0))).alias("len"), F.max(F.when(F.col("inflows") == 0, 1).otherwise(0)).alias("outer"))
    return _cells(n.join(total, "link"), F.when((F.col("outer") == 1) & (F.col("len") < min_length), None).otherwise(1.0))


@tool("StrahlerStreamOrder", STREAM)
def strahler_stream_order(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """Strahler's order; rounds go up one order at a time, and each is found for whole links by doubling."""
    n = network(pointer, streams)
    order = n.select("id", F.lit(1).alias("order"))  # of cells whose order is at least k
    k, live = 1, n
    while True:
        # cells where two branches of order k or more meet begin order k + 1, as does all below them
        met = live.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(1.0).alias("seed"))
        if met.limit(1).isEmpty():
            break
        below = doubled(live.select(*KEY, "id", "next", "step").join(met, "id", "left").withColumn("seed", F.coalesce("seed", F.lit(0.0))), up={"seed": "sum"})
        k += 1
        live = cut(below.where("seed > 0").select(*KEY, "id", "next", "step"))
        order = cut(order.join(live.select("id", F.lit(k).alias("k")), "id", "left").select("id", F.coalesce("k", "order").alias("order")))
    return _cells(n.join(order, "id"), F.col("order"))


@tool("TopologicalStreamOrder", STREAM)
def topological_stream_order(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """1 at the outlet, and one more above each confluence."""
    n = network(pointer, streams).withColumn("meet", (F.col("inflows") > 1).cast("double")).withColumn("all", F.col("meet"))
    return _cells(doubled(n, down={"all": "sum"}), 1 + F.col("all") - F.col("meet"))


def tributaries(pointer: DataFrame, streams: DataFrame, resolution: float = 1.0) -> DataFrame:
    """row, col, id, below (the next cell) and tributary: the id of the lowest cell of each cell's tributary.

    At a confluence the branch with the farthest channel head goes on, of equal ones that of the least cell.
    """
    n = doubled(network(pointer, streams, resolution).withColumn("d", F.lit(0.0)), up={"d": "longest"}).select(*KEY, "id", "next", "step", "d")
    main = n.where("next is not null").groupBy("next").agg(F.max_by("id", F.struct(F.round(F.col("d") + F.col("step"), 6), -F.col("id"))).alias("id")).select("id", F.lit(True).alias("main"))
    own = n.join(main, "id", "left").select(*KEY, "id", F.col("next").alias("below"), "step", F.when(F.col("main"), F.col("next")).alias("next"))
    return cut(doubled(own).select(*KEY, "id", "below", F.col("root").alias("tributary")))


@tool("TributaryIdentifier", STREAM)
def tributary_identifier(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """One number for the cells of each tributary: row * 1,000,000 + col of its lowest cell."""
    return _cells(tributaries(pointer, streams), F.shiftright("tributary", 32) * 1_000_000 + F.col("tributary").bitwiseAND(F.lit((1 << 32) - 1)))


@tool("HackStreamOrder", STREAM)
def hack_stream_order(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """1 on the main stem, and one more on each tributary than on the stream that it flows into."""
    t = tributaries(pointer, streams)
    into = t.select(F.col("id").alias("below"), F.col("tributary").alias("next"))
    mouths = t.where("id = tributary").join(into, "below", "left").select("id", "next", F.lit(1.0).alias("step"), F.lit(1.0).alias("order"))
    orders = doubled(mouths, down={"order": "sum"}).select(F.col("id").alias("tributary"), "order")
    return _cells(t.join(orders, "tributary"), F.col("order"))


@tool("FindMainStem", STREAM)
def find_main_stem(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """1 along the longest stream of each network; NoData on all others."""
    return _cells(hack_stream_order(pointer, streams), F.when(F.col("value") == 1, 1.0))


@tool("HortonStreamOrder", STREAM)
def horton_stream_order(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """Strahler's order of the lowest cell of each tributary, from its head on."""
    t = tributaries(pointer, streams)
    order = t.select(*KEY, "id").join(strahler_stream_order(pointer, streams), KEY).select(F.col("id").alias("tributary"), F.col("value").alias("order"))
    return _cells(t.join(order, "tributary"), F.col("order"))


@tool("StrahlerOrderBasins", HYDRO)
def strahler_order_basins(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """The order of the stream cell that each cell drains to."""
    return watershed(pointer, strahler_stream_order(pointer, streams))


@tool("Subbasins", HYDRO)
def subbasins(pointer: DataFrame, streams: DataFrame) -> DataFrame:
    """The link that each cell drains to."""
    return watershed(pointer, stream_link_identifier(pointer, streams))


@tool("LongProfile", STREAM)
def long_profile(pointer: DataFrame, streams: DataFrame, dem: DataFrame) -> DataFrame:
    """Elevation of each stream cell by its distance to the outlet."""
    d = distance_to_outlet(pointer, streams).withColumnRenamed("value", "distance")
    return d.join(dem.select(*KEY, F.col("value").alias("z")), KEY)


# -- depressions ------------------------------------------------------------------------------------------------


@tool("FillDepressionsPlanchonAndDarboux", HYDRO)
def fill_depressions(dem: DataFrame, fix_flats: float = 0.0, tile: int = 128) -> DataFrame:
    """The lowest surface not below the DEM from which every cell drains off the grid or into NoData.

    Tiles relax to their own fixpoint and exchange edges until no cell of any changes.
    """
    edge = tiled([dem], 1, lambda g: np.where(np.isnan(g), np.nan, np.isnan(np.stack([shifted(g, r, c) for r, c in EIGHT])).any(axis=0)))
    start = dem.join(edge.select(*KEY, F.col("value").alias("edge")), KEY)
    now = cut(start.select(*KEY, F.when(F.col("edge") == 1, F.col("value")).when(F.col("value").isNotNull(), float("inf")).alias("value")))

    def relax(z, w):
        inner = np.zeros(z.shape, bool)
        inner[1:-1, 1:-1] = True
        while True:
            least = np.nanmin(np.stack([np.where(np.isnan(shifted(w, r, c)), np.inf, shifted(w, r, c)) for r, c in EIGHT]), axis=0)
            new = np.where(inner & (w > z), np.maximum(z, np.minimum(w, least + fix_flats)), w)
            if np.array_equal(new, w, equal_nan=True):
                return w
            w = new

    while True:
        new = cut(tiled([dem, now], 1, relax, tile=tile))
        changed = new.join(now.withColumnRenamed("value", "old"), KEY).where(~F.col("value").eqNullSafe(F.col("old"))).limit(1).isEmpty()
        now = new
        if changed:
            return now


register("FillDepressions", HYDRO, fill_depressions, "Fills depressions; the surface is that of a priority flood.")
register("FillDepressionsWangAndLiu", HYDRO, fill_depressions, "Fills depressions; the surface is that of a priority flood.")


@tool("DepthInSink", HYDRO)
def depth_in_sink(dem: DataFrame) -> DataFrame:
    """Depth below the filled surface; NoData where there is none."""
    filled = fill_depressions(dem).withColumnRenamed("value", "filled")
    return dem.join(filled, KEY).select(*KEY, F.when(F.col("filled") > F.col("value"), F.col("filled") - F.col("value")).alias("value"))


@tool("UpslopeDepressionStorage", HYDRO)
def upslope_depression_storage(dem: DataFrame) -> DataFrame:
    """Mean depth of depressions over the cells that drain to each."""
    depth = cut(depth_in_sink(dem))
    f = _with(d8_pointer(fill_depressions(dem, 0.0001)), depth, "s").withColumns({"s": F.coalesce("s", F.lit(0.0)), "n": F.lit(1.0)})
    return _cells(doubled(f, up={"s": "sum", "n": "sum"}), F.col("s") / F.col("n"))


@tool("Clump", GIS)
def clump(cells: DataFrame, diag: bool = False, zero_back: bool = False) -> DataFrame:
    """Patches of equal value, numbered from 1 in the order of their first cell by row and column."""
    from pyspark.sql import Window as W

    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diag else [])
    own = cells.where("value is not null and value <> 0" if zero_back else "value is not null").select(*KEY, "value", node().alias("id"))
    edges = None
    for r, c in steps:
        near = own.select(node(F.col("row") - r, F.col("col") - c).alias("id"), F.col("value").alias("v2"), F.col("id").alias("b"))
        e = own.join(near, "id").where("value = v2").select(F.col("id").alias("a"), "b")
        edges = e if edges is None else edges.union(e)
    found = components(edges)
    rooted = own.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    roots = rooted.select("root").distinct()
    # numbers follow the roots' order, in two levels: blocks of rows, then within a block
    block = F.shiftright("root", 40)
    sizes = roots.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = roots.withColumn("block", block).join(sizes.select("block", before.alias("before")), "block")
    numbered = numbered.select("root", (F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("root"))).alias("value"))
    return _cells(rooted.select(*KEY, "root").join(numbered, "root"), F.col("value"))


@tool("Sink", HYDRO)
def sink(dem: DataFrame) -> DataFrame:
    """Depressions, each with its number."""
    depth = depth_in_sink(dem)
    return clump(depth.withColumn("value", F.when(F.col("value") > 0, 1.0)), diag=True)


@tool("SnapPourPoints", HYDRO)
def snap_pour_points(points: DataFrame, flow_accum: DataFrame, snap_cells: int) -> DataFrame:
    """Points (id, row, col) moved to the cell of greatest accumulation within a square."""
    d = F.explode(F.sequence(F.lit(-snap_cells), F.lit(snap_cells)))
    around = points.withColumn("dr", d).withColumn("dc", d).select("id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    best = around.join(flow_accum.where("value is not null"), KEY).groupBy("id").agg(F.min_by(F.struct(*KEY), F.struct((-F.col("value")).alias("v"), *KEY)).alias("at"))
    return best.select("id", "at.row", "at.col")


@tool("JensonSnapPourPoints", HYDRO)
def jenson_snap_pour_points(points: DataFrame, streams: DataFrame, snap_cells: int) -> DataFrame:
    """Points (id, row, col) moved to the nearest stream cell within a square."""
    d = F.explode(F.sequence(F.lit(-snap_cells), F.lit(snap_cells)))
    around = points.withColumn("dr", d).withColumn("dc", d).select("id", (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d"), (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    best = around.join(streams.where("value > 0").select(*KEY), KEY).groupBy("id").agg(F.min_by(F.struct(*KEY), F.struct("d", *KEY)).alias("at"))
    return best.select("id", "at.row", "at.col")


# -- distances --------------------------------------------------------------------------------------------------


def _nearest(cells: DataFrame, tile: int = 128) -> DataFrame:
    """Row and column of the nearest target cell (not 0, not NoData), by passing candidates between neighbours.

    Tiles pass candidates to their own fixpoint, then exchange edges until none changes.
    """
    v = F.col("value")
    target = v.isNotNull() & (v != 0)
    now = cut(cells.select(*KEY, F.when(target, F.col("row").cast("double")).alias("tr"), F.when(target, F.col("col").cast("double")).alias("tc"), F.col("row").cast("double").alias("r0"), F.col("col").cast("double").alias("c0")))

    def spread(r0, c0, tr, tc):
        best = np.where(np.isnan(tr), np.inf, (tr - r0) ** 2 + (tc - c0) ** 2)
        while True:
            changed = False
            for r, c in EIGHT:
                nr, nc = shifted(tr, r, c), shifted(tc, r, c)
                d = np.where(np.isnan(nr), np.inf, (nr - r0) ** 2 + (nc - c0) ** 2)
                better = (d < best) | ((d == best) & np.isfinite(d) & ((nr < tr) | ((nr == tr) & (nc < tc))))
                if better.any():
                    tr, tc, best, changed = np.where(better, nr, tr), np.where(better, nc, tc), np.where(better, d, best), True
            if not changed:
                return [tr, tc]

    while True:
        pick = lambda c: now.select(*KEY, F.col(c).alias("value"))
        new = cut(tiled([pick("r0"), pick("c0"), pick("tr"), pick("tc")], 1, spread, names=("tr", "tc"), tile=tile).withColumns({"r0": F.col("row").cast("double"), "c0": F.col("col").cast("double")}))
        old = now.select(*KEY, F.col("tr").alias("or"), F.col("tc").alias("oc"))
        same = new.join(old, KEY).where(~(F.col("tr").eqNullSafe(F.col("or")) & F.col("tc").eqNullSafe(F.col("oc")))).limit(1).isEmpty()
        now = new
        if same:
            return now


@tool("EuclideanDistance", GIS)
def euclidean_distance(cells: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Distance to the nearest cell that is neither 0 nor NoData."""
    n = _nearest(cells)
    return _cells(n, F.sqrt(F.pow(F.col("tr") - F.col("r0"), 2.0) + F.pow(F.col("tc") - F.col("c0"), 2.0)) * resolution)


@tool("EuclideanAllocation", GIS)
def euclidean_allocation(cells: DataFrame) -> DataFrame:
    """Value of the nearest cell that is neither 0 nor NoData."""
    n = _nearest(cells).select(*KEY, F.col("tr").cast("int").alias("r"), F.col("tc").cast("int").alias("c"))
    own = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "value")
    return n.join(own, ["r", "c"], "left").select(*KEY, "value")


@tool("BufferRaster", GIS)
def buffer_raster(cells: DataFrame, size: float, resolution: float = 1.0) -> DataFrame:
    """1 within a distance of the target cells, else 0."""
    return euclidean_distance(cells, resolution).withColumn("value", F.coalesce((F.col("value") <= size).cast("double"), F.lit(0.0)))


@tool("ElevationAboveStreamEuclidean", HYDRO)
def elevation_above_stream_euclidean(dem: DataFrame, streams: DataFrame) -> DataFrame:
    """Elevation above the nearest stream cell."""
    beds = streams.select(*KEY, F.col("value").alias("s")).join(dem, KEY).select(*KEY, F.when(F.col("s") > 0, F.col("value") + 1e6).otherwise(0.0).alias("value"))
    near = euclidean_allocation(beds).select(*KEY, (F.col("value") - 1e6).alias("bed"))
    return dem.join(near, KEY).select(*KEY, (F.col("value") - F.col("bed")).alias("value"))


@tool("CostDistance", GIS)
def cost_distance(source: DataFrame, cost: DataFrame, resolution: float = 1.0, tile: int = 128) -> DataFrame:
    """Least accumulated cost from the source cells, a step costing the mean of its two cells' costs."""
    now = cut(cost.join(source.where("value > 0").select(*KEY, F.lit(True).alias("src")), KEY, "left").select(*KEY, F.when(F.col("src"), 0.0).when(F.col("value").isNotNull(), float("inf")).alias("value")))

    def relax(c, w):
        while True:
            new = w
            for r, k in EIGHT:
                step = (c + shifted(c, r, k)) / 2 * resolution * (math.sqrt(2) if r and k else 1.0)
                new = np.fmin(new, np.where(np.isnan(w), np.nan, shifted(w, r, k) + step))
            if np.array_equal(new, w, equal_nan=True):
                return w
            w = new

    while True:
        new = cut(tiled([cost, now], 1, relax, tile=tile))
        same = new.join(now.withColumnRenamed("value", "old"), KEY).where(~F.col("value").eqNullSafe(F.col("old"))).limit(1).isEmpty()
        now = new
        if same:
            return now


@tool("CostAllocation", GIS)
def cost_allocation(source: DataFrame, backlink: DataFrame) -> DataFrame:
    """The value of the source cell that each cell's backlinks lead to; NoData where they lead to none."""
    f = _to_stream(backlink, source)
    ends = source.where("value > 0").select(node().alias("root"), F.col("value").alias("own"))
    return _cells(doubled(f).select(*KEY, "root").join(ends, "root", "left"), F.col("own"))
