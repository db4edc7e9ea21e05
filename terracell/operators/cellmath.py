"""Pointwise operators on cell tables (row, col, value; a null value is NoData).

A raster with a constant is one projection; two rasters are an equi-join on (row, col), null where either
is null.  Everything stays in generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..registry import register, tool

MATH = "Math and Stats"
GIS = "GIS Analysis"
DATA = "Data Tools"
TERRAIN = "Geomorphometric Analysis"
IMAGE = "Image Processing"
KEY = ["row", "col"]

#: Tool -> expression over ``value``.  Out-of-domain logarithms and arc functions are NoData;
#: square roots and reciprocals are not guarded, so NaN and infinity survive.
UNARY: dict[str, str] = {
    "AbsoluteValue": "abs(value)",
    "ArcCos": "if(value between -1 and 1, acos(value), null)",
    "Arcosh": "if(value between -1 and 1, acosh(value), null)",
    "ArcSin": "if(value between -1 and 1, asin(value), null)",
    "ArcTan": "atan(value)",
    "Arsinh": "if(value between -1 and 1, asinh(value), null)",
    "Artanh": "atanh(value)",
    "Ceil": "double(ceil(value))",
    "Cos": "cos(value)",
    "Cosh": "cosh(value)",
    "Decrement": "value - 1",
    "Exp": "exp(value)",
    "Exp2": "pow(2, value)",
    "Floor": "double(floor(value))",
    "Increment": "value + 1",
    "Ln": "if(value > 0, ln(value), null)",
    "Log10": "if(value > 0, log10(value), null)",
    "Log2": "if(value > 0, log2(value), null)",
    "Negate": "if(value <> 0, -value, value)",
    "Reciprocal": "if(value = 0, double('Infinity'), 1 / nullif(value, 0))",
    "Round": "round(value)",
    "Sin": "sin(value)",
    "Sinh": "sinh(value)",
    "Square": "value * value",
    "SquareRoot": "sqrt(value)",
    "Tan": "tan(value)",
    "Tanh": "tanh(value)",
    "ToDegrees": "degrees(value)",
    "ToRadians": "radians(value)",
}

#: Tool -> expression over ``a`` and ``b``, which are known not to be null.
BINARY: dict[str, str] = {
    "Add": "a + b",
    "Subtract": "a - b",
    "Multiply": "a * b",
    "Divide": "a / nullif(b, 0)",
    "Modulo": "a % nullif(b, 0)",
    "IntegerDivision": "double(bigint(a) div nullif(bigint(b), 0))",
    "Power": "pow(a, b)",
    "Atan2": "atan2(a, b)",
    "Max": "greatest(a, b)",
    "Min": "least(a, b)",
    "EqualTo": "double(a = b)",
    "NotEqualTo": "double(a <> b)",
    "And": "double(a <> 0 and b <> 0)",
    "Or": "double(a <> 0 or b <> 0)",
    "Not": "double(a <> 0 and b = 0)",
    "Xor": "double((a <> 0) <> (b <> 0))",
}


def unary(name: str, cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.expr(UNARY[name]).cast("double"))


def combined(a: DataFrame, b: DataFrame | float, how: str, order: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``how`` applied to a cell table and another, or a constant; null where either is null."""
    if isinstance(b, DataFrame):
        both = a.select(*KEY, F.col("value").alias(order[0])).join(b.select(*KEY, F.col("value").alias(order[1])), KEY)
    else:
        both = a.select(*KEY, F.col("value").alias(order[0]), F.lit(float(b)).alias(order[1]))
    return both.select(*KEY, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.expr(how)).cast("double").alias("value"))


def binary(name: str, a: DataFrame | float, b: DataFrame | float) -> DataFrame:
    if isinstance(a, DataFrame):
        return combined(a, b, BINARY[name])
    if not isinstance(b, DataFrame):
        raise ValueError("one input must be a raster")
    return combined(b, a, BINARY[name], ("b", "a"))


for _name in UNARY:
    register(_name, MATH, (lambda n: lambda cells: unary(n, cells))(_name), f"{_name} of every cell.")
for _name in BINARY:
    register(_name, MATH, (lambda n: lambda a, b: binary(n, a, b))(_name), f"{_name} of two rasters, or of a raster and a constant.")
for _name in ("Add", "Divide", "Multiply", "Subtract"):
    register(f"InPlace{_name}", MATH, (lambda n: lambda a, b: binary(n, a, b))(_name), f"{_name}, the result standing for the first raster.")


@tool("GreaterThan", MATH)
def greater_than(a: DataFrame | float, b: DataFrame | float, incl_equals: bool = False) -> DataFrame:
    """1 where the first is greater than the second (or equal, if asked), else 0."""
    how = "double(a >= b)" if incl_equals else "double(a > b)"
    return combined(a, b, how) if isinstance(a, DataFrame) else combined(b, a, how, ("b", "a"))


@tool("LessThan", MATH)
def less_than(a: DataFrame | float, b: DataFrame | float, incl_equals: bool = False) -> DataFrame:
    """1 where the first is less than the second (or equal, if asked), else 0."""
    how = "double(a <= b)" if incl_equals else "double(a < b)"
    return combined(a, b, how) if isinstance(a, DataFrame) else combined(b, a, how, ("b", "a"))


@tool("IsNoData", MATH)
def is_nodata(cells: DataFrame) -> DataFrame:
    """1 for NoData cells, 0 for others."""
    return cells.withColumn("value", F.col("value").isNull().cast("double"))


@tool("Truncate", MATH)
def truncate(cells: DataFrame, num_decimals: int = 0) -> DataFrame:
    """Values cut, towards zero, to a number of decimals."""
    scale = 10.0**num_decimals
    return cells.withColumn("value", F.signum("value") * F.floor(F.abs("value") * scale) / F.lit(scale))


@tool("RasterCalculator", "Plug-ins")
def raster_calculator(statement: str, **rasters: DataFrame) -> DataFrame:
    """A SQL expression over rasters joined by cell, each under its keyword's name."""
    joined = None
    for name, cells in rasters.items():
        own = cells.select(*KEY, F.col("value").alias(name))
        joined = own if joined is None else joined.join(own, KEY)
    if joined is None:
        raise ValueError("at least one raster is needed")
    known = F.lit(True)
    for name in rasters:
        known = known & F.col(name).isNotNull()
    return joined.select(*KEY, F.when(known, F.expr(statement)).cast("double").alias("value"))


@tool("ConditionalEvaluation", "Plug-ins")
def conditional_evaluation(cells: DataFrame, statement: str, true: float | None, false: float | None) -> DataFrame:
    """One of two values by a SQL condition over value, row and col; NoData stays."""
    picked = F.when(F.expr(statement), F.lit(true).cast("double")).otherwise(F.lit(false).cast("double"))
    return cells.withColumn("value", F.when(F.col("value").isNotNull(), picked))


@tool("ConvertNodataToZero", DATA)
def convert_nodata_to_zero(cells: DataFrame) -> DataFrame:
    """NoData becomes 0."""
    return cells.withColumn("value", F.coalesce("value", F.lit(0.0)))


@tool("SetNodataValue", DATA)
def set_nodata_value(cells: DataFrame, back_value: float = 0.0) -> DataFrame:
    """Cells of one value become NoData."""
    return cells.withColumn("value", F.when(F.col("value") != back_value, F.col("value")))


@tool("ModifyNoDataValue", DATA)
def modify_nodata_value(cells: DataFrame, new_value: float = -32768.0) -> DataFrame:
    """The number that a sink writes for NoData, as a column; cells stay as they are."""
    return cells.withColumn("nodata", F.lit(float(new_value)))


@tool("NewRasterFromBase", DATA)
def new_raster_from_base(base: DataFrame, value: float | None = None) -> DataFrame:
    """A raster of one value on the base's grid."""
    return base.select(*KEY, F.lit(value).cast("double").alias("value"))


@tool("UpdateNodataCells", GIS)
def update_nodata_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """NoData cells of the first raster take the second's values."""
    both = a.join(b.select(*KEY, F.col("value").alias("other")), KEY, "left")
    return both.select(*KEY, F.coalesce("value", "other").alias("value"))


@tool("RasterCellAssignment", GIS)
def raster_cell_assignment(cells: DataFrame, assign: str = "column", north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Each cell's column, row, x or y."""
    what = {"column": F.col("col"), "row": F.col("row"), "x": west + (F.col("col") + 0.5) * resolution, "y": north - (F.col("row") + 0.5) * resolution}
    return cells.withColumn("value", what[assign].cast("double"))


@tool("CreatePlane", GIS)
def create_plane(base: DataFrame, gradient: float = 15.0, aspect: float = 90.0, constant: float = 0.0, resolution: float = 1.0, rows: int = 0) -> DataFrame:
    """A plane of a gradient and an aspect, both in degrees, over the base's grid."""
    import math

    slope, turn = math.tan(math.radians(gradient)), math.radians((aspect + 180.0) % 360.0)
    x, y = (F.col("col") + 0.5) * resolution, (F.lit(rows) - F.col("row") - 0.5) * resolution
    return base.select(*KEY, (math.sin(turn) * slope * x + math.cos(turn) * slope * y + constant).cast("double").alias("value"))


def _in_order(ranges: list[tuple[float, float, float]], value: Column, otherwise: Column) -> Column:
    found: Column | None = None
    for new, low, high in ranges:
        test = (value >= low) & (value < high)
        found = F.when(test, F.lit(float(new))) if found is None else found.when(test, F.lit(float(new)))
    return otherwise if found is None else found.otherwise(otherwise)


@tool("Reclass", GIS)
def reclass(cells: DataFrame, ranges: list[tuple[float, float, float]], assign: bool = False) -> DataFrame:
    """(new, from, to) ranges, to exclusive, the first that holds a value wins; with ``assign``, (new, old) pairs.

    Values in no range pass through.
    """
    v = F.col("value")
    if assign:
        ranges = [(n, o, None) for n, o in ranges]
        out = v
        for new, old, _ in reversed(ranges):
            out = F.when(v == float(old), F.lit(float(new))).otherwise(out)
    else:
        out = _in_order(ranges, v, v)
    return cells.withColumn("value", F.when(v.isNotNull(), out))


@tool("ReclassFromFile", GIS)
def reclass_from_file(cells: DataFrame, table: DataFrame, most: int = 10_000) -> DataFrame:
    """Reclass by a table (new, lo, hi), of which the first matching row in the order of lo, hi wins."""
    rows = table.orderBy("lo", "hi").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a reclass table has at most {most} ranges")
    return reclass(cells, [(r["new"], r["lo"], r["hi"]) for r in rows])


@tool("ReclassEqualInterval", GIS)
def reclass_equal_interval(cells: DataFrame, interval: float, start: float | None = None, end: float | None = None) -> DataFrame:
    """Values between start and end are floored to a multiple of the interval; others pass through."""
    v = F.col("value")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (v >= start)
    if end is not None:
        inside = inside & (v <= end)
    return cells.withColumn("value", F.when(inside, F.floor(v / interval) * F.lit(float(interval))).otherwise(v))


# -- stacks of rasters ------------------------------------------------------------------------------------------


def stacked(layers: list[DataFrame]) -> DataFrame:
    """Layers as one table (row, col, value, layer), the first layer being 0."""
    out = None
    for i, cells in enumerate(layers):
        own = cells.select(*KEY, "value", F.lit(i).alias("layer"))
        out = own if out is None else out.unionByName(own)
    return out


def overlay(layers: list[DataFrame], how: Column) -> DataFrame:
    return stacked(layers).groupBy(*KEY).agg(how.cast("double").alias("value"))


_OVERLAYS = {
    "SumOverlay": lambda: F.sum("value"),
    "AverageOverlay": lambda: F.avg("value"),
    "MaxOverlay": lambda: F.max("value"),
    "MinOverlay": lambda: F.min("value"),
    "MaxAbsoluteOverlay": lambda: F.max(F.abs("value")),
    "MinAbsoluteOverlay": lambda: F.min(F.abs("value")),
    "MultiplyOverlay": lambda: F.aggregate(F.array_sort(F.collect_list(F.struct("layer", "value"))), F.when(F.count("value") > 0, F.lit(1.0)), lambda x, s: x * F.coalesce(s["value"], F.lit(1.0))),
    "HighestPosition": lambda: F.min_by(F.when(F.col("value").isNotNull(), F.col("layer") + 1), F.when(F.col("value").isNotNull(), F.struct((-F.col("value")).alias("v"), "layer"))),
    "LowestPosition": lambda: F.min_by(F.when(F.col("value").isNotNull(), F.col("layer") + 1), F.when(F.col("value").isNotNull(), F.struct("value", "layer"))),
}
for _name, _how in _OVERLAYS.items():
    register(_name, GIS, (lambda h: lambda layers: overlay(layers, h()))(_how), f"{_name} of a list of rasters; NoData layers are skipped.")


@tool("CountIf", GIS)
def count_if(layers: list[DataFrame], value: float) -> DataFrame:
    """In how many layers a cell has the value; NoData if in none."""
    n = F.count_if(F.col("value") == value)
    return overlay(layers, F.when(n > 0, n))


def _percent(layers: list[DataFrame], comparison: DataFrame, test) -> DataFrame:
    both = stacked(layers).join(comparison.select(*KEY, F.col("value").alias("other")), KEY)
    n = F.count(F.when(F.col("other").isNotNull(), F.col("value")))
    share = F.when(n > 0, 100.0 * F.count_if(test(F.col("value"), F.col("other"))) / n).otherwise(0.0)
    out = both.groupBy(*KEY).agg(share.alias("value"), F.max("other").alias("other"))
    return out.select(*KEY, F.when(F.col("other").isNotNull(), F.col("value")).alias("value"))


@tool("PercentEqualTo", GIS)
def percent_equal_to(layers: list[DataFrame], comparison: DataFrame) -> DataFrame:
    """Percentage of the layers with data that equal the comparison raster."""
    return _percent(layers, comparison, lambda v, o: v == o)


@tool("PercentGreaterThan", GIS)
def percent_greater_than(layers: list[DataFrame], comparison: DataFrame) -> DataFrame:
    """Percentage of the layers with data that exceed the comparison raster."""
    return _percent(layers, comparison, lambda v, o: v > o)


@tool("PercentLessThan", GIS)
def percent_less_than(layers: list[DataFrame], comparison: DataFrame) -> DataFrame:
    """Percentage of the layers with data that are below the comparison raster."""
    return _percent(layers, comparison, lambda v, o: v < o)


@tool("PickFromList", GIS)
def pick_from_list(layers: list[DataFrame], position: DataFrame) -> DataFrame:
    """The value of the layer whose number, from 0, the position raster has."""
    places = position.select(*KEY, F.floor("value").cast("int").alias("layer"))
    return places.join(stacked(layers), [*KEY, "layer"], "left").select(*KEY, "value")


@tool("WeightedSum", GIS)
def weighted_sum(layers: list[DataFrame], weights: list[float]) -> DataFrame:
    """Sum by weights that are scaled to 1; NoData in any layer gives NoData."""
    total = float(sum(weights))
    w = F.element_at(F.array(*[F.lit(x / total) for x in weights]), F.col("layer") + 1)
    return overlay(layers, F.when(F.count("value") == len(layers), F.sum(w * F.col("value"))))


@tool("WeightedOverlay", GIS)
def weighted_overlay(factors: list[DataFrame], weights: list[float], cost: list[bool] | None = None, constraints: list[DataFrame] | None = None, scale_max: float = 1.0) -> DataFrame:
    """Factors stretched to 0..1, costs reversed, summed by weights; constraints of 0 or less give 0."""
    total = float(sum(weights))
    cost = cost or [False] * len(factors)
    stack = stacked(factors)
    bounds = stack.groupBy("layer").agg(F.min("value").alias("low"), F.max("value").alias("high"))  # a row a layer
    unit = (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    turned = F.when(F.element_at(F.array(*[F.lit(c) for c in cost]), F.col("layer") + 1), 1 - unit).otherwise(unit)
    w = F.element_at(F.array(*[F.lit(x / total) for x in weights]), F.col("layer") + 1)
    out = stack.join(F.broadcast(bounds), "layer").groupBy(*KEY).agg(F.when(F.count("value") == len(factors), F.sum(w * turned * scale_max)).alias("value"))
    for c in constraints or []:
        out = out.join(c.select(*KEY, F.col("value").alias("limit")), KEY)
        out = out.select(*KEY, F.when(F.col("limit").isNull(), None).when(F.col("limit") <= 0, 0.0).otherwise(F.col("value")).alias("value"))
    return out


@tool("AggregateRaster", GIS)
def aggregate_raster(cells: DataFrame, agg_factor: int = 2, how: str = "mean") -> DataFrame:
    """Blocks of cells to one cell: mean, sum, maximum, minimum or range."""
    kinds = {"mean": F.avg("value"), "sum": F.sum("value"), "maximum": F.max("value"), "minimum": F.min("value"), "range": F.max("value") - F.min("value")}
    return cells.groupBy(F.floor(F.col("row") / agg_factor).cast("int").alias("row"), F.floor(F.col("col") / agg_factor).cast("int").alias("col")).agg(kinds[how].alias("value"))


@tool("RgbToIhs", IMAGE)
def rgb_to_ihs(red: DataFrame, green: DataFrame, blue: DataFrame) -> DataFrame:
    """Intensity, hue (0 to 2 pi) and saturation of three bands of 0 to 255."""
    j = red.select(*KEY, (F.col("value") / 255).alias("r")).join(green.select(*KEY, (F.col("value") / 255).alias("g")), KEY).join(blue.select(*KEY, (F.col("value") / 255).alias("b")), KEY)
    i = F.col("r") + F.col("g") + F.col("b")
    low = F.least("r", "g", "b")
    d = F.nullif(i - 3 * low, F.lit(0.0))
    h = F.when(low == F.col("b"), (F.col("g") - F.col("b")) / d).when(low == F.col("r"), (F.col("b") - F.col("r")) / d + 1).otherwise((F.col("r") - F.col("g")) / d + 2)
    return j.select(*KEY, (i / 3).alias("intensity"), F.coalesce(h * 2 * 3.141592653589793 / 3, F.lit(0.0)).alias("hue"), F.coalesce(1 - 3 * low / F.nullif(i, F.lit(0.0)), F.lit(0.0)).alias("saturation"))


@tool("CreateColourComposite", IMAGE)
def create_colour_composite(red: DataFrame, green: DataFrame, blue: DataFrame) -> DataFrame:
    """Three bands of 0 to 255 packed as alpha, blue, green, red bytes of one number."""
    band = lambda n: F.least(F.greatest(F.floor(F.col(n)), F.lit(0)), F.lit(255)).cast("long")
    j = red.select(*KEY, F.col("value").alias("r")).join(green.select(*KEY, F.col("value").alias("g")), KEY).join(blue.select(*KEY, F.col("value").alias("b")), KEY)
    packed = F.lit(255 << 24).bitwiseOR(F.shiftleft(band("b"), 16)).bitwiseOR(F.shiftleft(band("g"), 8)).bitwiseOR(band("r"))
    known = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    return j.select(*KEY, F.when(known, packed.cast("double")).alias("value"))


@tool("SplitColourComposite", IMAGE)
def split_colour_composite(cells: DataFrame) -> DataFrame:
    """The red, green and blue bytes of packed colours."""
    v = F.col("value").cast("long")
    byte = lambda n: F.shiftright(v, n).bitwiseAND(F.lit(255)).cast("double")
    return cells.select(*KEY, byte(0).alias("red"), byte(8).alias("green"), byte(16).alias("blue"))


@tool("NormalizedDifferenceIndex", IMAGE)
def normalized_difference_index(a: DataFrame, b: DataFrame, correction: float = 0.0) -> DataFrame:
    """(a - b) / (a + b + correction); 0 where that sum is 0."""
    return combined(a, b, f"coalesce((a - b) / nullif(a + b + {float(correction)!r}D, 0), 0)")


@tool("ChangeVectorAnalysis", IMAGE)
def change_vector_analysis(date1: list[DataFrame], date2: list[DataFrame]) -> DataFrame:
    """Magnitude of the change over the bands, and its direction as a bit a band that grew."""
    a = stacked(date1)
    b = stacked(date2).withColumnRenamed("value", "later")
    d = F.col("later") - F.col("value")
    bits = F.sum(F.when(d > 0, F.pow(F.lit(2.0), F.col("layer"))).otherwise(0.0))
    known = F.count(d) == len(date1)
    return a.join(b, [*KEY, "layer"]).groupBy(*KEY).agg(F.when(known, F.sqrt(F.sum(d * d))).alias("magnitude"), F.when(known, bits).alias("direction"))


@tool("FlipImage", IMAGE)
def flip_image(cells: DataFrame, direction: str = "vertical", rows: int | None = None, columns: int | None = None) -> DataFrame:
    """The raster upside down, left to right, or both; sizes are read from the cells if not given."""
    if rows is None or columns is None:
        top = cells.agg(F.max("row"), F.max("col")).first()
        rows, columns = (top[0] or 0) + 1, (top[1] or 0) + 1
    row = F.lit(rows - 1) - F.col("row") if direction in ("vertical", "both") else F.col("row")
    col = F.lit(columns - 1) - F.col("col") if direction in ("horizontal", "both") else F.col("col")
    return cells.select(row.cast("int").alias("row"), col.cast("int").alias("col"), "value")


@tool("GammaCorrection", IMAGE)
def gamma_correction(cells: DataFrame, gamma: float = 0.5) -> DataFrame:
    """Values raised to a power."""
    return cells.withColumn("value", F.pow("value", F.lit(float(gamma))))


@tool("WetnessIndex", TERRAIN)
def wetness_index(sca: DataFrame, slope: DataFrame) -> DataFrame:
    """ln(sca / tan(slope)); NoData where the slope is 0."""
    return combined(sca, slope, "if(b <> 0, ln(a / tan(radians(b))), null)")


@tool("StreamPowerIndex", TERRAIN)
def stream_power_index(sca: DataFrame, slope: DataFrame, exponent: float = 1.0) -> DataFrame:
    """sca ** exponent * tan(slope)."""
    return combined(sca, slope, f"pow(a, {float(exponent)!r}D) * tan(radians(b))")


@tool("SedimentTransportIndex", TERRAIN)
def sediment_transport_index(sca: DataFrame, slope: DataFrame, sca_exponent: float = 0.4, slope_exponent: float = 1.3) -> DataFrame:
    """(n + 1) (sca / 22.13) ** n (sin(slope) / 0.0896) ** m."""
    return combined(sca, slope, f"({float(sca_exponent)!r}D + 1) * pow(a / 22.13D, {float(sca_exponent)!r}D) * pow(sin(radians(b)) / 0.0896D, {float(slope_exponent)!r}D)")


@tool("RelativeAspect", TERRAIN)
def relative_aspect(aspect: DataFrame, azimuth: float = 0.0) -> DataFrame:
    """Angle between the aspect and an azimuth, 0 to 180; flat cells (below 0) stay."""
    d = F.abs(F.col("value") - azimuth)
    return aspect.withColumn("value", F.when(F.col("value") < 0, F.col("value")).when(d > 180, 360 - d).otherwise(d))


@tool("ExtractStreams", "Stream Network Analysis")
def extract_streams(flow_accum: DataFrame, threshold: float, zero_background: bool = False) -> DataFrame:
    """1 where the accumulation is over the threshold; else NoData, or 0."""
    other = F.lit(0.0) if zero_background else F.lit(None).cast("double")
    return flow_accum.withColumn("value", F.when(F.col("value").isNull(), None).when(F.col("value") > threshold, 1.0).otherwise(other))
