"""Figures of volumes and of what compression loses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..storage import written


def quantiles(values: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """One row: `n`, `most` and a column per named point, exact and linear between ranks; nulls are left out.

    Distinct values are counted and range-sorted, and only the ranges that hold an asked rank are
    opened, so no task keeps all values. Without values, n is 0 and the rest null.
    """
    counts = values.select(F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    dealt = written(counts.repartitionByRange("v").select("v", "c", F.spark_partition_id().alias("part")), "ranks")
    parts = dealt.groupBy("part").agg(F.sum("c").alias("held"), F.max("v").alias("most"))
    summary = parts.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n"), F.max("most").alias("most"))

    # one row per range: as many as the shuffle has partitions
    so_far, all_parts = Window.orderBy("part"), Window.partitionBy()
    starts = parts.select("part", "held", (F.sum("held").over(so_far) - F.col("held")).alias("start"), F.sum("held").over(all_parts).alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in points.items()]))
    ranks = starts.select("*", asked.alias("a")).withColumn("at", F.col("a.q") * (F.col("total") - 1))
    ranks = ranks.select("part", "held", "start", "a.name", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    ranks = ranks.filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("held")))

    opened = dealt.join(ranks.select("part", "start").distinct(), "part")
    placed = opened.select("part", "v", "c", (F.col("start") + F.sum("c").over(Window.partitionBy("part").orderBy("v")) - F.col("c")).alias("first"))
    hit = placed.join(ranks.select("part", "name", "at", "rank"), "part").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("c")))
    share = F.col("at") - F.floor("at")
    found = hit.groupBy("name", "at").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("name", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("p"))
    named = found.agg(*[F.max(F.when(F.col("name") == name, F.col("p"))).alias(name) for name in points])
    return _beside(summary, named)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables of one row with different columns as one row."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def error_figures(voxels: DataFrame, keys: list[str], limit: float = 32.0) -> DataFrame:
    """Per tile: how far `rebuilt` is from `density`. Percentiles are exact, linear between ranks."""
    e = F.abs(F.col("rebuilt") - F.col("density"))
    return voxels.withColumn("e", e).groupBy(*keys).agg(
        F.max("e").alias("max_abs"),
        F.avg("e").alias("mean_abs"),
        F.percentile("e", 0.5).alias("median_abs"),
        F.percentile("e", 0.99).alias("p99_abs"),
        F.percentile("e", 0.999).alias("p999_abs"),
        F.avg(F.col("e") * F.col("e")).alias("mse"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.when(F.col("density") > limit, 1.0).otherwise(0.0)).alias("clipped_fraction"),
        F.avg(F.when((F.col("rebuilt") == 0) & (F.col("density") > 0), 1.0).otherwise(0.0)).alias("zero_loss_fraction"),
        F.percentile("density", 0.999).alias("p99"),
    )


def error_summary(figures: DataFrame, limit: float = 32.0, trim: float = 0.999) -> DataFrame:
    """All tiles: typical and worst errors, and the limit that the median tile asks for."""
    return figures.agg(
        F.count("*").alias("tiles"),
        F.max("max_abs").alias("max_abs"),
        F.percentile("median_abs", 0.5).alias("median_abs"),
        F.percentile("p99_abs", 0.5).alias("p99_abs"),
        F.percentile("max_abs", trim).alias("trimmed_max_abs"),
        F.avg("mean_abs").alias("mean_abs"),
        F.avg("rmse").alias("rmse"),
        F.avg("mse").alias("mse"),
        F.avg("clipped_fraction").alias("clipped_fraction"),
        F.avg("zero_loss_fraction").alias("zero_loss_fraction"),
        F.percentile("p99", 0.5).alias("recommended"),
        F.avg(F.when(F.col("p99") > limit, 1.0).otherwise(0.0)).alias("fraction_above_limit"),
    )


def worst_tiles(figures: DataFrame, by: str = "p99", n: int = 5) -> DataFrame:
    """The n tiles with the largest figure; ties by tile."""
    keys = [c for c in ("zoom", "tx", "ty") if c in figures.columns]
    return figures.orderBy(F.desc(by), *keys).limit(n)


def voxel_partials(voxels: DataFrame, keys: list[str], near: float) -> DataFrame:
    """Mergeable figures per tile: count, sum, sum of squares, ends, non-zero, and at or above `near`."""
    d = F.col("density").cast("double")
    return voxels.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.sum(d * d).alias("squares"), F.min(d).alias("least"), F.max(d).alias("most"), F.count_if(d != 0).alias("nonzero"), F.count_if(d >= near).alias("near_max"))


def merged(partials: DataFrame) -> DataFrame:
    """Figures of all tiles from their partials; the variance is the mean square less the squared mean."""
    sums = partials.agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "nonzero", "near_max")], F.min("least").alias("least"), F.max("most").alias("most"))
    mean = F.col("total") / F.col("n")
    return sums.select("n", "least", "most", mean.alias("mean"), (F.col("squares") / F.col("n") - mean * mean).alias("variance"), "nonzero", "near_max", (F.col("near_max") / F.col("n") * 100).alias("near_percent"))


def canvas_figures(canvas: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    whole = canvas.agg(F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.count_if(v > 0).alias("nonzero"))
    return _beside(whole, quantiles(canvas.filter(v > 0), value, {"nonzero_median": 0.5}).select("nonzero_median"))


def density_percentiles(cells: DataFrame) -> DataFrame:
    """Percentiles of the analysis extinction over cloudy cells (clc in percent, qc), and the limit they suggest."""
    cloudy = cells.filter(physics.is_cloud("clc", "qc")).select(physics.extinction_analysis("qc", F.col("clc") / 100.0).alias("beta"))
    names = {f"p{q}": q / 100 for q in (50, 90, 95, 98, 99)}
    row = quantiles(cloudy, "beta", names)
    return row.select("n", *names, "most", F.least(F.greatest("p98", F.lit(40.0)), F.lit(80.0)).alias("suggested"))


def messages_by_variable(messages: DataFrame) -> DataFrame:
    """Inventory of decoded messages (short_name, type_of_level, level): count, ends and the list of levels."""
    return messages.groupBy("short_name", "type_of_level").agg(F.count("*").alias("n"), F.min("level").alias("least"), F.max("level").alias("most"), F.array_sort(F.collect_set("level")).alias("levels"))


def exported_layer(canvas: DataFrame, value: str = "value") -> DataFrame:
    """A layer as an 8-bit picture: square root, scaled by its largest value. The maximum is one row."""
    most = canvas.agg(F.sqrt(F.max(value)).alias("_most"))
    scaled = F.coalesce(F.try_divide(F.sqrt(F.greatest(F.col(value), F.lit(0.0))), F.col("_most")), F.lit(0.0))
    return canvas.join(F.broadcast(most)).withColumn("grey", F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")).drop("_most")


#: The types of level that an inventory of a file's structure looks for.
LEVEL_TYPES = ("surface", "heightAboveGround", "atmosphere", "isobaricInhPa", "nominalTop")


def structure(messages: DataFrame, types: tuple[str, ...] = LEVEL_TYPES) -> DataFrame:
    """Decoded messages (short_name, type_of_level, level) by type of level: each variable with the size of its axis of levels; other types are left out."""
    shapes = messages.filter(F.col("type_of_level").isin(*types)).groupBy("type_of_level", "short_name").agg(F.count_distinct("level").alias("n_levels"))
    return shapes.groupBy("type_of_level").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("short_name", "n_levels"))).alias("variables"))


def shrunk_side(height: int, width: int, most: int) -> tuple[int, int]:
    """Height and width of a picture that is shrunk to fit a square, its proportions kept; smaller ones stay."""
    if max(height, width) <= most:
        return height, width
    fit = lambda a, b: max(1, round(most * a / b))
    return (most, fit(width, height)) if height > width else (fit(height, width), most)


def shrunk(picture: DataFrame, height: int, width: int, most: int, value: str = "grey") -> DataFrame:
    """An 8-bit picture (py, px, value) shrunk to fit a square of `most`, by the Lanczos kernel of three lobes.

    One axis after the other, rounded to 8 bits in between; weights of pixels beyond the edge are left
    out and the rest sums to one. A pixel goes to the few outputs that it counts for, which are summed
    before the shuffle.
    """
    h, w = shrunk_side(height, width, most)
    out = picture.select("py", "px", value)
    for axis, other, old, new in (("px", "py", width, w), ("py", "px", height, h)):
        if new == old:
            continue
        scale, at = old / new, F.col(axis) + 0.5
        reach = F.sequence(F.greatest(F.floor(at / scale - 3.5), F.lit(0)).cast("int"), F.least(F.ceil(at / scale + 2.5), F.lit(new - 1)).cast("int"))
        far = out.select(other, value, at.alias("_at"), F.explode(reach).alias(axis)).withColumn("_d", (F.col("_at") / scale - F.col(axis) - 0.5) * F.lit(math.pi)).filter(F.abs("_d") < 3 * math.pi)
        weight = F.when(F.col("_d") == 0, 1.0).otherwise(F.sin("_d") * F.sin(F.col("_d") / 3) * 3 / F.col("_d") / F.col("_d"))
        mean = F.sum(F.col(value) * weight) / F.sum(weight)
        out = far.groupBy(other, axis).agg(F.least(F.greatest(F.floor(F.round(mean, 6) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(value))
    return out.select("py", "px", value)
