"""Relational forms of the signal operators: vectors, runs, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Zero mean and unit norm; unchanged if the norm is under 1e-6."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    centred = F.transform(v, lambda x: x.cast("double") - mean)
    norm = F.sqrt(dot(centred, centred))
    return F.when(norm < 1e-6, centred).otherwise(F.transform(centred, lambda x: x / norm))


def mean_vectors(vectors: DataFrame, least: int = 2) -> DataFrame:
    """(label, dim, mean, n) over vectors of a label, if it has ``least`` or more."""
    each = vectors.select(F.col("label").cast("int").alias("label"), F.posexplode("embedding").alias("dim", "v"))
    return each.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def template_topk(vectors: DataFrame, k: int = 3, every: int = 20) -> DataFrame:
    """(vec_id, label, rank): the ``k`` labels whose normalised mean vector is closest to every ``every``-th vector.

    Every query meets every template: the templates, one for each label, are
    collected into one row, so this is a projection and not a join of all pairs.
    """
    means = mean_vectors(vectors).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("v"))
    bank = means.agg(F.collect_list(F.struct("label", normalised(F.transform("v", lambda x: x["mean"])).alias("t"))).alias("bank"))
    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", normalised(F.col("embedding")).alias("q"))
    scored = queries.join(F.broadcast(bank)).select("vec_id", F.transform("bank", lambda t: F.struct((-F.round(dot(F.col("q"), t["t"]), 9)).alias("s"), t["label"].alias("label"))).alias("all"))
    return scored.select("vec_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("rank", "x")).select("vec_id", F.col("x.label").alias("label"), (F.col("rank") + 1).alias("rank"))


def runs(series: DataFrame, key: str) -> DataFrame:
    """Runs of (key, x, v), smoothed by a mean of three, above a quarter of the key's peak and 12: (key, first, past, total).

    A key is one image or series, whose places from the first to the last are looked at;
    places without a row count 0.  ``past`` is one past the last place.  Each
    place gives its value to its neighbours, so smoothing needs no sorted
    window; only the places above the limit are sorted, within their key.
    """
    ends = series.groupBy(key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    given = series.select(key, F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("at"), F.col("x"), F.col("v"))
    near = given.groupBy(key, F.col("at").alias("x")).agg(F.sum("v").alias("near"), F.coalesce(F.sum(F.when(F.col("at") == F.col("x"), F.col("v"))), F.lit(0)).alias("v"))
    inside = near.join(ends, key).where("x between lo and hi")
    width = 1 + (F.col("x") > F.col("lo")).cast("int") + (F.col("x") < F.col("hi")).cast("int")
    smooth = inside.withColumn("s", F.floor(F.col("near") / width))
    peaks = smooth.groupBy(key).agg(F.max("s").alias("peak")).where("peak >= 20")
    on = smooth.join(peaks, key).where(F.col("s") >= F.greatest(F.lit(12), F.floor(F.col("peak") / 4)))
    grouped = on.withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy(key).orderBy("x")))
    return grouped.groupBy(key, "g").agg(F.min("x").alias("first"), (F.max("x") + 1).alias("past"), F.sum("v").alias("total")).drop("g")


def histogram_percentiles(binned: DataFrame) -> DataFrame:
    """5th, 50th and 95th percentile of (event_type, bin), from counts by bin: the first bin, from 0, by which so many rows (rounded down) are reached."""
    h = binned.groupBy("event_type", "bin").agg(F.count("*").alias("c"))
    run = h.withColumn("upto", F.sum("c").over(Window.partitionBy("event_type").orderBy("bin"))).withColumn("n", F.sum("c").over(Window.partitionBy("event_type")))
    target = lambda p: F.floor(F.max("n") * p / 100)
    at = lambda p: F.when(target(p) == 0, 0).otherwise(F.min(F.when(F.col("upto") >= F.floor(F.col("n") * p / 100), F.col("bin"))))
    return run.groupBy("event_type").agg(at(5).alias("p05"), at(50).alias("p50"), at(95).alias("p95"))
